"""The registered queries of the library over the driver's tables, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import money, narration
from tallyframe.operators import matching as M
from tallyframe.operators import reports as R
from tallyframe.operators import scoring as G
from tallyframe.operators import settlements as S
from tallyframe.operators import verifier as V
from tallyframe.operators.lineage import stored
from tallyframe.plans import projection as P

FLAGSHIP = "all_matches"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function by its name; sql follows the projection's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {P.SQL} {sql}"
        return f

    return add


def _run(spark: SparkSession, sf_dir: str) -> M.Reconciliation:
    tables = P.base_tables(spark, sf_dir)
    return M.reconcile(P.orders(spark, sf_dir), P.psp(spark, sf_dir, tables), P.bank(spark, sf_dir, tables))


@_query("SELECT * FROM register")
def canonical_orders(spark, sf_dir):
    return P.orders(spark, sf_dir)


@_query("SELECT * FROM psp")
def canonical_psp(spark, sf_dir):
    return P.psp(spark, sf_dir)


@_query("SELECT * FROM bank")
def canonical_bank(spark, sf_dir):
    return P.bank(spark, sf_dir)


@_query(
    "SELECT line_id, upper(trim(regexp_replace(narration, '\\s+', ' ', 'g'))) AS squashed, nullif(regexp_extract(narration, '\\b(setl_[A-Za-z0-9]+)\\b', 1), '') AS settlement_ref, "
    "nullif(regexp_extract(upper(trim(regexp_replace(narration, '\\s+', ' ', 'g'))), '(?:RZPX|RAZORPAY)\\*?([A-Z][A-Z ]{2,}?)(?:\\s+(?:PL|PVT|LTD)\\b|$)', 1), '') AS counterparty FROM bank"
)
def narration_signals(spark, sf_dir):
    n = F.col("narration")
    return P.bank(spark, sf_dir).select("line_id", narration.squashed(n).alias("squashed"), narration.settlement_ref(n).alias("settlement_ref"), narration.counterparty(n).alias("counterparty"))


@_query("SELECT txn_id, settlement_id, suppressed FROM marked")
def duplicate_suppression(spark, sf_dir):
    return S.suppress_duplicates(P.psp(spark, sf_dir)).select("txn_id", "settlement_id", "suppressed")


@_query("SELECT txn_type, order_id, captured_at, amount, count(DISTINCT settlement_id) AS settlements FROM psp WHERE txn_type IN ('payment', 'refund', 'chargeback') AND order_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT settlement_id) > 1")
def cross_settlement_twins(spark, sf_dir):
    return S.suppress_duplicates(P.psp(spark, sf_dir)).where("twins > 1").groupBy(*S.EVENT).agg(F.max("twins").alias("settlements"))


@_query("SELECT * FROM active")
def active_legs(spark, sf_dir):
    return S.active_legs(P.psp(spark, sf_dir))


@_query("SELECT * FROM totals")
def settlement_totals(spark, sf_dir):
    return S.settlement_totals(S.active_legs(P.psp(spark, sf_dir)))


@_query("""SELECT t.settlement_id, CAST(coalesce(g.pg, 0) AS BIGINT) AS payment_gross, CAST((coalesce(g.pg, 0) * 236 - (coalesce(g.pg, 0) * 236) % 10000) // 10000 AS BIGINT) AS expected_fee,
  CAST((f * 1800 - (f * 1800) % 10000) // 10000 AS BIGINT) AS expected_tax, CAST(t.fees - f AS BIGINT) AS fee_gap, CAST(t.tax - (f * 1800 - (f * 1800) % 10000) // 10000 AS BIGINT) AS tax_gap, gross - fees - tax - refunds - holds - net AS residual
  FROM totals t LEFT JOIN (SELECT settlement_id, sum(amount) AS pg FROM active WHERE txn_type = 'payment' GROUP BY ALL) g USING (settlement_id), LATERAL (SELECT (coalesce(g.pg, 0) * 236 - (coalesce(g.pg, 0) * 236) % 10000) // 10000 AS f)""")
def fee_diagnosis(spark, sf_dir):
    active = S.active_legs(P.psp(spark, sf_dir))
    return S.fee_diagnosis(S.settlement_totals(active), active)


@_query("SELECT txn_id, order_id FROM recovered")
def order_recovery(spark, sf_dir):
    psp = P.psp(spark, sf_dir)
    return S.recover_orders(psp, S.active_legs(psp), P.orders(spark, sf_dir))


@_query("SELECT txn_id, txn_type, order_id, settlement_id FROM active WHERE txn_type IN ('payment', 'refund', 'chargeback') AND order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM register)")
def dangling_refs(spark, sf_dir):
    return S.dangling_refs(S.active_legs(P.psp(spark, sf_dir)), P.orders(spark, sf_dir))


@_query("SELECT * FROM sets")
def order_sets(spark, sf_dir):
    psp, orders = P.psp(spark, sf_dir), P.orders(spark, sf_dir)
    active = S.active_legs(psp)
    return S.order_sets(active, orders, S.recover_orders(psp, active, orders))


@_query("SELECT * FROM refs")
def line_references(spark, sf_dir):
    return M.referenced_settlements(P.bank(spark, sf_dir), S.settlement_totals(S.active_legs(P.psp(spark, sf_dir)))).select("line_id", "settlement_id")


@_query("SELECT b.line_id, t.settlement_id, t.net - b.credit AS delta FROM bank b JOIN totals t ON t.net BETWEEN b.credit - 100 AND b.credit + 100")
def band_join_candidates(spark, sf_dir):
    from tallyframe.operators.bandjoin import band_join

    lines = P.bank(spark, sf_dir).where("credit is not null")
    return band_join(lines, S.settlement_totals(S.active_legs(P.psp(spark, sf_dir))), "credit", "net", 100).select("line_id", "settlement_id", (F.col("net") - F.col("credit")).alias("delta"))


for _tier in ("T0", "T1", "T2", "T3"):

    def _of_tier(spark, sf_dir, tier=_tier):
        return _run(spark, sf_dir).matches.where(F.col("tier") == tier).select("line_id", "settlement_id", "payment_legs", "net", "credit")

    QUERIES[f"{_tier.lower()}_matches"] = _of_tier
    ORACLE_SQL[f"{_tier.lower()}_matches"] = f"WITH {P.SQL} SELECT line_id, settlement_id, payment_legs, net, credit FROM {_tier.lower()}"


@_query("SELECT line_id, settlement_id, tier, confidence, payment_legs, net, credit, delta FROM matched")
def all_matches(spark, sf_dir):
    return _run(spark, sf_dir).matches


@_query("""SELECT m.line_id, m.settlement_id, tier, confidence, gross, fees, tax, refunds, holds, m.credit AS net, delta, m.payment_legs, coalesce(order_ids, '') AS order_ids
  FROM matched m JOIN totals t ON t.settlement_id = m.settlement_id LEFT JOIN sets s ON s.settlement_id = m.settlement_id""")
def match_groups(spark, sf_dir):
    return M.match_groups(_run(spark, sf_dir)).drop("evidence")


@_query("SELECT tier, line_id, why, width FROM undecided")
def undecided_lines(spark, sf_dir):
    return _run(spark, sf_dir).undecided.select("tier", "line_id", "why", "width")


@_query("SELECT line_id, reason_code, coalesce(credit, debit, 0) AS amount FROM loose")
def bank_line_exceptions(spark, sf_dir):
    return M.line_exceptions(_run(spark, sf_dir))


@_query("SELECT txn_id, reason_code, amount FROM badlegs WHERE reason_code IS NOT NULL")
def psp_exceptions(spark, sf_dir):
    return M.leg_exceptions(_run(spark, sf_dir))


@_query("SELECT line_id, CAST(0 AS BIGINT) AS times FROM bank WHERE line_id NOT IN (SELECT line_id FROM matched UNION ALL SELECT line_id FROM loose)")
def partition_check(spark, sf_dir):
    return M.partition_check(_run(spark, sf_dir))


@_query("SELECT subject_type, reason_code, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM excepted GROUP BY ALL")
def reason_census(spark, sf_dir):
    return R.reason_census(M.exceptions(_run(spark, sf_dir)))


@_query("SELECT t.tier, count(m.line_id) AS n FROM (VALUES ('T0'), ('T1'), ('T2'), ('T3'), ('LLM')) t(tier) LEFT JOIN matched m ON m.tier = t.tier GROUP BY t.tier")
def tier_counts(spark, sf_dir):
    return M.tier_counts(_run(spark, sf_dir).matches)


@_query("SELECT tier, CASE WHEN count(DISTINCT confidence) = 1 THEN min(confidence) END AS confidence, count(DISTINCT confidence) > 1 AS conflict FROM matched GROUP BY tier")
def tier_confidence(spark, sf_dir):
    return M.tier_confidence(_run(spark, sf_dir).matches)


@_query("SELECT t.settlement_id, gross, fees, tax, refunds, holds, t.net, t.payment_legs, m.line_id IS NOT NULL AS matched, m.line_id, m.tier FROM totals t LEFT JOIN matched m ON m.settlement_id = t.settlement_id")
def settlements_listing(spark, sf_dir):
    r = _run(spark, sf_dir)
    return R.settlement_listing(r.totals, r.matches)


@_query("SELECT m.settlement_id, m.line_id, s.order_id, g.gross_amount FROM matched m JOIN setlegs s ON s.settlement_id = m.settlement_id JOIN register g ON g.order_id = s.order_id")
def batch_netting(spark, sf_dir):
    r = _run(spark, sf_dir)
    return R.batch_netting(r.order_sets, r.matches, r.orders)


_INVOICED = "invoices AS (SELECT period, CASE WHEN substr(period, 6) = '03' THEN computed - 5000 WHEN substr(period, 6) = '07' THEN computed + 7000 ELSE computed END AS invoiced FROM computed WHERE substr(period, 6) <> '11')"
_ITC = f"""{P.SQL}, firsts AS (SELECT m.settlement_id, min(b.txn_date) AS on_day, max(t.tax) AS tax FROM matched m JOIN bank b ON b.line_id = m.line_id JOIN totals t ON t.settlement_id = m.settlement_id GROUP BY ALL),
computed AS (SELECT strftime(on_day, '%Y-%m') AS period, CAST(sum(tax) AS BIGINT) AS computed FROM firsts GROUP BY ALL), {_INVOICED},
loosemonths AS (SELECT DISTINCT strftime(txn_date, '%Y-%m') AS period FROM loose WHERE credit IS NOT NULL),
periods AS (SELECT c.period, c.computed, coalesce(i.invoiced, 0) AS invoiced, c.computed - coalesce(i.invoiced, 0) AS variance, least(c.computed, coalesce(i.invoiced, 0)) AS substantiated, abs(c.computed - coalesce(i.invoiced, 0)) AS at_risk,
  CASE WHEN i.invoiced IS NULL THEN 'no_invoice' WHEN c.computed > i.invoiced THEN 'under_invoiced' WHEN c.computed < i.invoiced AND l.period IS NOT NULL THEN 'unmatched_settlements' WHEN c.computed < i.invoiced THEN 'over_invoiced' ELSE 'substantiated' END AS status
  FROM computed c LEFT JOIN invoices i ON i.period = c.period LEFT JOIN loosemonths l ON l.period = c.period)"""


def _itc(spark, sf_dir):
    """Invoices for the demonstration: every month's own tax, some short, some over, November missing."""
    r = _run(spark, sf_dir)
    groups = M.match_groups(r)
    open_now = stored(M.exceptions(r).where("subject_type = 'bank_line'"))
    own = G.itc_periods(groups, r.bank, open_now, None)
    month = F.substring("period", 6, 2)
    stated = own.where(month != "11").select("period", (F.col("computed") + F.when(month == "03", -5000).when(month == "07", 7000).otherwise(0)).cast("long").alias("gst_amount"))
    return G.itc_periods(groups, r.bank, open_now, stated)


@_query()
def itc_periods(spark, sf_dir):
    return _itc(spark, sf_dir)


@_query()
def itc_totals(spark, sf_dir):
    return G.itc_totals(_itc(spark, sf_dir))


ORACLE_SQL["itc_periods"] = f"WITH {_ITC} SELECT * FROM periods"
ORACLE_SQL["itc_totals"] = f"WITH {_ITC} SELECT CAST(sum(substantiated) AS BIGINT) AS substantiated, CAST(sum(at_risk) AS BIGINT) AS at_risk, CAST(sum(variance) AS BIGINT) AS variance FROM periods"

_VERDICTS = f"""{P.SQL}, linked AS (SELECT line_id, substr(line_id, 4) AS settlement_id FROM bank WHERE credit IS NOT NULL),
traps AS (SELECT line_id FROM linked WHERE line_id LIKE '%c' UNION SELECT substr(line_id, 1, length(line_id) - 1) FROM linked WHERE line_id LIKE '%c'),
verdicts AS (SELECT coalesce(l.line_id, m.line_id) AS line_id, CASE WHEN m.line_id IS NOT NULL AND t.line_id IS NOT NULL THEN 'trapped' WHEN t.line_id IS NOT NULL THEN 'declined'
  WHEN m.line_id IS NULL THEN 'missed' WHEN m.settlement_id = l.settlement_id THEN 'correct' ELSE 'wrong' END AS verdict FROM linked l FULL JOIN matched m ON m.line_id = l.line_id LEFT JOIN traps t ON t.line_id = coalesce(l.line_id, m.line_id))"""


def _graded(spark, sf_dir):
    r = _run(spark, sf_dir)
    linkages, traps = P.truth(r.bank)
    orders = r.order_sets.select("settlement_id", "order_ids")
    with_orders = lambda t: t.join(orders, "settlement_id", "left").select("line_id", "settlement_id", F.coalesce("order_ids", F.lit("")).alias("order_ids"))
    return r, with_orders(linkages), traps, with_orders(r.matches)


@_query()
def score_explain(spark, sf_dir):
    _, linkages, traps, made = _graded(spark, sf_dir)
    return G.verdicts(linkages, traps, made)


@_query()
def scorecard(spark, sf_dir):
    r, linkages, traps, made = _graded(spark, sf_dir)
    return G.scorecard(linkages, traps, made, M.line_exceptions(r))


ORACLE_SQL["score_explain"] = f"WITH {_VERDICTS} SELECT line_id, verdict FROM verdicts"
ORACLE_SQL["scorecard"] = f"""WITH {_VERDICTS}, c AS (SELECT count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'trapped') AS trapped,
  count(*) FILTER (verdict = 'missed') AS missed, count(*) FILTER (verdict = 'declined') AS declined, (SELECT count(*) FROM matched) AS matched, (SELECT count(*) FROM loose) AS excepted FROM verdicts)
SELECT CAST(correct AS DOUBLE) / (correct + wrong + missed) AS auto_match_rate, CAST(correct AS DOUBLE) / (correct + wrong + missed) AS recall_on_resolvable, CAST(correct AS DOUBLE) / (correct + wrong + trapped) AS precision,
  CAST(wrong + trapped AS DOUBLE) / (correct + wrong + trapped) AS false_match_rate, CAST(declined AS DOUBLE) / (declined + trapped) AS trap_capture_rate, CAST(excepted AS DOUBLE) / (matched + excepted) AS exception_rate,
  correct, wrong, trapped, missed, declined, matched, excepted FROM c"""


@_query("""SELECT coalesce(x.reason_code, y.reason_code) AS reason_code, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta, coalesce(x.n, 0) = 0 AS appeared FROM
  (SELECT reason_code, count(*) AS n FROM excepted WHERE subject_type = 'bank_line' GROUP BY ALL) x FULL JOIN (SELECT reason_code, count(*) AS n FROM excepted GROUP BY ALL) y ON x.reason_code = y.reason_code WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def drift_reasons(spark, sf_dir):
    """Moves from a run that saw bank lines alone to one that saw the legs too."""
    every = stored(R.reason_census(M.exceptions(_run(spark, sf_dir))))  # a row for each reason
    count = lambda df: df.groupBy("reason_code").agg(F.sum("n").alias("n"))
    return G.reason_moves(count(every.where("subject_type = 'bank_line'")), count(every))


@_query("""SELECT metric, before, after, after - before AS delta, CASE WHEN before <> 0 THEN after / before - 1 END AS relative, CASE WHEN after = before THEN false WHEN before = 0 THEN true ELSE abs(after - before) / abs(before) >= 0.05 END AS material FROM (
  SELECT 'n_' || tier AS metric, CAST(count(*) AS DOUBLE) AS after, CAST(count(*) FILTER (txn_date < DATE '1999-01-01') AS DOUBLE) AS before FROM matched JOIN bank USING (line_id) GROUP BY tier)""")
def drift_moves(spark, sf_dir):
    """Moves of the tiers' sizes from the lines before 1999 to all lines."""
    r = _run(spark, sf_dir)
    dated = r.matches.join(r.bank.select("line_id", "txn_date"), "line_id").withColumn("metric", F.concat(F.lit("n_"), "tier"))
    both = dated.groupBy("metric").agg(F.count_if(F.col("txn_date") < "1999-01-01").cast("double").alias("b"), F.count("*").cast("double").alias("a"))
    return G.metric_moves(both.select("metric", F.col("b").alias("value")), both.select("metric", F.col("a").alias("value")))


def _legs_of(r: M.Reconciliation, asked: DataFrame) -> DataFrame:
    """(settlement_id, txn_ids) of the settlements that are asked for; the legs of all others aren't gathered."""
    named = r.psp.select("settlement_id", "txn_id").join(asked.select("settlement_id"), "settlement_id", "left_semi")
    return named.groupBy("settlement_id").agg(F.array_sort(F.collect_list("txn_id")).alias("txn_ids"))


def _proposals(r: M.Reconciliation) -> DataFrame:
    """For each excepted line a proposal: all raw legs of the settlement that its id names; those of ids divisible by 3 lack a leg."""
    lines = stored(M.line_exceptions(r).select("line_id", F.expr("substring(line_id, 4)").alias("settlement_id")))
    joined = lines.join(_legs_of(r, lines), "settlement_id")
    short = F.length("line_id") % 3 == 0
    return joined.select(F.col("line_id").alias("proposal_id"), "line_id", F.when(short, F.slice("txn_ids", 2, F.size("txn_ids"))).otherwise(F.col("txn_ids")).alias("txn_ids")).where("size(txn_ids) > 0")


@_query("""SELECT l.line_id AS proposal_id, l.line_id, s.settlement_id, CAST(s.total AS BIGINT) AS total, CASE WHEN l.credit IS NULL OR l.credit <= 0 THEN 'existence' WHEN s.settlement_id IN (SELECT settlement_id FROM matched) THEN 'exclusivity'
    WHEN s.last_settled > l.txn_date THEN 'causality' WHEN abs(s.total - l.credit) > 100 THEN 'arithmetic' WHEN s.n <> s.all_legs THEN 'existence' WHEN (SELECT count(*) FROM totals t WHERE t.settlement_id NOT IN (SELECT settlement_id FROM matched) AND abs(t.net - l.credit) <= 100) > 1 THEN 'uniqueness' ELSE 'accepted' END AS verdict
  FROM loose l JOIN (SELECT settlement_id, sum(amount) FILTER (r > 1 OR even) AS total, count(*) FILTER (r > 1 OR even) AS n, count(*) AS all_legs, max(settled_at) AS last_settled, even FROM (
    SELECT p.*, row_number() OVER (PARTITION BY settlement_id ORDER BY txn_id) AS r, (length(settlement_id) + 3) % 3 <> 0 AS even FROM psp p WHERE settlement_id IS NOT NULL) GROUP BY settlement_id, even) s ON s.settlement_id = substr(l.line_id, 4) WHERE s.n > 0""")
def hypothesis_verdicts(spark, sf_dir):
    r = _run(spark, sf_dir)
    return V.check(stored(_proposals(r)), r.psp, r.bank, r.totals, r.matches)


#: Proposals that meet each other: each line's own settlement; the same again for even ids; one for an unknown subject; a clone's line for the original's settlement.
_ASKED = """asked AS (
  SELECT line_id AS proposal_id, line_id AS subject_id, line_id, substr(line_id, 4) AS sid, length(line_id) % 3 = 0 AS short FROM loose
  UNION ALL SELECT line_id || '~', line_id, line_id, substr(line_id, 4), false FROM loose WHERE length(line_id) % 2 = 0
  UNION ALL SELECT '0' || line_id, 'BL-none', line_id, substr(line_id, 4), false FROM loose WHERE length(line_id) % 2 = 1
  UNION ALL SELECT '1' || line_id, line_id, line_id, substr(line_id, 4, length(line_id) - 4), false FROM loose WHERE line_id LIKE '%c'
), asklegs AS (
  SELECT a.*, p.txn_id, p.amount, p.settled_at FROM asked a JOIN (SELECT *, row_number() OVER (PARTITION BY settlement_id ORDER BY txn_id) AS r FROM psp WHERE settlement_id IS NOT NULL) p ON p.settlement_id = a.sid AND (p.r > 1 OR NOT a.short)
), askfacts AS (
  SELECT proposal_id, subject_id, a.line_id, sid, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, max(settled_at) AS last_settled, any_value(b.credit) AS credit, any_value(b.txn_date) AS txn_date FROM asklegs a JOIN bank b ON b.line_id = a.line_id GROUP BY ALL
), openset AS MATERIALIZED (
  SELECT settlement_id, net FROM totals WHERE settlement_id NOT IN (SELECT settlement_id FROM matched)
), asknear AS (
  SELECT f.credit, list(o.settlement_id) AS near FROM (SELECT DISTINCT credit FROM askfacts) f JOIN openset o ON o.net BETWEEN f.credit - 100 AND f.credit + 100 GROUP BY f.credit
), steps AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY f.proposal_id) AS i, f.*, coalesce(a.near, []) AS near, CASE WHEN f.credit IS NULL OR f.credit <= 0 THEN 'existence' END AS early, f.sid NOT IN (SELECT settlement_id FROM openset) AS taken,
    CASE WHEN last_settled > txn_date THEN 'causality' WHEN abs(total - f.credit) > 100 THEN 'arithmetic' WHEN n <> c.all_legs THEN 'existence' END AS late,
    f.subject_id <> f.line_id OR f.subject_id NOT IN (SELECT line_id FROM loose) AS tie FROM askfacts f LEFT JOIN asknear a ON a.credit = f.credit JOIN (SELECT settlement_id, count(*) AS all_legs FROM psp GROUP BY ALL) c ON c.settlement_id = f.sid
), fold AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS verdict, CAST([] AS VARCHAR[]) AS claimed, CAST([] AS VARCHAR[]) AS resolved
  UNION ALL SELECT i, verdict, CASE WHEN verdict = 'accepted' THEN list_append(claimed, sid) ELSE claimed END, CASE WHEN verdict = 'accepted' THEN list_append(resolved, subject_id) ELSE resolved END FROM (
    SELECT s.*, f.claimed, f.resolved, CASE WHEN early IS NOT NULL THEN early WHEN taken OR list_contains(f.claimed, sid) THEN 'exclusivity' WHEN late IS NOT NULL THEN late
      WHEN len(list_filter(near, lambda x: NOT list_contains(f.claimed, x))) > 1 THEN 'uniqueness' WHEN tie OR list_contains(f.resolved, subject_id) THEN 'existence' ELSE 'accepted' END AS verdict FROM fold f JOIN steps s ON s.i = f.i + 1)
), judged AS (SELECT s.proposal_id, s.line_id, s.sid AS settlement_id, s.total, f.verdict, s.subject_id FROM fold f JOIN steps s ON s.i = f.i)"""
_FOLDED = f"WITH RECURSIVE {P.SQL}, {_ASKED}"


def _asked(r: M.Reconciliation, open_now: DataFrame) -> DataFrame:
    lines = open_now.where("subject_type = 'bank_line'").select(F.col("subject_id").alias("line_id"))
    size, own = F.length("line_id"), F.expr("substring(line_id, 4)")
    ask = lambda name, subject, sid, short, rows: lines.where(rows).select(name.alias("proposal_id"), subject.alias("subject_id"), "line_id", sid.alias("settlement_id"), short.alias("short"))
    line, whole = F.col("line_id"), F.lit(False)
    every = (
        ask(line, line, own, size % 3 == 0, F.lit(True)).unionByName(ask(F.concat(line, F.lit("~")), line, own, whole, size % 2 == 0)).unionByName(ask(F.concat(F.lit("0"), line), F.lit("BL-none"), own, whole, size % 2 == 1))
        .unionByName(ask(F.concat(F.lit("1"), line), line, F.expr("substring(line_id, 4, length(line_id) - 4)"), whole, line.endswith("c")))
    )
    full = every.join(_legs_of(r, every), "settlement_id").withColumn("txn_ids", F.when(F.col("short"), F.slice("txn_ids", 2, F.size("txn_ids"))).otherwise(F.col("txn_ids")))
    return full.where("size(txn_ids) > 0").select("proposal_id", "subject_id", "line_id", "txn_ids")


def _accepted(r: M.Reconciliation) -> tuple[DataFrame, DataFrame]:
    open_now = stored(M.exceptions(r))
    return stored(V.accept(stored(_asked(r, open_now)), r.psp, r.bank, r.totals, r.matches, open_now)), open_now


@_query()
def analyst_verdicts(spark, sf_dir):
    """Every proposal's verdict, in order of ids."""
    return _accepted(_run(spark, sf_dir))[0].drop("why")


@_query()
def analyst_accept(spark, sf_dir):
    r = _run(spark, sf_dir)
    return V.accepted_matches(_accepted(r)[0], r.totals, r.bank, r.order_sets)


@_query()
def analyst_residue(spark, sf_dir):
    """What is still open after the proposals, with the last verdict on it."""
    judged, open_now = _accepted(_run(spark, sf_dir))
    return V.residue(open_now, judged)


ORACLE_SQL["analyst_verdicts"] = f"{_FOLDED} SELECT proposal_id, line_id, settlement_id, total, verdict, subject_id FROM judged"
ORACLE_SQL["analyst_accept"] = f"""{_FOLDED} SELECT j.line_id, j.settlement_id, 'LLM' AS tier, CAST(0.7 AS DOUBLE) AS confidence, t.payment_legs, t.net, b.credit, t.net - b.credit AS delta, coalesce(s.order_ids, '') AS order_ids
  FROM judged j JOIN totals t ON t.settlement_id = j.settlement_id JOIN bank b ON b.line_id = j.line_id LEFT JOIN sets s ON s.settlement_id = j.settlement_id WHERE verdict = 'accepted'"""
ORACLE_SQL["analyst_residue"] = f"""{_FOLDED} SELECT e.*, CASE WHEN l.last IS NULL THEN 'not_attempted' ELSE 'rejected' END AS verifier_verdict, l.last.v AS failed_check, l.last.p AS proposal_id
  FROM excepted e LEFT JOIN (SELECT subject_id, max({{'p': proposal_id, 'v': verdict}}) AS last FROM judged WHERE verdict <> 'accepted' GROUP BY subject_id) l ON l.subject_id = e.subject_id
  WHERE e.subject_id NOT IN (SELECT subject_id FROM judged WHERE verdict = 'accepted')"""


@_query("""SELECT 0 AS phase, 'prepare' AS stage, 'dedup:suppressed' AS rule, txn_id AS subject_id, 'copy of an event' AS evidence FROM marked WHERE suppressed
  UNION ALL SELECT 1, 'prepare', 'recovery:order', txn_id, order_id FROM recovered UNION ALL SELECT 2, tier, why, line_id, width || ' ways' FROM undecided
  UNION ALL SELECT 2, tier, 'matched', m.line_id, CASE WHEN tier = 'T0' THEN 'settlement reference ' || m.settlement_id || ' found in the ' || CASE WHEN regexp_extract(b.narration, '\\b(setl_[A-Za-z0-9]+)\\b', 1) = m.settlement_id THEN 'narration' ELSE 'utr' END
    || ', and its net equals the credit' ELSE 'only unclaimed settlement within tolerance and 2 days; residual ' || delta || ' paise' END FROM matched m JOIN bank b ON b.line_id = m.line_id
  UNION ALL SELECT 3, 'residue', reason_code, subject_id, '' FROM excepted""")
def audit_trail(spark, sf_dir):
    return M.audit(_run(spark, sf_dir))


@_query("SELECT account, line_id, txn_date, credit, debit, CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY account ORDER BY txn_date, line_id) AS BIGINT) AS running FROM (SELECT *, regexp_extract(line_id, 'setl_([0-9]+)x', 1) AS account FROM bank)")
def running_balance(spark, sf_dir):
    lines = P.bank(spark, sf_dir).withColumn("account", F.regexp_extract("line_id", "setl_([0-9]+)x", 1))
    return R.running_balance(lines).select("account", "line_id", "txn_date", "credit", "debit", "running")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS paise FROM lineitem""")
def parse_paise(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat(F.lit("₹"), F.format_number(F.col("l_extendedprice"), 2))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", money.parse_paise(text).alias("paise"))


@_query("SELECT line_id, reason_code, amount FROM (SELECT line_id, reason_code, coalesce(credit, debit, 0) AS amount FROM loose) ORDER BY reason_code, line_id LIMIT 50 OFFSET 100")
def page_exceptions(spark, sf_dir):
    return R.page(M.line_exceptions(_run(spark, sf_dir)), ["reason_code", "line_id"], 100, 50)


@_query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


_RUNS = "runs AS (SELECT o_orderkey AS run_id, 'org' || (o_custkey % 7) AS org_id, CASE WHEN o_custkey % 5 > 0 THEN 'set' || (o_custkey % 5) END AS dataset, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a registry of runs."""
    k = F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("org"), k % 7).alias("org_id"), F.when(k % 5 > 0, F.concat(F.lit("set"), k % 5)).alias("dataset"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


@_query()
def previous_run(spark, sf_dir):
    return R.previous_runs(_runs(spark, sf_dir)).select("run_id", "org_id", "dataset", "previous_run_id")


@_query()
def latest_run(spark, sf_dir):
    return R.latest(_runs(spark, sf_dir), ["org_id", "dataset"]).select("org_id", "dataset", "run_id", "status")


ORACLE_SQL["previous_run"] = f"WITH {_RUNS} SELECT run_id, org_id, dataset, lag(run_id) OVER (PARTITION BY org_id, dataset ORDER BY created_at, run_id) AS previous_run_id FROM runs WHERE status = 'completed'"
ORACLE_SQL["latest_run"] = f"WITH {_RUNS} SELECT org_id, dataset, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY org_id, dataset ORDER BY created_at DESC, run_id DESC) = 1"


def _shop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register in a shop's layout, some rows spoilt by their number: 1 a fraction of a paisa, 2 no customer, 3 a pending order, 4 cut short, 5 negative, 6 another currency, 7 no date."""
    from tallyframe.sources.export import as_rows, to_shop

    shop = to_shop(P.orders(spark, sf_dir))
    number = F.expr("cast(substring(Name, 5) as bigint) % 20")
    spoilt = shop.withColumns({
        "Total": F.when(number == 1, F.concat("Total", F.lit("5"))).when(number == 5, F.concat(F.lit("-"), "Total")).otherwise(F.col("Total")), "Email": F.when(number != 2, F.col("Email")), "Financial Status": F.when(number == 3, "pending").otherwise(F.col("Financial Status")),
        "Currency": F.when(number == 6, "USD").otherwise(F.col("Currency")), "Created at": F.when(number != 7, F.col("Created at")),
    })
    return as_rows(spoilt).withColumn("cells", F.when(F.expr("cast(substring(cells[0], 5) as bigint) % 20") == 4, F.slice("cells", 1, 3)).otherwise(F.col("cells")))


@_query("SELECT order_id, order_date, customer_ref, gross_amount, currency, status FROM register WHERE CAST(substr(order_id, 5) AS BIGINT) % 20 NOT BETWEEN 1 AND 7")
def layout_records(spark, sf_dir):
    from tallyframe.sources.adapters import BY_ID, parse

    return parse(_shop_rows(spark, sf_dir), BY_ID["orders-csv-shopify-v1"])[0].select("order_id", "order_date", "customer_ref", "gross_amount", "currency", "status")


@_query("""SELECT CASE CAST(substr(order_id, 5) AS BIGINT) % 20 WHEN 1 THEN 'BAD_DECIMAL' WHEN 2 THEN 'MISSING_VALUE' WHEN 3 THEN 'UNSUPPORTED_ROW_TYPE' WHEN 4 THEN 'TRUNCATED_ROW' WHEN 5 THEN 'AMBIGUOUS_DIRECTION' WHEN 6 THEN 'UNKNOWN_VALUE' ELSE 'MISSING_VALUE' END AS reason, count(*) AS n
  FROM register WHERE CAST(substr(order_id, 5) AS BIGINT) % 20 BETWEEN 1 AND 7 GROUP BY ALL""")
def layout_quarantine(spark, sf_dir):
    from tallyframe.sources.adapters import BY_ID, parse

    return parse(_shop_rows(spark, sf_dir), BY_ID["orders-csv-shopify-v1"])[1].groupBy("reason").agg(F.count("*").alias("n"))


@_query()
def generated_scorecard(spark, sf_dir):
    """The ladder on generated data, graded; the batches follow the size of the register."""
    from tallyframe.sources.generate import generate

    d = generate(spark, spark.read.parquet(f"{sf_dir}/orders.parquet").count())
    r = M.reconcile(d.orders, d.psp, d.bank)
    made = r.matches.join(r.order_sets.select("settlement_id", "order_ids"), "settlement_id", "left").select("line_id", "settlement_id", "order_ids")
    return G.scorecard(d.linkages, d.unresolvable, made, M.line_exceptions(r))


@_query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS hour, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from tallyframe.streaming.ingest import event_windows as windows

    return windows(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_FILED = "filed AS (SELECT *, row_number() OVER (ORDER BY captured_at, txn_id) AS ordinal FROM psp)"


@_query()
def leg_lists(spark, sf_dir):
    """Legs and orders of every settlement in the order of a file that has the legs by time of capture."""
    psp, orders, filed = P.psp(spark, sf_dir), P.orders(spark, sf_dir), ("captured_at", "txn_id")
    active = stored(S.active_legs(psp).drop("settled_at"))
    sets = stored(S.order_sets(active, orders, stored(S.recover_orders(psp, active, orders)), filed))
    return S.leg_lists(active, filed).select("settlement_id", F.array_join("txn_ids", ",").alias("txn_ids")).join(sets.select("settlement_id", "order_ids"), "settlement_id", "left")


ORACLE_SQL["leg_lists"] = f"""WITH {P.SQL}, {_FILED}, own AS (SELECT a.settlement_id, string_agg(a.txn_id, ',' ORDER BY ordinal) AS txn_ids FROM active a JOIN filed f ON f.txn_id = a.txn_id WHERE a.settlement_id IS NOT NULL GROUP BY a.settlement_id),
  firsts AS (SELECT a.settlement_id, g.order_id, min(f.ordinal) AS first FROM active a JOIN filed f ON f.txn_id = a.txn_id LEFT JOIN recovered r ON r.txn_id = a.txn_id JOIN register g ON g.order_id = coalesce(a.order_id, r.order_id)
    WHERE a.txn_type IN ('payment', 'refund', 'chargeback') AND a.settlement_id IS NOT NULL GROUP BY ALL)
  SELECT o.settlement_id, o.txn_ids, s.order_ids FROM own o LEFT JOIN (SELECT settlement_id, string_agg(order_id, ',' ORDER BY first, order_id) AS order_ids FROM firsts GROUP BY settlement_id) s ON s.settlement_id = o.settlement_id"""


@_query("SELECT row_number() OVER (ORDER BY phase, stage, rule, subject_id, evidence) AS sequence, phase, stage, rule, subject_id FROM (" + ORACLE_SQL["audit_trail"].split(f"WITH {P.SQL} ")[1] + ")")
def audit_sequence(spark, sf_dir):
    """The audit trail with one running number."""
    from tallyframe.operators.ordinals import numbered

    return numbered(M.audit(_run(spark, sf_dir)), ["phase", "stage", "rule", "subject_id", "evidence"], "sequence").drop("evidence")


@_query("""SELECT row_number() OVER (ORDER BY uploaded_at, upload_id, row) AS ordinal, upload_id, txn_id, amount, settled_at FROM (
  SELECT *, 'up' || u AS upload_id, TIMESTAMP '2026-01-01' + INTERVAL 1 day * ((u * 3) % 4) AS uploaded_at, row_number() OVER (PARTITION BY u ORDER BY captured_at DESC, txn_id) AS row FROM (SELECT *, length(txn_id) % 6 AS u FROM psp)) WHERE u <> 2""")
def upload_union(spark, sf_dir):
    """The legs as records of six uploads, five of which a run takes, in the order of the uploads and of their files."""
    from tallyframe.operators.ordinals import numbered_within
    from tallyframe.sources import uploads as U

    legs = P.psp(spark, sf_dir).withColumn("u", (F.length("txn_id") % 6).cast("long"))
    records = U.to_records(numbered_within(legs, ["u"], [F.desc("captured_at"), "txn_id"], "row"), "psp_txn", "org", F.concat(F.lit("up"), "u"), F.col("row"))
    uploads = spark.range(6).select(F.lit("org").alias("org_id"), F.concat(F.lit("up"), "id").alias("upload_id"), F.timestamp_add("DAY", (F.col("id") * 3 % 4).cast("int"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("uploaded_at"))
    taken = U.upload_inputs(records, uploads, "org", ["up5", "up0", "up1", "up3", "up4", "up0", "up9"], "psp_txn")
    return taken.select("ordinal", "upload_id", "txn_id", "amount", "settled_at")


def _digest_sql(name: str, table: str, order: str, columns: str) -> str:
    fields = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(1))" for c in columns.split(", "))
    return f"""{name}0 AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS i, sha256({fields}) AS h FROM ({table})),
  {name}1 AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}0 GROUP BY i // 1024), {name}2 AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}1 GROUP BY i // 1024),
  {name}d AS (SELECT (SELECT count(*) FROM {name}0) AS n, coalesce(max(h), sha256('')) AS digest FROM (SELECT h FROM {name}1 WHERE (SELECT count(*) FROM {name}1) = 1 UNION ALL SELECT h FROM {name}2 WHERE (SELECT count(*) FROM {name}1) > 1))"""


@_query()
def run_digest(spark, sf_dir):
    """Digests of a run's matches, exceptions and audit, and of the run."""
    from tallyframe.operators.digest import run_digest as digest

    r = _run(spark, sf_dir)
    excepted = stored(M.exceptions(r))
    return digest(r.matches, excepted, M.audit(r, excepted))


ORACLE_SQL["run_digest"] = f"""WITH {P.SQL}, {_digest_sql("m", "SELECT * FROM matched", "line_id", "line_id, settlement_id, tier, confidence, payment_legs, net, credit, delta")},
  {_digest_sql("e", "SELECT * FROM excepted", "subject_type, subject_id", "subject_type, subject_id, reason_code, amount")},
  {_digest_sql("a", ORACLE_SQL["audit_trail"].split(f"WITH {P.SQL} ")[1], "phase, stage, rule, subject_id, evidence", "phase, stage, rule, subject_id, evidence")},
  three AS (SELECT 'matches' AS part, * FROM md UNION ALL SELECT 'exceptions', * FROM ed UNION ALL SELECT 'audit', * FROM ad)
SELECT * FROM three UNION ALL SELECT 'run', CAST(sum(n) AS BIGINT), sha256(string_agg(part || ' ' || n || ' ' || digest, ',' ORDER BY part)) FROM three"""


def _register_file(spark: SparkSession, sf_dir: str, orders: DataFrame, name: str) -> str:
    """Orders written as one canonical file, in order of their ids, to the shared folder."""
    import uuid

    from tallyframe.operators.lineage import shared_dir
    from tallyframe.sources import emit

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    emit.write_csv(orders, f"{base}/parts", "orders", ["order_id"])
    emit.join_parts(spark, f"{base}/parts", f"{base}/orders.csv")
    return f"{base}/orders.csv"


@_query("SELECT * FROM register")
def canonical_file(spark, sf_dir):
    """The register written as a file and read by the strict reader."""
    from tallyframe.sources import canonical

    return canonical.read(spark, _register_file(spark, sf_dir, P.orders(spark, sf_dir), "canonical"), "orders")


@_query("""SELECT CAST(2 + row_number() OVER (ORDER BY order_id) - 1 + coalesce(sum(CASE WHEN gross_amount % 3 = 0 THEN 2 ELSE 0 END) OVER (ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS row, order_id,
  CASE WHEN gross_amount % 3 = 0 THEN customer_ref || chr(10) || chr(10) || '"' || status || '",' ELSE customer_ref END AS customer_ref FROM register""")
def physical_rows(spark, sf_dir):
    """The rows of a file with quoted line feeds, and the physical lines that they begin at."""
    from tallyframe.sources.lines import read_rows_by_range

    ref = F.when(F.col("gross_amount") % 3 == 0, F.concat("customer_ref", F.lit('\n\n"'), "status", F.lit('",'))).otherwise(F.col("customer_ref"))
    file = _register_file(spark, sf_dir, P.orders(spark, sf_dir).withColumn("customer_ref", ref), "physical")
    return read_rows_by_range(spark, file).select("row", F.col("cells")[0].alias("order_id"), F.col("cells")[2].alias("customer_ref"))


@_query("""SELECT e.subject_type, e.subject_id, e.reason_code, e.amount, b.narration, p.order_id, coalesce(b.txn_date, CAST(p.captured_at AS DATE)) AS on_day, t.steps, t.last_rule FROM excepted e
  LEFT JOIN bank b ON e.subject_type = 'bank_line' AND b.line_id = e.subject_id LEFT JOIN psp p ON e.subject_type = 'psp_txn' AND p.txn_id = e.subject_id
  LEFT JOIN (SELECT subject_id, count(*) AS steps, max({'p': phase, 's': stage, 'r': rule}).r AS last_rule FROM (""" + ORACLE_SQL["audit_trail"].split(f"WITH {P.SQL} ")[1] + """) GROUP BY subject_id) t ON t.subject_id = e.subject_id""")
def exception_subjects(spark, sf_dir):
    """Every exception with its record and where its trail ends."""
    r = _run(spark, sf_dir)
    excepted = stored(M.exceptions(r))
    trails = stored(R.trails(M.audit(r, excepted)))
    full = R.with_subjects(excepted, R.subjects(r.orders, r.psp.drop("suppressed", "twins"), r.bank)).join(trails, "subject_id", "left")
    on = F.coalesce("bank_line.txn_date", F.col("psp_txn.captured_at").cast("date"))
    return full.select("subject_type", "subject_id", "reason_code", "amount", "bank_line.narration", "psp_txn.order_id", on.alias("on_day"), "steps", "last_rule")


@_query("SELECT line_id, tier, why, width FROM undecided QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY width DESC, tier) = 1")
def widest_ambiguity(spark, sf_dir):
    return R.widest(_run(spark, sf_dir).undecided)


@_query()
def run_history(spark, sf_dir):
    return R.run_history(_runs(spark, sf_dir)).select("run_id", "org_id", "dataset", "status", "place", "seconds_since")


ORACLE_SQL["run_history"] = f"""WITH {_RUNS} SELECT run_id, org_id, dataset, status, CAST(row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, run_id DESC) AS INTEGER) AS place,
  date_diff('second', lag(created_at) OVER (PARTITION BY org_id, dataset ORDER BY created_at, run_id), created_at) AS seconds_since FROM runs"""


@_query()
def assisted_rates(spark, sf_dir):
    """What the ladder and the proposals beside it resolve of what can be resolved."""
    r = _run(spark, sf_dir)
    judged = _accepted(r)[0]
    linkages, traps = P.truth(r.bank)
    every = r.matches.select("line_id", "tier").unionByName(V.accepted_matches(judged, r.totals, r.bank).select("line_id", "tier"))
    return G.match_rates(linkages, traps, every, judged)


ORACLE_SQL["assisted_rates"] = f"""WITH RECURSIVE {_VERDICTS}, {_ASKED}, res AS (SELECT DISTINCT line_id FROM linked WHERE line_id NOT IN (SELECT line_id FROM traps)),
  c AS (SELECT (SELECT count(*) FROM res) AS resolvable, (SELECT count(*) FROM res WHERE line_id IN (SELECT line_id FROM matched)) AS auto, (SELECT count(*) FROM res WHERE line_id IN (SELECT line_id FROM judged WHERE verdict = 'accepted')) AS assisted,
    (SELECT count(*) FROM judged) AS proposed, (SELECT count(*) FROM judged WHERE verdict <> 'accepted') AS rejected)
SELECT resolvable, auto, assisted, proposed, rejected, CAST(auto AS DOUBLE) / resolvable AS auto_match_rate, CAST(assisted AS DOUBLE) / resolvable AS assisted_match_rate, CAST(rejected AS DOUBLE) / proposed AS llm_rejection_rate FROM c"""


@_query("""SELECT line_id, txn_date, narration, credit, debit, balance, utr FROM (SELECT CAST((i - 1) // 50 * 52 + 2 + (i - 1) % 50 AS BIGINT) AS n, *, i % 97 = 0 OR (i > 1 AND (i - 1) % 97 = 0) AS off FROM (
    SELECT row_number() OVER w AS i, 'SLICE-' || CASE WHEN (i - 1) // 50 * 52 + 2 + (i - 1) % 50 < 100000 THEN lpad(CAST((i - 1) // 50 * 52 + 2 + (i - 1) % 50 AS VARCHAR), 5, '0') ELSE CAST((i - 1) // 50 * 52 + 2 + (i - 1) % 50 AS VARCHAR) END AS line_id,
      CAST(txn_date + INTERVAL 30 year AS DATE) AS txn_date, narration, credit, debit, CAST(900000000000 + sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER w AS BIGINT) AS balance, lpad(CAST(i AS VARCHAR), 12, '0') AS utr FROM bank WINDOW w AS (ORDER BY txn_date, line_id))) WHERE NOT off""")
def printed_statement(spark, sf_dir):
    """The statement printed in pages of fifty rows, some balances wrong, and read again."""
    import uuid

    from tallyframe.operators.lineage import shared_dir
    from tallyframe.operators.ordinals import numbered
    from tallyframe.sources import emit
    from tallyframe.sources.statements import parse_statement_text

    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    lines = numbered(P.bank(spark, sf_dir), ["txn_date", "line_id"], "i", running={"upto": moved})
    claimed = F.col("upto") + F.lit(900_000_000_000) + F.when(F.col("i") % 97 == 0, 1).otherwise(0)
    page = F.concat(F.when(F.col("i") > 1, "\f").otherwise(""), F.call_function("div", F.col("i") - 1, F.lit(50).cast("long")) % 1000, F.lit("/999\n"))
    day = F.date_format(F.add_months("txn_date", 360), "d MMM ''yy")
    text = F.concat(F.when((F.col("i") - 1) % 50 == 0, page).otherwise(""), F.concat_ws(" ", day, "narration", F.lpad(F.col("i").cast("string"), 12, "0"), F.regexp_replace(money.fmt_inr(F.coalesce("credit", -F.col("debit"))), "^-", "-"), money.fmt_inr(claimed)))
    base = f"{shared_dir(spark)}/printed-{uuid.uuid4().hex}"
    emit.write_lines([(lines, text, ["i"])], f"{base}/parts")
    emit.join_parts(spark, f"{base}/parts", f"{base}/statement.txt")
    return parse_statement_text(spark, f"{base}/statement.txt")[0].select("line_id", "txn_date", "narration", "credit", "debit", "balance", "utr")
