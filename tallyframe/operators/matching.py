"""The matching ladder: each bank credit to the one settlement that explains it, or to none.

Every tier works on sets: candidates of the lines still open among the settlements still unclaimed. A line with more
than one candidate matches nothing, and so do lines whose only candidate is the same settlement; both are remembered.
A tier's matches leave the pools before the next tier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import narration as N
from tallyframe.operators import settlements as S
from tallyframe.operators.bandjoin import band_join, date_window_semi
from tallyframe.operators.lineage import stored
from tallyframe.types import CONFIDENCE, TOLERANCE, WINDOW_DAYS


@dataclass(frozen=True)
class Reconciliation:
    """A run's tables. recovered and order_sets are computed, and stored, when someone reads them."""

    psp: DataFrame
    active: DataFrame
    totals: DataFrame
    references: DataFrame
    matches: DataFrame
    undecided: DataFrame
    bank: DataFrame
    orders: DataFrame

    @cached_property
    def recovered(self) -> DataFrame:
        return stored(S.recover_orders(self.psp, self.active, self.orders))

    @cached_property
    def order_sets(self) -> DataFrame:
        return stored(S.order_sets(self.active, self.orders, self.recovered))


def referenced_settlements(bank: DataFrame, totals: DataFrame) -> DataFrame:
    """(line_id, settlement_id, source): the settlement that a line names: in its narration, else as its utr, else in its utr; only known ones."""
    known = totals.select(F.col("settlement_id").alias("known"))
    tries = F.array(
        F.struct(F.lit(1).alias("rank"), N.settlement_ref(F.col("narration")).alias("settlement_id"), F.lit("narration").alias("source")),
        F.struct(F.lit(2).alias("rank"), F.col("utr").alias("settlement_id"), F.lit("utr").alias("source")),
        F.struct(F.lit(3).alias("rank"), N.settlement_ref(F.col("utr")).alias("settlement_id"), F.lit("utr").alias("source")),
    )
    each = bank.select("line_id", F.explode(tries).alias("t")).select("line_id", "t.*").where("settlement_id is not null")
    hits = each.join(known, F.col("settlement_id") == F.col("known"), "left_semi")
    return hits.groupBy("line_id").agg(F.min(F.struct("rank", "settlement_id", "source")).alias("b")).select("line_id", "b.settlement_id", "b.source")


def resolve(choices: DataFrame, label: Column) -> DataFrame:
    """A line's choices (line_id, choices, settlement_id, ...) with rivals (lines whose only choice is the settlement) and status: matched, ambiguous, contested, or null where the label doesn't hold."""
    sole = F.coalesce((F.col("choices") == 1) & label, F.lit(False))
    # a line with several choices is alone in its partition, so that one of its settlements can't gather them
    among = Window.partitionBy(F.when(sole, F.col("settlement_id")), F.when(~sole, F.col("line_id")))
    rivalled = choices.withColumn("rivals", F.when(sole, F.count("*").over(among)).otherwise(0))
    return rivalled.withColumn("status", F.when(F.col("choices") > 1, "ambiguous").when(sole & (F.col("rivals") > 1), "contested").when(sole, "matched"))


def _claims(resolved: DataFrame, tier: str) -> DataFrame:
    cols = ("line_id", "settlement_id", F.lit(tier).alias("tier"), F.lit(CONFIDENCE[tier]).alias("confidence"), "payment_legs", "net", "credit", (F.col("net") - F.col("credit")).alias("delta"))
    return resolved.where("status = 'matched'").select(*cols)


def _stuck(resolved: DataFrame, tier: str) -> DataFrame:
    """The lines that a tier left, with how wide they were and why."""
    width = F.when(F.col("status") == "ambiguous", F.col("choices")).otherwise(F.col("rivals"))
    return resolved.where(F.col("status").isin("ambiguous", "contested")).select("line_id", width.alias("width"), F.col("status").alias("why"), F.lit(tier).alias("tier"))


_CHOICES = ("line_id", "txn_date", "credit", "choices", "settlement_id", "payment_legs", "net")


def reference_choices(lines: DataFrame, totals: DataFrame, references: DataFrame) -> DataFrame:
    """The settlement that a line names (one at most), where its net is the credit."""
    named = lines.join(references.select("line_id", "settlement_id"), "line_id").join(totals, "settlement_id")
    return named.where("net = credit").withColumn("choices", F.lit(1).cast("long")).select(*_CHOICES)


def amount_choices(lines: DataFrame, totals: DataFrame, tolerance: int) -> DataFrame:
    """How many settlements are within the tolerance of a line's credit and WINDOW_DAYS of its date, and one of them: the one, where choices is 1. Lines without any are left out.

    Settlements of one net and day are counted before lines meet them: a line meets a bounded number of such counts,
    so lines and settlements of an amount that recurs make no pairs. Days, by the few that a window is wide, are part of the
    key, so that a price that is common over years is no hot key.
    """
    few = lambda c: F.floor(F.unix_date(c) / F.lit(2 * WINDOW_DAYS + 1)).cast("long")
    pool = totals.groupBy("net", F.col("settled_on").alias("day")).agg(F.count("*").alias("n"), F.min(F.struct("settlement_id", "payment_legs")).alias("one")).withColumn("_days", few(F.col("day")))
    slim = lines.select("line_id", "txn_date", "credit", F.explode(F.sequence(few(F.date_sub("txn_date", WINDOW_DAYS)), few(F.date_add("txn_date", WINDOW_DAYS)))).alias("_days"))
    met = band_join(slim, pool, "credit", "net", tolerance, F.abs(F.date_diff("day", "txn_date")) <= WINDOW_DAYS, on=("_days",))
    counted = met.groupBy("line_id", "txn_date", "credit").agg(F.sum("n").alias("choices"), F.min(F.struct("one", "net")).alias("of"))
    return counted.select("line_id", "txn_date", "credit", "choices", "of.one.settlement_id", "of.one.payment_legs", "of.net")


def reconcile(orders: DataFrame, psp: DataFrame, bank: DataFrame) -> Reconciliation:
    """The whole ladder over canonical tables (ids unique in each). matches: (line_id, settlement_id, tier, confidence, payment_legs, net, credit, delta).

    What is read by all that follows is stored: the statement, the marked legs, the totals, the references and each tier's
    choices. The second tier looks again at the lines that had exact amounts in the first, among what is left, under another label.
    """
    bank = stored(bank)
    marked = stored(S.suppress_duplicates(psp))
    active = marked.where("not suppressed").drop("suppressed", "twins")
    totals = stored(S.settlement_totals(active))
    references = stored(referenced_settlements(bank, totals))
    lines, pool = bank.where("credit is not null").select("line_id", "txn_date", "credit"), totals
    matches = undecided = resolved = None
    tiers = (("T0", None, F.lit(True)), ("T1", 0, F.col("payment_legs") == 1), ("T2", 0, F.col("payment_legs") >= 2), ("T3", TOLERANCE, F.lit(True)))
    for tier, tolerance, label in tiers:
        if tolerance is None:
            choices = reference_choices(lines, pool, references)
        elif tier == "T2":
            choices = amount_choices(resolved.where("status is null or status <> 'matched'").select("line_id", "txn_date", "credit"), pool, tolerance)
        else:
            choices = amount_choices(lines, pool, tolerance)
        resolved = stored(resolve(choices, label))
        found, open_still = _claims(resolved, tier), _stuck(resolved, tier)
        matches = found if matches is None else matches.unionByName(found)
        undecided = open_still if undecided is None else undecided.unionByName(open_still)
        lines, pool = lines.join(found, "line_id", "left_anti"), pool.join(found, "settlement_id", "left_anti")
    return Reconciliation(marked, active, totals, references, matches, undecided, bank, orders)


def _closed() -> Column:
    """Why a match holds; source is where its line names the settlement."""
    return F.when(
        F.col("tier") == "T0", F.format_string("settlement reference %s found in the %s, and its net equals the credit", F.col("settlement_id"), F.col("source"))
    ).otherwise(F.format_string("only unclaimed settlement within tolerance and %d days; residual %d paise", F.lit(WINDOW_DAYS), F.col("delta")))


def match_groups(r: Reconciliation) -> DataFrame:
    """Matches with their money, orders and evidence; net is the credit, what is over is in the evidence."""
    full = r.matches.drop("net", "payment_legs").join(r.totals.drop("net"), "settlement_id").join(r.order_sets, "settlement_id", "left").join(r.references.select("line_id", "source"), "line_id", "left")
    return full.select(
        "line_id", "settlement_id", "tier", "confidence", "gross", "fees", "tax", "refunds", "holds", F.col("credit").alias("net"), "delta", "payment_legs",
        F.coalesce("order_ids", F.lit("")).alias("order_ids"), _closed().alias("evidence"),
    )


def line_exceptions(r: Reconciliation) -> DataFrame:
    """(line_id, reason_code, amount) of every line that matched nothing; the first reason that applies."""
    left = r.bank.join(r.matches, "line_id", "left_anti")
    unclaimed = r.totals.join(r.matches, "settlement_id", "left_anti")
    stuck = r.undecided.select("line_id").distinct().withColumn("stuck", F.lit(True))
    named = r.references.select("line_id", F.lit(True).alias("named"))
    near = date_window_semi(left.select("line_id", "txn_date"), unclaimed, "txn_date", "settled_on", WINDOW_DAYS).select("line_id", F.lit(True).alias("near"))
    full = left.join(stuck, "line_id", "left").join(named, "line_id", "left").join(near, "line_id", "left")
    reason = (
        F.when(F.col("stuck"), "AMBIGUOUS_MULTI_CANDIDATE").when(F.col("named"), "AMOUNT_MISMATCH").when(F.col("credit").isNull(), "ORPHAN_BANK_LINE")
        .when(F.col("near").isNull(), "ORPHAN_BANK_LINE").when(N.unparseable(F.col("narration")), "UNPARSEABLE_NARRATION").otherwise("NO_SETTLEMENT_REF")
    )
    return full.select("line_id", reason.alias("reason_code"), F.coalesce("credit", "debit", F.lit(0)).cast("long").alias("amount"))


def leg_exceptions(r: Reconciliation) -> DataFrame:
    """(txn_id, reason_code, amount): suppressed copies, legs of no settlement, payments whose order wasn't found; one reason a leg."""
    found = r.recovered.select("txn_id", F.lit(True).alias("found"))
    reason = (
        F.when(F.col("suppressed"), "DUPLICATE_PSP_TXN").when(F.col("settlement_id").isNull(), "ORPHAN_PSP_TXN")
        .when((F.col("txn_type") == "payment") & F.col("order_id").isNull() & F.col("found").isNull(), "MISSING_ORDER_REF")
    )
    odd = r.psp.where("suppressed or settlement_id is null or (txn_type = 'payment' and order_id is null)")  # all others have no reason
    return odd.join(found, "txn_id", "left").select("txn_id", reason.alias("reason_code"), "amount").where("reason_code is not null")


def exceptions(r: Reconciliation) -> DataFrame:
    lines = line_exceptions(r).select(F.lit("bank_line").alias("subject_type"), F.col("line_id").alias("subject_id"), "reason_code", "amount")
    return lines.unionByName(leg_exceptions(r).select(F.lit("psp_txn").alias("subject_type"), F.col("txn_id").alias("subject_id"), "reason_code", "amount"))


def audit(r: Reconciliation, excepted: DataFrame | None = None) -> DataFrame:
    """What was decided: (phase, stage, rule, subject_id, evidence). Its order is that of phase, stage, subject and rule; numbered() counts a part of it. excepted: exceptions(r), where they are there already."""
    dedup = r.psp.where("suppressed").select(F.lit(0).alias("phase"), F.lit("prepare").alias("stage"), F.lit("dedup:suppressed").alias("rule"), F.col("txn_id").alias("subject_id"), F.lit("copy of an event").alias("evidence"))
    recovered = r.recovered.select(F.lit(1).alias("phase"), F.lit("prepare").alias("stage"), F.lit("recovery:order").alias("rule"), F.col("txn_id").alias("subject_id"), F.col("order_id").alias("evidence"))
    stuck = r.undecided.select(F.lit(2).alias("phase"), F.col("tier").alias("stage"), F.col("why").alias("rule"), F.col("line_id").alias("subject_id"), F.format_string("%d ways", "width").alias("evidence"))
    named = r.matches.join(r.references.select("line_id", "source"), "line_id", "left")
    matched = named.select(F.lit(2).alias("phase"), F.col("tier").alias("stage"), F.lit("matched").alias("rule"), F.col("line_id").alias("subject_id"), _closed().alias("evidence"))
    out = (exceptions(r) if excepted is None else excepted).select(F.lit(3).alias("phase"), F.lit("residue").alias("stage"), F.col("reason_code").alias("rule"), "subject_id", F.lit("").alias("evidence"))
    every = dedup.unionByName(recovered).unionByName(stuck).unionByName(matched).unionByName(out)
    return every.select("phase", "stage", "rule", "subject_id", "evidence")


def numbered(entries: DataFrame, subjects: DataFrame) -> DataFrame:
    """The audit entries of some subjects (subject_id), each subject's numbered in order."""
    own = entries.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return own.withColumn("sequence", F.row_number().over(Window.partitionBy("subject_id").orderBy("phase", "stage", "rule")))


def tier_counts(matches: DataFrame) -> DataFrame:
    """Every tier with its number of matches, zeros too."""
    names = matches.sparkSession.createDataFrame([(t,) for t in CONFIDENCE], "tier string")
    return F.broadcast(names).join(matches.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tier_confidence(matches: DataFrame) -> DataFrame:
    """A tier's confidence if all its matches agree, else null with conflict."""
    return matches.groupBy("tier").agg(F.when(F.count_distinct("confidence") == 1, F.min("confidence")).alias("confidence"), (F.count_distinct("confidence") > 1).alias("conflict"))


def partition_check(r: Reconciliation) -> DataFrame:
    """Lines that aren't matched or excepted exactly once: none, if all is well."""
    seen = r.matches.select("line_id").unionAll(line_exceptions(r).select("line_id")).groupBy("line_id").agg(F.count("*").alias("times"))
    return r.bank.select("line_id").join(seen, "line_id", "left").select("line_id", F.coalesce("times", F.lit(0)).cast("long").alias("times")).where("times <> 1")
