"""What keeps disk, time and tasks bounded where tables are large."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import matching as M
from tallyframe.operators import settlements as S
from tallyframe.operators import verifier as V
from tallyframe.operators.lineage import stored
from tallyframe.operators.ordinals import numbered_within
from tallyframe.plans import queries as library
from tallyframe.types import BANK, ORDERS, PSP


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_of_one_key_need_not_fit_a_task(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 1000 != 1, "common").alias("k"), F.pmod(F.col("id") * 7919, F.lit(20_011)).alias("v"))
    got = numbered_within(df, ["k"], [F.desc("v")])
    rows = got.collect()
    for k in ("rare", "common", None):
        own = [r.v for r in sorted((r for r in rows if r.k == k), key=lambda r: r.row)]
        assert [r.row for r in sorted((r for r in rows if r.k == k), key=lambda r: r.row)] == list(range(1, len(own) + 1))
        assert own == sorted(own, reverse=True)
    assert "windowspecdefinition(k#" not in plan(got)


def test_uploads_rows_are_not_numbered_by_a_window_over_an_upload(spark, sf_dir):
    assert "windowspecdefinition(u#" not in plan(library.QUERIES["upload_union"](spark, sf_dir))


def test_stored_keeps_rows_and_types(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("a"), "id")).alias("s"), F.lit("2026-01-01").cast("timestamp_ntz").alias("at"), F.struct("id").alias("x")).repartition("s")
    kept = stored(df)
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert "parquet" in plan(kept) and "Exchange" not in plan(kept)
    assert stored(df.where("id < 0")).count() == 0


def test_an_amount_that_recurs_makes_no_pairs(spark):
    day = dt.date(2026, 6, 1)
    lines = spark.range(300).select(F.concat(F.lit("l"), "id").alias("line_id"), F.lit(day).alias("txn_date"), F.lit(1000).cast("long").alias("credit"))
    totals = spark.range(200).select(F.concat(F.lit("s"), "id").alias("settlement_id"), (F.lit(1000) + F.col("id") % 2).cast("long").alias("net"), F.date_add(F.lit(day), (F.col("id") % 10).cast("int") - 5).alias("settled_on"), F.lit(1).cast("long").alias("payment_legs"))
    for tolerance in (0, 100):
        got = M.amount_choices(lines, totals, tolerance)
        fits = [i for i in range(200) if i % 2 <= tolerance and abs(i % 10 - 5) <= 2]
        assert {r.choices for r in got.collect()} == {len(fits)} and got.count() == 300
        assert {r.status for r in M.resolve(got, F.lit(True)).collect()} == {"ambiguous"}
    one = M.amount_choices(lines, totals.where("settlement_id = 's4'"), 0)
    assert {(r.settlement_id, r.status, r.rivals) for r in M.resolve(one, F.lit(True)).collect()} == {("s4", "contested", 300)}


def test_a_trail_takes_exceptions_that_are_there(spark, sf_dir):
    r = library._run(spark, sf_dir)
    excepted = stored(M.exceptions(r))
    assert M.audit(r, excepted).exceptAll(M.audit(r)).isEmpty() and "bank_line" not in plan(M.audit(r, excepted)).split("== Optimized")[1]


def test_legs_are_gathered_of_settlements_that_are_asked_for(spark, sf_dir):
    r = library._run(spark, sf_dir)
    asked = r.totals.orderBy("settlement_id").limit(3)
    got = {x.settlement_id: x.txn_ids for x in library._legs_of(r, asked).collect()}
    legs = r.psp.join(asked.select("settlement_id"), "settlement_id", "left_semi").select("settlement_id", "txn_id").collect()
    assert got == {s: sorted(x.txn_id for x in legs if x.settlement_id == s) for s in {x.settlement_id for x in legs}} and len(got) == 3


def test_settlements_of_one_net_are_counted_before_proposals_meet_them(spark):
    rows = [(f"p{i}", "payment", None, dt.datetime(2026, 6, 1), 1000, f"s{i}", dt.date(2026, 6, 1)) for i in range(50)]
    r = M.reconcile(spark.createDataFrame([], ORDERS), spark.createDataFrame(rows, PSP), spark.createDataFrame([(f"l{i}", dt.date(2026, 6, 20), "PAYOUT", 1000, None, 0, None) for i in range(50)], BANK))
    asked = spark.createDataFrame([(f"l{i}", f"l{i}", [f"p{i}"]) for i in range(50)], "proposal_id string, line_id string, txn_ids array<string>")
    judged = V.check(asked, r.psp, r.bank, r.totals, r.matches)
    assert "Aggregate [net#" in plan(judged)
    assert {(x.settlement_id[1:], x.total, x.verdict) for x in judged.collect()} == {(str(i), 1000, "uniqueness") for i in range(50)}


def test_lists_follow_named_columns_without_ordinals(spark):
    at = lambda d: dt.datetime(2026, 6, d)
    rows = [("a", "payment", "o1", at(3), 1, "s", None), ("b", "payment", "o2", at(2), 1, "s", None), ("c", "payment", None, at(1), 7, "s", None), ("d", "payment", "gone", at(1), 1, "s", None), ("e", "payment", "o1", at(2), 1, "s", None)]
    psp = spark.createDataFrame(rows, PSP)
    orders = spark.createDataFrame([(o, dt.date(2026, 6, 1), "c", a, "INR", "paid") for o, a in (("o1", 2), ("o2", 1), ("o3", 7))], ORDERS)
    filed = ("captured_at", "txn_id")
    assert [list(x) for x in S.leg_lists(psp, filed).collect()] == [["s", ["c", "d", "b", "e", "a"]]]
    sets = S.order_sets(psp, orders, S.recover_orders(psp, psp, orders), filed)
    assert [list(x) for x in sets.collect()] == [["s", "o3,o2,o1", 3]]


def test_reasons_are_counted_once(spark, sf_dir):
    optimized = plan(library.QUERIES["drift_reasons"](spark, sf_dir)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("Join ") == 1


def test_a_trail_needs_no_order_sets(spark, sf_dir):
    r = library._run(spark, sf_dir)
    assert not M.audit(r).isEmpty() and "order_sets" not in vars(r) and "recovered" in vars(r)


def test_what_is_open_is_found_once(spark, sf_dir, monkeypatch):
    calls, real = [], M.line_exceptions
    monkeypatch.setattr(M, "line_exceptions", lambda r: calls.append(1) or real(r))
    judged, open_now = library._accepted(library._run(spark, sf_dir))
    assert len(calls) == 1 and judged.count() > 0 and open_now.count() > 0
