"""Records behind exceptions, invariants of a run, rates, history, and uploads that survive a crash."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.operators import reports as R
from tallyframe.operators import scoring as G
from tallyframe.operators import settlements as S
from tallyframe.streaming.ingest import deliver, watch_folder
from tallyframe.types import BANK, ORDERS, PSP

D, T = dt.date(2026, 6, 1), dt.datetime(2026, 6, 1, 10)


@pytest.fixture
def known(spark):
    orders = spark.createDataFrame([("ORD-1", D, "c", 5, "INR", "paid")], ORDERS)
    psp = spark.createDataFrame([("p1", "payment", "ORD-1", T, 5, "setl_A", D)], PSP)
    bank = spark.createDataFrame([("l1", D, "text", 5, None, 0, None)], BANK)
    return R.subjects(orders, psp, bank)


EXCEPTIONS = "subject_type string, subject_id string, reason_code string, amount long"


def test_exceptions_with_their_records(spark, known):
    open_now = spark.createDataFrame([("bank_line", "l1", "A", 5), ("psp_txn", "p1", "B", 7)], EXCEPTIONS)
    got = {r.subject_id: r for r in R.with_subjects(open_now, known).collect()}
    assert got["l1"].bank_line.narration == "text" and got["l1"].psp_txn is None and got["p1"].psp_txn.order_id == "ORD-1" and got["p1"].bank_line is None
    with pytest.raises(PySparkException, match="no such psp_txn l1"):
        R.with_subjects(spark.createDataFrame([("psp_txn", "l1", "A", 5)], EXCEPTIONS), known).collect()
    assert R.with_subjects(open_now.limit(0), known).isEmpty()


def test_pages_with_totals(spark):
    rows = [("bank_line" if i % 3 else "psp_txn", f"s{i:03d}", "AB"[i % 2], i) for i in range(50)]
    table = spark.createDataFrame(rows, EXCEPTIONS)
    page, totals = R.exceptions_page(table, 5, 4, reason="B")
    want = sorted((r[2], r[0], r[1]) for r in rows if r[2] == "B")
    assert [(r.reason_code, r.subject_type, r.subject_id) for r in page.collect()] == want[5:9]
    assert tuple(totals.first()) == (25, sum(r[3] for r in rows if r[2] == "B"))
    assert tuple(R.exceptions_page(table, 0, 1, reason="C")[1].first()) == (0, 0)
    assert R.exceptions_page(table, 0, 100, subject_type="psp_txn")[0].count() == 17


def test_invariants_stop_the_run(spark):
    groups = spark.createDataFrame([("l1", "setl_A", 18), ("l9", "setl_B", 7)], "line_id string, settlement_id string, tax long")
    bank = spark.createDataFrame([("l1", D, "x", 5, None, 0, None)], BANK)
    none = spark.createDataFrame([], EXCEPTIONS)
    with pytest.raises(PySparkException, match="no such line: l9"):
        G.itc_periods(groups, bank, none, None).collect()
    assert [r.computed for r in G.itc_periods(groups.where("line_id = 'l1'"), bank, none, None).collect()] == [18]
    lost = spark.createDataFrame([("bank_line", "l7", "A", 5)], EXCEPTIONS)
    with pytest.raises(PySparkException, match="no such line: l7"):
        G.itc_periods(groups.where("line_id = 'l1'"), bank, lost, None).collect()
    legs = spark.createDataFrame([("p1", "payment", None, T, 5, "setl_A", D), ("p2", "gift", None, T, 5, "setl_A", D)], PSP)
    with pytest.raises(PySparkException, match="p2 is of no known type: gift"):
        S.settlement_totals(legs).collect()


def test_rates_with_help(spark):
    linkages = spark.createDataFrame([(f"l{i}",) for i in range(5)] + [("t",)], "line_id string")
    made = spark.createDataFrame([("l0", "T0"), ("l1", "T3"), ("l2", "LLM"), ("t", "T0"), ("x", "T1")], "line_id string, tier string")
    judged = spark.createDataFrame([("accepted",), ("existence",), ("uniqueness",), ("accepted",)], "verdict string")
    row = G.match_rates(linkages, spark.createDataFrame([("t",)], "line_id string"), made, judged).first()
    assert (row.resolvable, row.auto, row.assisted, row.auto_match_rate, row.assisted_match_rate, row.llm_rejection_rate) == (5, 2, 1, 0.4, 0.2, 0.5)
    assert G.match_rates(linkages.limit(0), linkages, made, judged.limit(0)).first().llm_rejection_rate == 0


def test_history_and_widest(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    runs = spark.createDataFrame([(1, "o", "d", at(1)), (2, "o", None, at(2)), (3, "o", "d", at(4)), (4, "p", "d", at(5)), (5, "o", None, at(2))], "run_id long, org_id string, dataset string, created_at timestamp_ntz")
    got = {r.run_id: (r.place, r.seconds_since, r.n) for r in R.run_history(runs, spark.createDataFrame([(3, 9)], "run_id long, n int")).collect()}
    assert got == {1: (4, None, None), 2: (3, None, None), 3: (1, 10_800, 9), 4: (1, None, None), 5: (2, 0, None)}
    stuck = spark.createDataFrame([("l", "T1", "ambiguous", 2), ("l", "T3", "ambiguous", 5), ("l", "T2", "contested", 5)], "line_id string, tier string, why string, width long")
    assert [tuple(r) for r in R.widest(stuck).collect()] == [("l", "T2", "contested", 5)]


@pytest.mark.parametrize("crash", ["before", "after"])
def test_a_crash_hands_no_content_over_twice(spark, tmp_path, crash):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    calls = []

    def handle(fresh, epoch):
        calls.append(epoch)
        if crash == "after" or len(calls) != 2:
            deliver(fresh.select("path", "content_sha256"), out, "watch", epoch)
        if len(calls) == 2:
            raise RuntimeError("lost")

    go = lambda: watch_folder(spark, str(folder), str(tmp_path / "registry"), str(tmp_path / "ck"), "org", handle).awaitTermination()
    (folder / "a.csv").write_text("x")
    go()
    (folder / "b.csv").write_text("x")
    (folder / "c.csv").write_text("y")
    with pytest.raises(Exception, match="lost"):
        go()
    (folder / "d.csv").write_text("y")
    (folder / "e.csv").write_text("z")
    go()
    got = [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["a.csv", "c.csv", "e.csv"] and calls[1] == calls[2]


def test_two_watchers_of_one_registry(spark, tmp_path):
    seen = []
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("same")
        (tmp_path / name / f"{name}.csv").write_text(name)
        watch_folder(spark, str(tmp_path / name), str(tmp_path / "registry"), str(tmp_path / f"ck-{name}"), "org", lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), source=name).awaitTermination()
    assert sorted(seen) == ["a.csv", "one.csv", "two.csv"]
