"""The ladder on small built pools."""

import datetime as dt

import pytest

from tallyframe.operators import matching as M
from tallyframe.operators import settlements as S
from tallyframe.operators import verifier as V
from tallyframe.operators.bandjoin import band_join
from tallyframe.types import BANK, ORDERS, PSP

D = dt.date(2026, 6, 1)
T = dt.datetime(2026, 6, 1, 10)


def pay(txn, amount, settlement="setl_A", order=None, kind="payment", settled=D, at=T):
    return (txn, kind, order, at, amount, settlement, settled if settlement else None)


def line(name, credit, narration="PAYOUT", days=1, utr=None, debit=None):
    return (name, D + dt.timedelta(days), narration, credit, debit, 0, utr)


@pytest.fixture
def run(spark):
    def go(psp, bank, orders=()):
        return M.reconcile(spark.createDataFrame(list(orders), ORDERS), spark.createDataFrame(psp, PSP), spark.createDataFrame(bank, BANK))

    return go


def walk(r):
    return {x.line_id: (x.settlement_id, x.tier) for x in r.matches.collect()}


def reasons(r):
    return {x.line_id: x.reason_code for x in M.line_exceptions(r).collect()}


def test_tiers_and_their_edges(run):
    psp = [
        pay("p1", 1000, "setl_A"), pay("p2", 2000, "setl_B"), pay("p3", 1500, "setl_C"), pay("p4", 1500, "setl_C"), pay("p5", 5000, "setl_D"), pay("p6", 7000, "setl_E"), pay("p7", 9000, "setl_F"),
    ]
    bank = [
        line("T0", 1000, "NEFT setl_A late", days=30), line("T1", 2000), line("T2", 3000, days=2), line("T3", 5100, days=-2), line("over", 7101), line("late", 9000, days=3), line("debit", None, debit=10),
    ]
    r = run(psp, bank)
    assert walk(r) == {"T0": ("setl_A", "T0"), "T1": ("setl_B", "T1"), "T2": ("setl_C", "T2"), "T3": ("setl_D", "T3")}
    assert reasons(r) == {"over": "UNPARSEABLE_NARRATION", "late": "ORPHAN_BANK_LINE", "debit": "ORPHAN_BANK_LINE"}
    assert M.partition_check(r).isEmpty()


def test_more_than_one_answer_is_none(run):
    psp = [pay("p1", 1000, "setl_A"), pay("p2", 500, "setl_B"), pay("p3", 500, "setl_B"), pay("p4", 4000, "setl_C")]
    r = run(psp, [line("two", 1000), line("x", 4000), line("y", 4000)])
    assert walk(r) == {}
    assert reasons(r) == {"two": "AMBIGUOUS_MULTI_CANDIDATE", "x": "AMBIGUOUS_MULTI_CANDIDATE", "y": "AMBIGUOUS_MULTI_CANDIDATE"}


def test_references(run):
    psp = [pay("p1", 1000, "setl_A"), pay("p2", 2000, "setl_B"), pay("p3", 3000, "setl_C")]
    bank = [line("utr", 1000, utr="setl_A", days=40), line("in_utr", 2000, utr="X setl_B", days=40), line("off", 2500, "for setl_C", days=40), line("spend", None, "setl_C", debit=5)]
    r = run(psp, bank)
    assert walk(r) == {"utr": ("setl_A", "T0"), "in_utr": ("setl_B", "T0")}
    assert reasons(r) == {"off": "AMOUNT_MISMATCH", "spend": "AMOUNT_MISMATCH"}


def test_duplicates(spark):
    rows = [
        pay("a2", 10, "setl_A", "o1"), pay("a1", 10, "setl_A", "o1"), pay("a3", 10, None, "o1"), pay("b2", 10, None, "o2"), pay("b1", 10, None, "o2"), pay("c1", 10, "setl_A", "o3"), pay("c2", 10, "setl_B", "o3"),
        pay("d1", 10, "setl_A"), pay("d2", 10, "setl_A"), pay("e1", 10, "setl_A", "o1", "fee"), pay("e2", 10, "setl_A", "o1", "fee"),
    ]
    marked = {r.txn_id: (r.suppressed, r.twins) for r in S.suppress_duplicates(spark.createDataFrame(rows, PSP)).collect()}
    assert {k for k, v in marked.items() if v[0]} == {"a2", "a3", "b2"}
    assert marked["c1"][1] == marked["c2"][1] == 2


def test_recovery(spark):
    psp = spark.createDataFrame([pay("p1", 100), pay("p2", 200), pay("p3", 300), pay("p4", 300), pay("p5", 1, order="named")], PSP)
    day = lambda n: D - dt.timedelta(n)
    orders = spark.createDataFrame([
        ("one", day(90), "c", 100, "INR", "paid"), ("near", day(3), "c", 200, "INR", "paid"), ("far", day(8), "c", 200, "INR", "paid"), ("contested", day(1), "c", 300, "INR", "paid"), ("named", day(1), "c", 1, "INR", "paid"),
    ], ORDERS)
    found = {r.txn_id: r.order_id for r in S.recover_orders(psp, psp, orders).collect()}
    assert found == {"p1": "one", "p2": "near"}


def test_band_join_is_the_filter(spark):
    a = spark.range(-60, 60).selectExpr("id * 37 as x")
    b = spark.range(-300, 300).selectExpr("id * 11 as y")
    for width in (0, 1, 100):
        got = sorted(map(tuple, band_join(a, b, "x", "y", width).collect()))
        assert got == sorted((x * 37, y * 11) for x in range(-60, 60) for y in range(-300, 300) if abs(x * 37 - y * 11) <= width)


def test_verifier(run, spark):
    psp = [pay("p1", 600, "setl_A"), pay("p2", 400, "setl_A"), pay("p3", 5000, "setl_B"), pay("p4", 5050, "setl_C"), pay("p5", 77, "setl_D")]
    bank = [line("l1", 1000, days=20), line("l2", 5000, days=20), line("l3", 77, "setl_D"), line("l4", 1000, days=-5)]
    r = run(psp, bank)
    ask = [("a", "l1", ["p1", "p2"]), ("b", "l1", ["p1"]), ("c", "l2", ["p3"]), ("d", "l3", ["p5"]), ("e", "l1", ["p1", "nope"]), ("f", "l4", ["p1", "p2"]), ("g", "l9", ["p1"]), ("h", "l1", ["p1", "p1"])]
    proposals = spark.createDataFrame(ask, "proposal_id string, line_id string, txn_ids array<string>")
    got = {x.proposal_id: x.verdict for x in V.check(proposals, r.psp, r.bank, r.totals, r.matches).collect()}
    assert got == {"a": "accepted", "b": "arithmetic", "c": "uniqueness", "d": "exclusivity", "e": "existence", "f": "causality", "g": "existence", "h": "existence"}
    twice = spark.createDataFrame([("a", "l1", ["p1", "p2"]), ("z", "l1", ["p1", "p2"])], proposals.schema)
    got = {x.proposal_id: x.verdict for x in V.accept(twice, r.psp, r.bank, r.totals, r.matches).collect()}
    assert got == {"a": "accepted", "z": "exclusivity"}


def test_empty_tables(run):
    r = run([], [])
    assert r.matches.isEmpty() and M.exceptions(r).isEmpty()
