import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.functions import money, narration
from tallyframe.operators import matching as M
from tallyframe.operators import scoring as G
from tallyframe.sources import adapters, canonical, files
from tallyframe.sources.generate import generate
from tallyframe.streaming.ingest import event_windows, read_events, watch_folder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "paise"), [("1,234.56", 123456), ("₹1,500", 150000), ("-₹85", -8500), ("Rs. 10.5", 1050), ("46556.545", None), ("", None), ("1.2.3", None), ("12,34,567.00", 123456700), ("99999999999999999999", None)])
def test_parse_paise(spark, text, paise):
    assert one(spark, money.parse_paise(F.lit(text))) == paise


def test_money(spark):
    assert one(spark, money.pct_of(F.lit(-4932000).cast("long"), 236)) == -116396
    assert one(spark, money.fmt_inr(F.lit(-123456789).cast("long"))) == "-₹1,234,567.89"
    assert one(spark, money.rupees(F.lit(-5).cast("long"))) == "-0.05"
    assert one(spark, money.parse_comma_amount(F.lit("342614,53"))) == 34261453
    assert one(spark, money.parse_comma_amount(F.lit("1,234"))) is None
    assert one(spark, money.parse_comma_amount(F.lit("1000"))) == one(spark, money.parse_comma_amount(F.lit("1000,"))) == 100_000
    assert one(spark, money.parse_comma_amount(F.lit("123456789012345,00"))) == 12345678901234500 and one(spark, money.parse_comma_amount(F.lit("1234567890123456"))) is None
    big = 10**14 + 12_345_678_901
    assert all(one(spark, money.pct_of(F.lit(x), 236)) == x * 236 // 10_000 for x in (big, big + 1, 3 * 10**16 - 7, -big))


def test_narration(spark):
    assert one(spark, narration.squashed(F.lit(" a  b "))) == "A B"
    assert one(spark, narration.settlement_ref(F.lit("X setl_9a!"))) == "setl_9a"
    assert one(spark, narration.settlement_ref(F.lit("setl_a_b"))) is None
    assert one(spark, narration.transfer_ref(F.lit("utr: abcdefghijkl"))) == "ABCDEFGHIJKL"
    assert one(spark, narration.counterparty(F.lit("RZPX*ACME  RET PL"))) == "ACME RET"


def test_canonical_round_trip_and_refusal(spark, tmp_path):
    d = generate(spark, 30)
    for name, table in (("orders", d.orders), ("psp", d.psp), ("bank", d.bank)):
        canonical.write(table.select(*canonical.SCHEMAS[name].names), f"{tmp_path}/{name}", name)
        back = canonical.read(spark, f"{tmp_path}/{name}", name)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, table.select(*back.columns).collect()), key=str)
    bad = tmp_path / "orders.csv"
    bad.write_text("order_id,order_date,customer_ref,gross_amount,currency,status\no,2026-01-01,c,12.5,INR,paid\n")
    with pytest.raises(PySparkException, match="gross_amount"):
        canonical.read(spark, str(bad), "orders").collect()
    assert canonical.read_optional(spark, str(tmp_path / "none.csv"), "invoice") is None


def test_generated_data_is_graded(spark):
    d = generate(spark, 100)
    r = M.reconcile(d.orders, d.psp, d.bank)
    made = r.matches.join(r.order_sets.select("settlement_id", "order_ids"), "settlement_id", "left").select("line_id", "settlement_id", "order_ids")
    card = G.scorecard(d.linkages, d.unresolvable, made, M.line_exceptions(r)).first()
    assert card.false_match_rate == 0 and card.trap_capture_rate == 1 and card.auto_match_rate > 0.9
    assert M.partition_check(r).isEmpty()


SHOP = """# note
Name,Email,Financial Status,Currency,Total,Created at,Lineitem name
#1,a@x.in,paid,INR,10.00,2026-08-01 09:00:00 +0530,tea
#1,a@x.in,,,,,cup
#2,b@x.in,pending,INR,10.00,2026-08-01 09:00:00 +0530,tea
#3,c@x.in,paid,INR,10.005,2026-08-01 09:00:00 +0530,tea
#3,c@x.in,paid,INR,10.00,2026-08-01 09:00:00 +0530,tea
#4,d@x.in,paid,INR
#5,,paid,INR,1.00,2026-08-01 09:00:00 +0530,"te
a"
#6,f@x.in,paid,INR,1.00,2026-08-01 09:00:00 +0530,tea,more
"""


def test_shop_layout(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(SHOP)
    found, records, left = adapters.ingest(spark, str(path))
    assert found == "orders-csv-shopify-v1"
    assert [(r.order_id, r.gross_amount, r.order_date) for r in records.collect()] == [("#1", 1000, dt.date(2026, 8, 1))]
    assert {r.row: r.reason for r in left.collect()} == {5: "UNSUPPORTED_ROW_TYPE", 6: "BAD_DECIMAL", 7: "DUPLICATE_ROW", 8: "TRUNCATED_ROW", 9: "MISSING_VALUE", 11: "EXTRA_FIELDS"}


MESSAGE = """:20:A
:60F:C260813INR1000,00
:61:2608140814CR500,50NTRFREF//HDFCR52026081401
:86:NEFT ONE
TWO
:61:2608150815D200,00NCHQX
:86:CHEQUE
:62F:C260815INR1300,50
:20:B
:60F:C260813INR10,00
:61:2608140814CR1,00NTRFREF
:86:ODD
:62F:C260815INR99,00
"""


def test_tagged_statement(spark, tmp_path):
    path = tmp_path / "x.sta"
    path.write_text(MESSAGE)
    found, records, left = adapters.ingest(spark, str(path))
    assert found == "mt940-v1"
    assert [(r.narration, r.credit, r.debit, r.balance, r.utr) for r in records.orderBy("row").collect()] == [("NEFT ONE TWO", 50050, None, 150050, "HDFCR52026081401"), ("CHEQUE", None, 20000, 130050, None)]
    assert [r.reason for r in left.collect()] == ["STATEMENT_REJECTED"]


def test_unknown_file(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n")
    found, records, left = adapters.ingest(spark, str(path))
    assert found is None and records is None and left.first().reason == "UNRECOGNISED_FORMAT"


def test_watched_folder_takes_a_content_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    go = lambda: watch_folder(spark, str(folder), str(tmp_path / "registry"), str(tmp_path / "ck"), "org", lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect())).awaitTermination()
    (folder / "a.csv").write_text("x")
    (folder / "b.csv").write_text("x")
    (folder / ".hidden").write_text("z")
    go()
    (folder / "c.csv").write_text("x")
    (folder / "d.csv").write_text("y")
    go()
    assert seen == ["a.csv", "d.csv"]


def test_event_windows_stream_as_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    query = event_windows(read_events(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r)[:3] for r in spark.table("windows").collect()} == {tuple(r)[:3] for r in event_windows(events).collect()}


def test_references_in_narrations(spark):
    from tallyframe.sources.adapters import bank_utr

    first = {"NEFT CR-HDFC0000123-SHOP-N260801123456789": "N260801123456789", "NEFT CR-HDFC0000123-RAZORPAY SOFTWARE": None, "POS 123456789012": None, "paid, utr: ABCD1234567890": "ABCD1234567890", "IMPS/RRN/412345678901": "412345678901", "": None}
    second = {"NEFT-N260801123456789-RAZORPAY SOFTWARE": "N260801123456789", "NEFT-RAZORPAYSOFTWARE-N260801123456789": None, "INF UTR-AB12345678": "AB12345678", "X": None}
    for told, last in ((first, True), (second, False)):
        table = spark.createDataFrame([(t,) for t in told], "t string")
        assert {r.t: r.u for r in table.select("t", bank_utr(F.col("t"), last).alias("u")).collect()} == told


BANK = """Date,Narration,Chq./Ref.No.,Value Dt,Withdrawal Amt.,Deposit Amt.,Closing Balance
01/08/26,NEFT CR A,{},01/08/26,0.00,10.00,10.00
"two
lines",BAD DATE,{},01/08/26,0.00,10.00,20.00
03/08/26,NEFT CR B,{},03/08/26,5.00,0.00,15.00
"""


def test_line_ids_are_carried_or_the_physical_line(spark, tmp_path):
    layout = adapters.BY_ID["bank-csv-hdfc-v1"]
    ids = lambda *refs: [r.line_id for r in adapters.parse(files.read_rows(spark, str(_write(tmp_path, BANK.format(*refs)))), layout)[0].orderBy("row").collect()]
    assert ids("r1", "r2", "r3") == ["r1", "r3"]
    # a row that can't be used still has its say about the references
    assert ids("r1", "r1", "r3") == ["HDFC-00002", "HDFC-00005"] == ids("r1", "", "r3")


def _write(folder, text):
    path = folder / f"f{abs(hash(text))}.csv"
    path.write_text(text)
    return path


COURIER = """Remittance Ref,Remittance Date,AWB,Order ID,Collected,Row Type,Delivery Date,Freight Charge,GST
R/1,14-08-2026,w1,ORD-1,100.00,COD,12-08-2026,10.00,1.80
R/1,14-08-2026,w1,ORD-1,100.00,COD,13-08-2026,10.00,1.80
R/1,14-08-2026,,,,DEDUCTION,,5.00,
R/1,14-08-2026,,,,DEDUCTION,,5.00,
R/1,14-08-2026,,,,DEDUCTION,,-5.00,
R/1,14-08-2026,w2,,50.00,COD,,,
R/1,14-08-2026,w3,ORD-3,-1.00,,,,
R/1,14-08-2026,w4,ORD-4,0.00,COD,,,
R/1,14-08-2026,w5,ORD-5,7.00,COD,2026/08/01,,
R/1,2026-08-14,w6,ORD-6,7.00,,,,
R/1,14-08-2026,w7,ORD-7,7.00,RETURN,,,
"""


def test_courier_with_other_column_names(spark, tmp_path):
    import datetime as dt

    rows = files.read_rows(spark, str(_write(tmp_path, COURIER)))
    records, left = adapters.parse(rows, adapters.courier({"waybill": "AWB", "cod_amount": "Collected"}))
    got = {r.txn_id: (r.txn_type, r.order_id, r.amount, r.captured_at.date(), r.settled_at, r.settlement_id) for r in records.collect()}
    on, day = dt.date(2026, 8, 14), lambda n: dt.date(2026, 8, n)
    assert got == {
        "cod_w1": ("payment", "ORD-1", 10_000, day(12), on, "setl_codR1"), "frt_w1": ("fee", "ORD-1", -1000, day(12), on, "setl_codR1"), "gst_w1": ("tax", "ORD-1", -180, day(12), on, "setl_codR1"),
        "frt_R1L4": ("fee", None, -500, on, on, "setl_codR1"), "cod_w6": ("payment", "ORD-6", 700, on, on, "setl_codR1"),
    }
    assert {r.row: r.reason for r in left.collect()} == {3: "DUPLICATE_ROW", 5: "DUPLICATE_ROW", 6: "AMBIGUOUS_DIRECTION", 7: "MISSING_VALUE", 8: "AMBIGUOUS_DIRECTION", 9: "AMBIGUOUS_DIRECTION", 10: "BAD_DATE", 12: "UNKNOWN_VALUE"}
    with pytest.raises(ValueError):
        adapters.courier({"awb": "AWB"})


def test_long_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    path = str(_write(tmp_path, SHOP))
    whole = adapters.ingest(spark, path)
    monkeypatch.setattr(adapters, "WHOLE_BYTES", 10)
    ranged = adapters.ingest(spark, path)
    for a, b in zip(whole[1:], ranged[1:], strict=True):
        drop = lambda df: sorted(map(tuple, df.drop("file_sha256", "path").collect()), key=str)
        assert drop(a) == drop(b)
