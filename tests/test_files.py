"""Files of any size by ranges, numbers in a total order, emission, digests and uploads."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.digest import ordered_digest
from tallyframe.operators.ordinals import numbered
from tallyframe.sources import canonical, emit, files, uploads
from tallyframe.sources.generate import generate
from tallyframe.sources.lines import ends_inside, read_rows_by_range
from tallyframe.types import PSP


@pytest.fixture
def small_ranges(spark):
    """Files are split every 97 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def by_range(spark, path):
    return sorted((r.row, r.raw, r.header, r.cells) for r in read_rows_by_range(spark, str(path)).collect())


def wild_csv(rng, n):
    """Quoted cells with line feeds, commas and doubled quotes, quotes inside unquoted cells, blank lines, short and long rows."""
    cells = ['"a\nb"', '"x, ""y"""', '""', '"\n\n\n"', 'in 5" pipe', "plain", "", '"open" rest', ' "late"', "é中", '"long\n' + "text " * 60 + '"', '"",', '"tail""\n"']
    end = rng.choice(["\n", "\r\n"])
    rows = ["# made by hand, \"with a quote", "#", "Name, Two ,\"Three\""] + [",".join(rng.choice(cells) for _ in range(rng.choice([0, 1, 3, 3, 3, 4]))) for _ in range(n)]
    return end.join(rows) + rng.choice(["", end])


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, small_ranges, seed):
    text = wild_csv(random.Random(seed), 120)
    path = tmp_path / "wild.csv"
    path.write_bytes((b"\xef\xbb\xbf" if seed == 1 else b"") + text.encode())
    want = sorted((r.row, r.raw, r.header, r.cells) for r in files.read_rows(spark, str(path)).collect())
    got = by_range(spark, path)
    assert got == want and len(got) > 60
    assert spark.read.option("lineSep", "\n").text(str(path)).select("_metadata.file_block_start").distinct().count() > 20


def test_ranges_of_odd_files(spark, tmp_path, small_ranges):
    latin = "name,two\n" + "".join(f"café {i},\"a\nb\"\n" for i in range(40))
    for name, content in {"latin.csv": latin.encode("latin-1"), "nul.csv": b"a,b\n" + b"1,2\n" * 50 + b"\0,3\n", "head.csv": b"a,b\n", "open.csv": b'a,b\n1,"never closed\n' + b"2,3\n" * 60, "lone.csv": b"a,b\n1\r2,3\n4,5\n"}.items():
        (tmp_path / name).write_bytes(content)
    assert by_range(spark, tmp_path / "latin.csv") == sorted((r.row, r.raw, r.header, r.cells) for r in files.read_rows(spark, str(tmp_path / "latin.csv")).collect())
    assert [(r[0], r[3]) for r in by_range(spark, tmp_path / "nul.csv")] == [(0, None)]
    assert by_range(spark, tmp_path / "head.csv") == []
    (row,) = by_range(spark, tmp_path / "open.csv")
    assert row[0] == 2 and row[3][1].startswith("never closed\n2,3\n")
    assert [(r[0], r[3]) for r in by_range(spark, tmp_path / "lone.csv")] == [(2, None), (3, ["4", "5"])]
    many = read_rows_by_range(spark, [str(tmp_path / "latin.csv"), str(tmp_path / "head.csv"), str(tmp_path / "lone.csv")])
    assert {k.rsplit("/", 1)[1]: n for k, n in many.groupBy("path").count().collect()} == {"latin.csv": 40, "lone.csv": 2}


def test_a_row_too_long_for_one_task(spark, tmp_path, small_ranges, monkeypatch):
    from tallyframe.sources import lines

    monkeypatch.setattr(lines, "MOST_ROW_BYTES", 300)
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,"' + "x\n" * 400 + '"\n2,3\n')
    assert [(r[0], r[3]) for r in by_range(spark, path)] == [(2, None), (403, ["2", "3"])]


def test_ends_inside_is_the_csv_module():
    import csv

    rng = random.Random(4)
    for _ in range(4000):
        line = "".join(rng.choices('",ab', k=rng.randrange(12)))
        for inside in (False, True):
            text = ('"' if inside else "") + line
            # another line's cells are its own only if the first one is closed
            closed = len(list(csv.reader([text + "\n", "z\n"]))) == 2
            assert ends_inside(line.encode(), inside) == (not closed), (line, inside)


def test_numbers_and_sums_over_a_table(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(1000), i, rng.choice([None, 3, -7])) for i in range(5000)]
    table = spark.createDataFrame(rows, "a int, b int, v long").repartition(7)
    got = {(r.a, r.b): (r.at, r.total) for r in numbered(table, ["a", F.desc("b")], "at", 0, {"total": F.col("v")}).collect()}
    total, want = 0, {}
    for i, (a, b, v) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1]))):
        total += v or 0
        want[a, b] = (i, total)
    assert got == want
    assert numbered(table.limit(0), ["a"]).isEmpty()


def test_digest_follows_rows_and_order_not_partitions(spark):
    rows = [(i * 37 % 1000, f"t{i}", None if i % 3 else 1.5) for i in range(1000)]
    table = spark.createDataFrame(rows, "k int, t string, v double")
    digest = lambda df, fan=10: tuple(ordered_digest(df, ["k"], fan=fan).first())
    one = digest(table.repartition(1))
    assert one == digest(table.repartition(13)) and one[0] == 1000
    level = [hashlib.sha256("\x1f".join([str(k), t, "\x01" if v is None else str(v)]).encode()).hexdigest() for k, t, v in sorted(rows)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
    assert one[1] == level[0]
    assert digest(table.withColumn("t", F.when(F.col("k") == 5, "x").otherwise(F.col("t"))))[1] != one[1] != digest(table.where("k <> 7"))[1]
    assert digest(table.limit(0)) == (0, hashlib.sha256(b"").hexdigest()) and digest(table.where("k = 1"))[0] == 1


def test_emission_gives_the_same_bytes(spark, tmp_path):
    made = {}
    for turn, shuffles in (("one", "4"), ("two", "7")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        emit.emit_dataset(generate(spark, 300, seed=3), str(tmp_path / turn), 3)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        made[turn] = {n: (tmp_path / turn / n).read_bytes() for n in ("orders.csv", "psp.csv", "bank.csv", "psp_gst_invoice.csv", "truth.json")}
    assert made["one"] == made["two"]
    orders = made["one"]["orders.csv"].decode().splitlines()
    assert orders[0].startswith("order_id,") and orders[1:] == sorted(orders[1:]) and len(orders) > 600
    truth = json.loads(made["one"]["truth.json"])
    assert truth["record_count"] == len(orders) - 1 and truth["seed"] == 3
    assert [x["bank_line_id"] for x in truth["linkages"]] == sorted(x["bank_line_id"] for x in truth["linkages"])
    d = generate(spark, 300, seed=3)
    for name, table, df in (("orders.csv", "orders", d.orders), ("psp.csv", "psp", d.psp), ("psp_gst_invoice.csv", "invoice", d.invoices)):
        assert sorted(map(tuple, canonical.read(spark, str(tmp_path / "one" / name), table).collect()), key=str) == sorted(map(tuple, df.select(*canonical.SCHEMAS[table].names).collect()), key=str)
    at = emit.OPENING_BALANCE
    lines = [r.split(",") for r in made["one"]["bank.csv"].decode().splitlines()[1:]]
    assert lines == sorted(lines, key=lambda c: (c[1], c[0]))
    for c in lines:
        at += int(c[3] or 0) - int(c[4] or 0)
        assert int(c[5]) == at
    numbers = [int(re.search("[0-9]+", r)[0]) // (10 if re.match("pay_[0-9]", r) else 1) for r in made["one"]["psp.csv"].decode().splitlines()[1:]]
    assert numbers == sorted(numbers)
    links, traps = canonical.read_truth(spark, str(tmp_path / "one" / "truth.json"))
    legs = {r.settlement_id: set(r.txns) for r in d.psp.where("settlement_id is not null").groupBy("settlement_id").agg(F.collect_set("txn_id").alias("txns")).collect()}
    assert {(r.line_id, r.settlement_id, frozenset(r.txn_ids)) for r in links.collect()} == {(r.line_id, r.settlement_id, frozenset(legs[r.settlement_id])) for r in d.linkages.collect()}
    assert {r.line_id for r in traps.collect()} == {r.line_id for r in d.unresolvable.collect()} == set(truth["unresolvable_ids"])
    assert {x["defect_type"] for x in truth["injected_defects"] if not x["resolvable"]} == {"ambiguous_unresolvable"}


def test_emission_refuses_what_it_cannot_write(spark, tmp_path):
    d = generate(spark, 10)
    with pytest.raises(ValueError):
        emit.emit_dataset(type(d)(**{**vars(d), "bank": d.bank.withColumn("narration", F.lit("a,b"))}), str(tmp_path / "x"), 1)


def test_uploads_in_the_order_of_their_files(spark):
    import datetime as dt

    leg = lambda t: (t, "payment", None, dt.datetime(2026, 1, 1), 5, None, None)
    stored = [uploads.to_records(spark.createDataFrame([leg(t) for t in ids], PSP).withColumn("row", F.expr(f"array_position(array({','.join(map(repr, ids))}), txn_id)")), "psp_txn", org, F.lit(up), F.col("row")) for org, up, ids in (
        ("o", "u2", ["z", "a"]), ("o", "u1", ["m", "b", "c"]), ("o", "u3", ["k"]), ("other", "u1", ["x"]), ("o", "u4", ["q"]))]
    records = stored[0]
    for more in stored[1:]:
        records = records.unionByName(more)
    at = dt.datetime(2026, 2, 1)
    registry = spark.createDataFrame([("o", "u1", at), ("o", "u2", at), ("o", "u3", at - dt.timedelta(1)), ("o", "u4", at), ("other", "u1", at), ("o", "empty", at)], "org_id string, upload_id string, uploaded_at timestamp_ntz")
    for ids in (["u1", "u2", "u3", "no"], ["u3", "u2", "u1", "u1"]):
        got = [(r.ordinal, r.txn_id) for r in uploads.upload_inputs(records, registry, "o", ids, "psp_txn").orderBy("ordinal").collect()]
        assert got == list(enumerate(["k", "m", "b", "c", "z", "a"], 1))
    assert uploads.upload_inputs(records, registry, "o", ["u1"], "order").isEmpty()
    counts = {(r.org_id, r.upload_id): r.n_psp_txn for r in uploads.upload_counts(registry, records).collect()}
    assert counts[("o", "u1")] == 3 and counts[("o", "empty")] == 0 and counts[("other", "u1")] == 1


def test_lines_are_kept_apart(spark):
    import datetime as dt

    from tallyframe.sources.generate import separate

    rng, on = random.Random(8), dt.date(2026, 3, 1)
    rows = []
    for i in range(1200):
        posted = on + dt.timedelta(rng.randrange(400))
        rows.append((f"l{i:05d}", posted + dt.timedelta(rng.randrange(2)), 100 * rng.randrange(40), posted))
    reserved = [(on + dt.timedelta(k), 100 * k) for k in range(40)]
    shape = "line_id string, txn_date date, credit long, posted date"
    table, held = spark.createDataFrame(rows, shape), spark.createDataFrame(reserved, "txn_date date, credit long")
    got = {r.line_id: (r.txn_date, r.credit, r.posted) for r in separate(table, held).collect()}
    slots = [(d, c) for d, c, _ in got.values()]
    assert len(got) == 1200 == len(set(slots)) and not set(slots) & set(reserved)
    moved = 0
    for line, day, credit, posted in rows:
        new = got[line]
        assert new[1:] == (credit, posted) and (new[0] == day or 0 <= (new[0] - posted).days <= 2)
        moved += new[0] != day
    assert moved > 20
    # a line that nobody meets stays where it is
    first = {}
    for line, day, credit, _ in rows:
        first.setdefault((day, credit), []).append(line)
    assert all(got[x[0]][0] == slot[0] for slot, x in first.items() if len(x) == 1 and slot not in set(reserved))
    from pyspark.errors import PySparkException

    crowded = spark.createDataFrame([(f"x{i}", on, 5, on) for i in range(4)], shape)
    with pytest.raises(PySparkException, match="no free date"):
        separate(crowded, held).collect()


def test_generated_lines_are_apart(spark):
    d = generate(spark, 5000)
    traps = d.unresolvable.select("line_id")
    lines = d.bank.join(traps, "line_id", "left_anti").groupBy("txn_date", "credit").count().where("count > 1")
    mixed = d.bank.join(traps, "line_id").select("txn_date", "credit").join(d.bank.join(traps, "line_id", "left_anti"), ["txn_date", "credit"], "left_semi")
    assert lines.isEmpty() and mixed.isEmpty() and d.bank.count() == d.bank.select("line_id").distinct().count()


PRINTED = """# note
slice small finance bank
01 Apr '25 - 30 Apr '25
1/2
1 Apr '25 UPI-Debit-1-A-meeratexti
les99@examplebank-987654321012
1234567890123456 -₹85 ₹4,215.50
02 Apr '25 UPI-Credit from
 B 123456789012 ₹10.50 ₹4,226.00
page foot
03 Apr '25 held over the page\f01 Apr '25 - 30 Apr '25
2/2
999999 ₹1.00 ₹2.00
5 Apr '25 Interest Cr. for 04-Apr-2025 ₹0.35 ₹4,226.35
06 Apr '25 note that wraps
07 Apr '25 inside 777777 -₹1.35 ₹4,225.00
08 Apr '25 wrong balance 123456 ₹1.00 ₹9,999.00
09 Apr '25 goes on from there 123456 ₹1.00 ₹10,000.00
31 Feb '25 no such day ₹1.00 ₹1.00
10 Apr '25 bad money ₹1.0.0 ₹1.00
11 Apr '25 ₹5.00 ₹10,005.00
12 Apr '25 never
ends
at
all
here
or here
too late ₹1.00 ₹1.00
13 Apr '25 nothing moves ₹0.00 ₹10,005.00
"""


def test_printed_statement(spark, tmp_path):
    import datetime as dt

    from tallyframe.sources import adapters, statements

    path = tmp_path / "printed.txt"
    path.write_text(PRINTED)
    found, records, left = adapters.ingest(spark, str(path))
    assert found == "slice-pdf-v1"
    day = lambda n: dt.date(2025, 4, n)
    got = [(r.line_id, r.txn_date, r.narration, r.credit, r.debit, r.balance, r.utr) for r in records.orderBy("row").collect()]
    assert got == [
        ("SLICE-00005", day(1), "UPI-Debit-1-A-meeratextiles99@examplebank-987654321012 1234567890123456", None, 8500, 421550, None), ("SLICE-00008", day(2), "UPI-Credit from B", 1050, None, 422600, "123456789012"),
        ("SLICE-00015", day(5), "Interest Cr. for 04-Apr-2025", 35, None, 422635, None), ("SLICE-00016", day(6), "note that wraps07 Apr '25 inside 777777", None, 135, 422500, None), ("SLICE-00019", day(9), "goes on from there 123456", 100, None, 1_000_000, None),
    ]
    assert {r.row: r.reason for r in left.collect()} == {
        11: "TRUNCATED_ROW", 14: "TRUNCATED_ROW", 18: "ARITHMETIC_MISMATCH", 20: "BAD_DATE", 21: "BAD_DECIMAL", 22: "MISSING_VALUE", 23: "TRUNCATED_ROW", 30: "AMBIGUOUS_DIRECTION"}
    kinds = statements.statement_entries(spark, str(path)).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"row": 10, "broken": 3, "furniture": 7}


def test_printed_statements_of_many_pages(spark, tmp_path, small_ranges):
    """Pages over many ranges and two files: numbers and balances go on within a file and don't from one to the other."""
    from tallyframe.sources import statements

    pages, at, rows = [], 0, 0
    for p in range(30):
        lines = [f"{p + 1}/30"]
        for i in range(p % 4):
            at += 100 + i
            rows += 1
            lines += [f"{1 + i} Jan '25 row {p}", f"of {i} ₹{(100 + i) / 100:.2f} ₹{at / 100:.2f}"]
        pages.append("\n".join(lines))
    text = "\f".join(pages)
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(text)
    records, left = statements.parse_statement_text(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    got = sorted((r.path[-5:], r.row) for r in records.collect())
    numbered_lines = [i for i, x in enumerate(re.split("[\n\f]", text), 1) if "row" in x]
    assert got == [(name, i) for name in ("a.txt", "b.txt") for i in numbered_lines] and left.isEmpty() and rows == len(numbered_lines)


def test_exports_come_back_and_damage_is_found(spark, tmp_path):
    from tallyframe.sources import adapters

    d = generate(spark, 200, seed=5)
    rows = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    for dirty in (False, True):
        out = tmp_path / f"export-{dirty}"
        damage = emit.export_dataset(d, str(out), dirty)
        got = {name: adapters.ingest(spark, str(out / name)) for name in (emit.REPORT, emit.STATEMENT, emit.SHOP)}
        assert [got[n][0] for n in got] == ["razorpay-settlement-v2", "bank-csv-hdfc-v1", "orders-csv-shopify-v1"]
        assert rows(got[emit.SHOP][1], *canonical.SCHEMAS["orders"].names) == rows(d.orders, *canonical.SCHEMAS["orders"].names)
        assert rows(got[emit.REPORT][1], "txn_id", "txn_type", "order_id", "amount", "settlement_id", "settled_at") == rows(d.psp, "txn_id", "txn_type", "order_id", "amount", "settlement_id", "settled_at")
        assert rows(got[emit.STATEMENT][1], "line_id", "txn_date", "narration", "credit", "debit") == rows(d.bank, "line_id", "txn_date", "narration", "credit", "debit")
        left = sorted((n, r.reason) for n in got for r in got[n][2].collect())
        assert left == sorted((n, why) for n, why, _ in damage if why)
    assert (tmp_path / "export-True" / emit.SHOP).read_bytes() == b"\xef\xbb\xbf" + (tmp_path / "export-False" / emit.SHOP).read_bytes()
    statement = (tmp_path / "export-True" / emit.STATEMENT).read_bytes()
    with pytest.raises(UnicodeDecodeError):
        statement.decode("utf-8")
    assert statement.decode("latin-1").splitlines()[:-2] == (tmp_path / "export-False" / emit.STATEMENT).read_text().splitlines() and "CAFÉ" in statement.decode("latin-1")


def test_a_run_as_one_document(spark, tmp_path):
    from tallyframe.operators import matching as M

    d = generate(spark, 100)
    r = M.reconcile(d.orders, d.psp, d.bank)
    emit.write_result(r.matches, M.exceptions(r), M.audit(r), str(tmp_path / "parts"), 'run "1"', d.orders.count())
    emit.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "run.json"))
    made = json.loads((tmp_path / "run.json").read_text())
    assert made["run_id"] == 'run "1"' and made["record_count"] == d.orders.count()
    assert [m["line_id"] for m in made["matches"]] == sorted(x.line_id for x in r.matches.collect())
    assert len(made["exceptions"]) == M.exceptions(r).count() and len(made["audit"]) == M.audit(r).count()
    emit.write_result(r.matches.limit(0), M.exceptions(r).limit(0), M.audit(r).limit(0), str(tmp_path / "none"), "x", 0)
    emit.join_parts(spark, str(tmp_path / "none"), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"audit": [], "exceptions": [], "matches": [], "record_count": 0, "run_id": "x"}


def test_states_and_pages_of_uploads(spark):
    table = spark.createDataFrame([("o", "a", 1, 5, 0), ("o", "b", 2, 0, 3), ("o", "c", 2, 0, 0), ("p", "d", 9, 1, 1)], "org_id string, upload_id string, uploaded_at int, n int, bad int")
    assert {r.upload_id: r.s for r in table.select("upload_id", uploads.upload_state(F.col("n"), F.col("bad")).alias("s")).collect()} == {"a": "ingested", "b": "quarantined", "c": "empty", "d": "ingested"}
    assert [r.upload_id for r in uploads.uploads_page(table, "o", 0, 2).collect()] == ["c", "b"] and [r.upload_id for r in uploads.uploads_page(table, "o", 2, 2).collect()] == ["a"]
