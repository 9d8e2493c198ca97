"""Data sets as files in one fixed order: ordered part files, and their joining to one named file."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.ordinals import numbered
from tallyframe.sources.canonical import SCHEMAS
from tallyframe.sources.generate import Dataset

#: Fixed value: the balance before the first line of a statement, in paise.
OPENING_BALANCE = 50_000_000
_CSV = {"nullValue": "", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_COPY_BYTES = 1 << 20


def write_lines(blocks: list[tuple[DataFrame, Column, list]], path: str) -> None:
    """Text lines as a folder of part files whose order by name is the order of the lines.

    blocks follow each other; each is a table, its column of lines, and the order of its rows, of one shape in all blocks.
    """
    every = None
    for i, (df, line, order) in enumerate(blocks):
        own = df.select(F.lit(i).alias("block"), F.struct(*order).alias("key"), line.alias("value"))
        every = own if every is None else every.unionByName(own)
    every.repartitionByRange("block", "key").sortWithinPartitions("block", "key").select("value").write.mode("overwrite").text(path)


def _one(spark: SparkSession, text: str, key: T.StructType) -> tuple[DataFrame, Column, list]:
    """A block of one line."""
    return spark.createDataFrame([(text,)], "line string"), F.col("line"), [F.lit(None).cast(f.dataType).alias(f.name) for f in key]


def write_csv(df: DataFrame, path: str, table: str, order: list) -> None:
    """df as canonical CSV, header first, in the given order, as ordered part files without headers of their own."""
    cols = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in SCHEMAS[table]]
    key = df.select(*order).schema
    write_lines([_one(df.sparkSession, ",".join(SCHEMAS[table].names), key), (df, F.to_csv(F.struct(*cols), _CSV), order)], path)


def join_parts(spark: SparkSession, folder: str, file: str, head: bytes = b"") -> None:
    """head and the part files of a folder, in order, as one file under its name, which appears when it is whole. The bytes go through a buffer, never a whole part."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(file).getFileSystem(conf)
    parts = sorted((p for s in fs.listStatus(place(folder)) if (p := s.getPath()).getName().startswith("part-")), key=lambda p: (int(p.getName().split("-")[1].split(".")[0]), p.getName()))
    unready = place(f"{file}.unready")
    out = fs.create(unready, True)
    try:
        if head:
            out.write(bytearray(head))
        for part in parts:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, _COPY_BYTES, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(place(file), False)
    fs.rename(unready, place(file))


def chain_balances(bank: DataFrame, opening: int = OPENING_BALANCE) -> DataFrame:
    """bank in statement order (date, then id), each line with the balance after it."""
    moved = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    return numbered(bank, ["txn_date", "line_id"], "_n", running={"balance": moved}).withColumn("balance", F.col("balance") + F.lit(opening).cast("long")).select(*bank.columns)


def _json_list(df: DataFrame, value: Column, key: str) -> tuple[DataFrame, Column, list]:
    """The rows as entries of a JSON list, a line each; the last one by key has no comma."""
    last = df.agg(F.max(key)).first()[0]
    return df, F.concat(F.lit("    "), value, F.when(F.col(key) == F.lit(last), "").otherwise(",")), [F.col(key).cast("string").alias("key")]


def write_truth(d: Dataset, path: str, seed: int, record_count: int) -> None:
    """The known answers as one JSON document in ordered lines: linkages by line, defects, unresolvable ids."""
    spark, key = d.linkages.sparkSession, T.StructType([T.StructField("key", T.StringType())])
    line = lambda text: _one(spark, text, key)
    links = F.to_json(F.struct(F.col("line_id").alias("bank_line_id"), F.split("order_ids", ",").alias("order_ids"), F.col("txn_ids").alias("psp_txn_ids"), "settlement_id"))
    defects = d.defects.withColumn("key", F.concat_ws(" ", "defect_type", F.element_at("affected_ids", 1)))
    write_lines([
        line("{"), line('  "injected_defects": ['), _json_list(defects, F.to_json(F.struct("affected_ids", "defect_type", "resolvable")), "key"), line("  ],"), line('  "linkages": ['), _json_list(d.linkages, links, "line_id"),
        line("  ],"), line(f'  "record_count": {record_count},'), line(f'  "seed": {seed},'), line('  "unresolvable_ids": ['), _json_list(d.unresolvable.distinct(), F.to_json(F.array("line_id")).substr(F.lit(2), F.length(F.to_json(F.array("line_id"))) - 2), "line_id"), line("  ]"), line("}"),
    ], path)


def emit_dataset(d: Dataset, out: str, seed: int, whole: bool = True) -> None:
    """orders, psp, bank, psp_gst_invoice (csv) and truth (json) of a data set under out, each in its order: the same bytes in each run.

    Orders go by id, legs in order of their batches, the statement by date and id with its balances chained, invoices by
    period. whole: each is one named file; else a folder of ordered parts. A narration with a comma or a line feed is refused.
    """
    spark = d.orders.sparkSession
    if not d.bank.where(F.col("narration").rlike("[,\n]")).isEmpty():
        raise ValueError("a narration may not contain a comma or a line feed")
    number = F.regexp_extract("txn_id", "([0-9]+)", 1).cast("long")
    batch = F.when(F.col("txn_id").rlike("^pay_[0-9]"), F.call_function("div", number, F.lit(10).cast("long"))).otherwise(number)
    files = {"orders.csv": (d.orders, "orders", ["order_id"]), "psp.csv": (d.psp, "psp", [batch.alias("batch"), "txn_id"]), "bank.csv": (chain_balances(d.bank), "bank", ["txn_date", "line_id"]), "psp_gst_invoice.csv": (d.invoices, "invoice", ["period", "invoice_no"])}
    for name, (df, table, order) in files.items():
        write_csv(df, f"{out}/parts/{name}" if whole else f"{out}/{name}", table, order)
    write_truth(d, f"{out}/parts/truth.json" if whole else f"{out}/truth.json", seed, d.orders.count())
    if whole:
        for name in [*files, "truth.json"]:
            join_parts(spark, f"{out}/parts/{name}", f"{out}/{name}")


#: The files of an export, and the rows that a damaged one has more: a fraction of a paisa, a row cut short, a row in
#: another encoding that moves nothing.
REPORT, STATEMENT, SHOP = "settlement_report.csv", "bank_statement.csv", "orders_export.csv"
DIRTY_REPORT = ("pay_dirty1,payment,0.00,95.75,100.00,INR,0.00,4.255,2026-01-05 09:00:00,2026-01-05,setl_dirty,ORD-DIRTY",)
DIRTY_STATEMENT = ("05/01/26,NEFT CR SOFTWARE PVT LTD,BL-DIRTY-1", "06/01/26,NEFT CR CAFÉ RETAIL PVT LTD,BL-DIRTY-2,06/01/26,0.00,0.00,0.00")
#: (file, reason, detail) of each piece of damage; what has no reason must change nothing but the file's hash.
DAMAGE = (
    (REPORT, "BAD_DECIMAL", "a row whose tax is 4.255"), (STATEMENT, "TRUNCATED_ROW", "a row of three fields"), (STATEMENT, "AMBIGUOUS_DIRECTION", "a row that moves nothing, in Latin-1 as then the whole file is"), (SHOP, None, "a byte-order mark"),
)


def export_dataset(d: Dataset, out: str, dirty: bool = False) -> tuple[tuple[str, str | None, str], ...]:
    """A data set as the three files that a shop, a processor and a bank would give, each one file in a fixed order. dirty: damaged as DAMAGE says, which is returned.

    Reserves, which the processor's layout can't say, are an error.
    """
    from tallyframe.sources.export import to_processor, to_shop, to_statement

    spark = d.orders.sparkSession
    files = {
        REPORT: (to_processor(d.psp), ["entity_id"], DIRTY_REPORT), STATEMENT: (to_statement(chain_balances(d.bank)).withColumn("_on", F.to_date("Date", "dd/MM/yy")), ["_on", "`Chq./Ref.No.`"], DIRTY_STATEMENT), SHOP: (to_shop(d.orders), ["Name"], ()),
    }
    for name, (df, order, more) in files.items():
        names = [c for c in df.columns if c != "_on"]
        key = T.StructType([T.StructField("key", T.StringType())])
        placed = [F.concat_ws(" ", *(F.col(c) for c in order)).alias("key")]
        as_bytes = (lambda line: F.encode(line, "ISO-8859-1").cast("string")) if dirty and name == STATEMENT else (lambda line: line)
        blocks = [_one(spark, ",".join(names), key), (df, as_bytes(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in names)), _CSV)), placed)]
        if dirty:
            blocks += [(b[0], as_bytes(b[1]), b[2]) for b in (_one(spark, row, key) for row in more)]
        write_lines(blocks, f"{out}/parts/{name}")
        join_parts(spark, f"{out}/parts/{name}", f"{out}/{name}", b"\xef\xbb\xbf" if dirty and name == SHOP else b"")
    return DAMAGE if dirty else ()


def write_result(matches: DataFrame, exceptions: DataFrame, audit: DataFrame, path: str, run_id: str, record_count: int) -> None:
    """A run as one JSON document in ordered lines: its matches by line, exceptions by subject, audit in order."""
    from tallyframe.operators.digest import RUN_ORDER

    spark, key = matches.sparkSession, T.StructType([T.StructField("key", T.StringType())])
    line = lambda text: _one(spark, text, key)
    blocks = [line("{")]
    for name, df in (("audit", audit), ("exceptions", exceptions), ("matches", matches)):
        keyed = df.withColumn("key", F.concat_ws("\x1f", *(F.col(c).cast("string") for c in RUN_ORDER[name])))
        blocks += [line(f'  "{name}": ['), _json_list(keyed, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), "key"), line("  ],")]
    write_lines([*blocks, line(f'  "record_count": {record_count},'), line(f'  "run_id": {json.dumps(run_id)}'), line("}")], path)
