"""Strict readers of canonical CSV files, and their writers. Any row that isn't exactly right stops the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.money import strict_long
from tallyframe.types import BANK, CURRENCY, INVOICE, ORDER_STATUSES, ORDERS, PSP, TXN_TYPES

#: Which columns may be empty, and which hold one of a few words.
OPTIONAL = {"psp": ("order_id", "settlement_id", "settled_at"), "bank": ("credit", "debit", "utr")}
WORDS = {"status": ORDER_STATUSES, "txn_type": TXN_TYPES, "currency": (CURRENCY,)}
UNSIGNED = ("credit", "debit")
VERBATIM = ("narration",)
SCHEMAS = {"orders": ORDERS, "psp": PSP, "bank": BANK, "invoice": INVOICE}


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in first[0].value.lstrip("﻿").split(",")] if first else []


def _checked(raw: Column, name: str, kind: T.DataType, table: str) -> Column:
    """A cell as its type; an empty one is null where that is allowed. Amounts are a sign and digits only."""
    text = raw if name in VERBATIM else F.nullif(F.trim(raw), F.lit(""))
    fail = lambda why: F.raise_error(F.format_string(f"{table}.{name}: {why}: %s", F.coalesce(raw, F.lit(""))))
    if isinstance(kind, T.LongType):
        value = strict_long(text)
        value = F.when(value < 0, fail("is signed").cast("long")).otherwise(value) if name in UNSIGNED else value
    elif isinstance(kind, T.DateType):
        value = F.try_to_date(text, "yyyy-MM-dd")
    elif isinstance(kind, T.TimestampNTZType):
        value = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")
    else:
        value = F.when(text.isin(*WORDS[name]), text) if name in WORDS else text
    absent = text.isNull()
    if name not in OPTIONAL.get(table, ()):
        value = F.when(absent, fail("is missing").cast(kind)).otherwise(value)
    return F.when(~absent & value.isNull(), fail("isn't valid").cast(kind)).otherwise(value).alias(name)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A canonical file: orders, psp, bank, or invoice. The header must contain the columns (an invoice's must be them, in order); others are ignored."""
    schema, names = SCHEMAS[table], header(spark, path)
    missing = [f.name for f in schema if f.name not in names]
    if missing or (table == "invoice" and names != schema.names):
        raise ValueError(f"{path}: header of a {table} file expected, {missing or names} differ")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, schema=text, header=True, multiLine=True, escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True, emptyValue="")
    return rows.select(*(_checked(F.col(f"`{f.name}`"), f.name, f.dataType, table) for f in schema))


def read_optional(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """As read(); None where there is no such file, which isn't the same as an empty one."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path, table) if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place) else None


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(linkages: line_id, settlement_id, order_ids, txn_ids; unresolvable: line_id) of a truth file."""
    shape = "linkages array<struct<bank_line_id:string,settlement_id:string,psp_txn_ids:array<string>,order_ids:array<string>>>, unresolvable_ids array<string>"
    doc = spark.read.schema(shape).json(path, multiLine=True)
    links = doc.select(F.explode("linkages").alias("l")).select(F.col("l.bank_line_id").alias("line_id"), "l.settlement_id", F.array_join("l.order_ids", ",").alias("order_ids"), F.col("l.psp_txn_ids").alias("txn_ids"))
    return links, doc.select(F.explode("unresolvable_ids").alias("line_id"))


def write(df: DataFrame, path: str, table: str) -> None:
    """df as canonical CSV: nulls empty, ISO dates."""
    cols = [F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in SCHEMAS[table]]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def save_run(df: DataFrame, base: str, name: str, org_id: str, run_id: str) -> None:
    """A table of a run, partitioned by tenant and run; saving a run again replaces that run alone."""
    keyed = df.withColumns({"org_id": F.lit(org_id), "run_id": F.lit(run_id)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org_id", "run_id").parquet(f"{base}/{name}")


def load_runs(spark: SparkSession, base: str, name: str, org_id: str) -> DataFrame:
    """A table of all runs of one tenant."""
    return spark.read.parquet(f"{base}/{name}").where(F.col("org_id") == org_id)
