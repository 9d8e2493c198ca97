"""Canonical tables as files in real layouts; what a layout can't say is an error, not a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import rupees


def to_shop(orders: DataFrame) -> DataFrame:
    """Orders in the shop's layout."""
    status = F.when(F.col("status") == "cancelled", "voided").otherwise(F.col("status"))
    return orders.select(
        F.col("order_id").alias("Name"), F.col("customer_ref").alias("Email"), status.alias("Financial Status"), F.col("currency").alias("Currency"), rupees(F.col("gross_amount")).alias("Total"),
        F.date_format("order_date", "yyyy-MM-dd' 00:00:00 +0530'").alias("Created at"), F.lit("item").alias("Lineitem name"),
    )


def to_processor(psp: DataFrame) -> DataFrame:
    """Legs in the processor's layout, a row each; fees and taxes are rows of their own, and reserves can't be said."""
    kinds = {"payment": "payment", "refund": "refund", "adjustment": "adjustment", "chargeback": "dispute", "fee": "fee", "tax": "tax"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("txn_type")]
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("the layout has no type for "), F.col("txn_type"))).cast("string"))
    size, zero = rupees(F.abs("amount")), F.lit("0.00")
    return psp.select(
        F.col("txn_id").alias("entity_id"), kind.alias("type"), F.when(F.col("amount") < 0, size).otherwise(zero).alias("debit"), F.when(F.col("amount") >= 0, size).otherwise(zero).alias("credit"), size.alias("amount"), F.lit("INR").alias("currency"),
        zero.alias("fee (exclusive tax)"), zero.alias("tax"), F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.date_format("settled_at", "yyyy-MM-dd").alias("settled_at"), "settlement_id", F.col("order_id").alias("order_receipt"),
    )


def to_statement(bank: DataFrame) -> DataFrame:
    """Lines in the first bank layout; the line id is the reference."""
    return bank.select(
        F.date_format("txn_date", "dd/MM/yy").alias("Date"), F.col("narration").alias("Narration"), F.col("line_id").alias("Chq./Ref.No."), F.date_format("txn_date", "dd/MM/yy").alias("Value Dt"),
        rupees(F.coalesce("debit", F.lit(0).cast("long"))).alias("Withdrawal Amt."), rupees(F.coalesce("credit", F.lit(0).cast("long"))).alias("Deposit Amt."), rupees(F.col("balance")).alias("Closing Balance"),
    )


def write_layout(df: DataFrame, path: str) -> None:
    """df as CSV files with a header, nulls empty."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def as_rows(df: DataFrame, files: int = 64) -> DataFrame:
    """df as raw rows of sources.files, without writing it: what a reader of so many files of it would see."""
    from pyspark.sql import Window

    from tallyframe.sources.files import normalise_header

    names = df.columns
    cells = F.array(*(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names))
    first = F.col(f"`{names[0]}`")
    dealt = df.withColumn("_path", F.concat(F.lit("memory-"), F.pmod(F.xxhash64(first), F.lit(files))))
    return dealt.select(
        F.col("_path").alias("path"), F.lit(None).cast("string").alias("file_sha256"), (F.row_number().over(Window.partitionBy("_path").orderBy(first)) + 1).alias("row"),
        F.array_join(cells, ",").alias("raw"), F.array(*(F.lit(normalise_header(n)) for n in names)).alias("header"), cells.alias("cells"),
    )
