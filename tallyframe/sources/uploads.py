"""Uploaded records in a store, and the inputs of a run over several uploads in the order in which their files had them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ordinals import numbered
from tallyframe.types import BANK, ORDERS, PSP

#: Types of stored records and their tables.
RECORD_TYPES = {"order": ORDERS, "psp_txn": PSP, "bank_line": BANK}
_STORED = {"ignoreNullFields": "false"}


def to_records(df: DataFrame, record_type: str, org_id: str, upload_id: Column, row: Column) -> DataFrame:
    """(org_id, upload_id, record_type, row, payload): canonical rows as stored records; row is the place in the file."""
    fields = RECORD_TYPES[record_type].names
    return df.select(F.lit(org_id).alias("org_id"), upload_id.alias("upload_id"), F.lit(record_type).alias("record_type"), row.cast("long").alias("row"), F.to_json(F.struct(*fields), _STORED).alias("payload"))


def upload_inputs(records: DataFrame, uploads: DataFrame, org_id: str, upload_ids: list[str], record_type: str) -> DataFrame:
    """The canonical rows of one type of a tenant's uploads, numbered (ordinal, from 1) in order of the time of upload, its id, and the row in the file.

    uploads: (org_id, upload_id, uploaded_at). The order in which upload_ids are named doesn't matter, repeated ones count
    once, and those that the tenant doesn't have give nothing.
    """
    mine = uploads.where(F.col("org_id") == org_id).where(F.col("upload_id").isin(*upload_ids)).select("upload_id", "uploaded_at")
    rows = records.where((F.col("org_id") == org_id) & (F.col("record_type") == record_type)).join(F.broadcast(mine), "upload_id")
    placed = numbered(rows.select("uploaded_at", "upload_id", "row", "payload"), ["uploaded_at", "upload_id", "row"])
    return placed.select("ordinal", "upload_id", "row", F.from_json("payload", RECORD_TYPES[record_type]).alias("r")).select("ordinal", "upload_id", "row", "r.*")


def upload_counts(uploads: DataFrame, records: DataFrame) -> DataFrame:
    """Every upload with how many records of each type it has, zeros too."""
    counts = records.groupBy("org_id", "upload_id").agg(*(F.count_if(F.col("record_type") == t).alias(f"n_{t}") for t in RECORD_TYPES))
    return uploads.join(counts, ["org_id", "upload_id"], "left").select(*uploads.columns, *(F.coalesce(f"n_{t}", F.lit(0)).cast("long").alias(f"n_{t}") for t in RECORD_TYPES))


def upload_state(n_records: Column, n_quarantined: Column) -> Column:
    """What became of a file: ingested if it gave any record, else quarantined if it gave any bad row, else empty."""
    return F.when(n_records > 0, "ingested").when(n_quarantined > 0, "quarantined").otherwise("empty")


def uploads_page(uploads: DataFrame, org_id: str, offset: int, limit: int) -> DataFrame:
    """A page of a tenant's uploads, newest first."""
    return uploads.where(F.col("org_id") == org_id).orderBy(F.desc("uploaded_at"), F.desc("upload_id")).offset(offset).limit(limit)
