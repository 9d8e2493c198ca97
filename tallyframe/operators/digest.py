"""A digest of an ordered table that doesn't depend on how its rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ordinals import numbered

#: Digests that one digest of the next level is made of.
FAN = 1024
#: What stands between the fields of a row, and for a null.
BETWEEN, NULL = "\x1f", "\x01"


def row_text(columns: list[str]) -> Column:
    """A row as one text."""
    return F.concat_ws(BETWEEN, *(F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns))


def ordered_digest(df: DataFrame, order: list[str], columns: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """One row (n, digest) of df in the order of columns that make it total.

    Rows are hashed, numbered, and hashed again in blocks of fan consecutive numbers, level by level until one is left.
    A block's number follows from the rows' order alone, so blocks of any partition can be merged; a changed, missing or
    additional row changes the digest. An empty table's is that of no text.
    """
    level = numbered(df.select(*order, F.sha2(row_text(columns or df.columns), 256).alias("_sha")), order, "_i", 0).select("_i", "_sha")
    n = left = level.count()
    while left > 1 or left == n > 0:
        blocks = level.groupBy(F.floor(F.col("_i") / fan).cast("long").alias("_i"))
        level = blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), "_sha"))), lambda x: x["_sha"]), ""), 256).alias("_sha"))
        left = -(-left // fan)
        if left == 1:
            break
    return level.agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.max("_sha"), F.sha2(F.lit(""), 256)).alias("digest"))


#: In which order the tables of a run are read.
RUN_ORDER = {"matches": ["line_id"], "exceptions": ["subject_type", "subject_id"], "audit": ["phase", "stage", "rule", "subject_id", "evidence"]}


def run_digest(matches: DataFrame, exceptions: DataFrame, audit: DataFrame) -> DataFrame:
    """(part, n, digest) of a run's matches, exceptions and audit, and of the run, which is that of the three together."""
    parts = [ordered_digest(t, RUN_ORDER[k]).select(F.lit(k).alias("part"), "n", "digest") for k, t in (("matches", matches), ("exceptions", exceptions), ("audit", audit))]
    three = parts[0].unionByName(parts[1]).unionByName(parts[2])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "digest"))), lambda x: F.concat_ws(" ", x["part"], x["n"].cast("string"), x["digest"])), ",")
    return three.unionByName(three.agg(F.lit("run").alias("part"), F.sum("n").alias("n"), F.sha2(text, 256).alias("digest")))
