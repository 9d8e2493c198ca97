"""Dense numbers and running sums over a whole table in a total order, without a window over the table.

A range partition puts the table in order; each partition counts its rows and sums its values; the sums of the partitions
before it, a row for each partition, are added to what a row's place in its own partition says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.lineage import stored

#: monotonically_increasing_id() has the row's place in its partition in so many low bits.
_PLACE_BITS = 33
#: Keys whose first numbers may be broadcast.
_FEW_KEYS = 100_000


def numbered(df: DataFrame, order: list, name: str = "ordinal", start: int = 1, running: dict[str, Column] | None = None) -> DataFrame:
    """df with name, the row's number from start in the order of the columns (nulls first), and for each of running the sum of the values up to the row.

    The order must be total for the numbers to be the same in each run; equal rows are numbered in any order. Null values
    add nothing. An empty table gives an empty one.
    """
    sums = running or {}
    placed = df.withColumns({f"_v_{k}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in sums.items()})
    placed = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    before = lambda c, to: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(to)
    joined = placed.join(F.broadcast(counts.select("_part", before("_n", "_n"), *(before(f"_s_{k}", f"_s_{k}") for k in sums))), "_part")
    along = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.lit(start).cast("long")
    return joined.select(*(c for c in df.columns if c not in sums and c != name), number.alias(name), *((F.col(f"_s_{k}") + F.sum(f"_v_{k}").over(along)).alias(k) for k in sums))


def numbered_within(df: DataFrame, key: list[str], order: list, name: str = "row") -> DataFrame:
    """df with name, the row's number from 1 within its key in the order of the columns, for keys with any number of rows: no key has to fit a task.

    Numbers of the whole table, less what came before the key's first row.
    """
    every = numbered(df, [*key, *order], "_number")
    starts = stored(every.groupBy(*key).agg(F.min("_number").alias("_start")))
    # few keys have many rows each, so they go to the rows; many are joined by shuffles
    starts = F.broadcast(starts) if starts.count() <= _FEW_KEYS else starts
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    return every.alias("e").join(starts.alias("s"), same).select(*(F.col(f"e.{c}") for c in df.columns if c != name), (F.col("_number") - F.col("_start") + 1).alias(name))
