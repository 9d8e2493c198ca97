"""Band joins as equi-joins: values within a tolerance, dates within a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: int, condition: Column | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left and right whose values differ by at most tolerance, and whose columns on are equal.

    Each left row goes to the one or two buckets, wider than the band, that its band touches, and meets the right rows
    of those buckets by equality; a right row is in one bucket, so no pair is made twice.
    """
    width = max(1, 2 * tolerance + 1)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    touched = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(left_value) - tolerance), bucket(F.col(left_value) + tolerance))))
    kept = right.withColumn("_bucket", bucket(F.col(right_value)))
    pairs = touched.join(kept, ["_bucket", *on]).where(F.abs(F.col(left_value) - F.col(right_value)) <= tolerance)
    return (pairs if condition is None else pairs.where(condition)).drop("_bucket")


def date_window_semi(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int) -> DataFrame:
    """Rows of left with a right date at most so many days away; nulls never match."""
    near = right.where(F.col(right_date).isNotNull()).select(right_date).distinct().select(F.explode(F.sequence(F.date_sub(right_date, days), F.date_add(right_date, days))).alias("_day")).distinct()
    return left.join(near, F.col(left_date) == F.col("_day"), "left_semi")
