"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most a multiple of its own words; what that leaves over is
shared again by weight. Whole copies that a target surely holds are taken of every document. The rest is a sample of
fixed size in words: documents rank by random odds divided by the odds of their inclusion, and the first ones are
taken until the words reach the target. Inclusion is unequal: it grows with the square root of a document's words.
Only per-source sums, and sums by range of rank, are gathered; the ranks of one narrow range find the exact cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD_PATTERN, bounded, cut

#: Weights of the sources by code point, repeating; nulls come last.
WEIGHTS = (5, 2, 1)
#: No source, and no document, gives more than so many times its words.
MOST = 3
#: Ranges of rank for which words are summed.
RANGES = 16384
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1 from the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, pull, target) from (source, size); one row for each source, and so few rows in all."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.floor(F.sqrt("size")).cast("long")).alias("pull"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*map(F.lit, weights))
    ranked = sums.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.get(picks, F.col("rank") % len(weights)).cast("long"))
    capped = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap").cast("double") / F.col("weight").cast("double"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    levelled = capped.withColumn("level", level)
    levelled = levelled.withColumn("top", F.max("level").over(everything))
    return levelled.select("source", "source_size", "pull", F.when(F.col("full_at") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("top")).alias("target"))


def _odds(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """sized with its source's columns, whole copies, what is left of the target, the rank q and its range."""
    joined = sized.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    chance = F.when(F.col("pull") > 0, F.col("rest") * F.floor(F.sqrt("size")).cast("long") / F.col("pull")).otherwise(0.0)
    u = _uniform(F.col("doc_id"), seed)
    joined = joined.withColumn("chance", F.least(F.lit(1.0), chance)).withColumn("u", u)
    q = F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))))
    joined = joined.withColumn("q", q)
    return joined.withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("q") / (1 + F.col("q")) * RANGES)).cast("int"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix as one row for each source: target, and the last rank (cut_q, cut_id) that is taken once more. sized: (doc_id, source, size)."""
    sources = cut(source_targets(sized, weights, most))
    ranked = _odds(sized, bounded(sources), seed).where("q is not null")
    sums = ranked.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range")
    edge = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).where("before < rest and before + words >= rest")
    edge = cut(edge.select(F.col("source").alias("its_source"), F.col("range").alias("edge"), "before"))
    inside = ranked.join(bounded(edge), F.col("source").eqNullSafe(F.col("its_source")) & (F.col("range") == F.col("edge"))).withColumn("order_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    along = Window.partitionBy("source").orderBy("q", "order_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("source", "q", "order_id")
    placed = inside.withColumn("own", F.sum("size").over(alike)).withColumn("upto", F.col("before") + F.sum("size").over(along) - F.col("own"))
    taken = placed.where(F.col("upto") + F.col("own") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max(F.struct("q", "order_id")).alias("last")).select(F.col("source").alias("last_source"), F.col("last.q").alias("cut_q"), F.col("last.order_id").alias("cut_id"))
    edges = edge.join(last, F.col("its_source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    return cut(sources.join(edges, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source", "before"))


def apply(sized: DataFrame, mix: DataFrame, seed: str = SEED) -> DataFrame:
    """sized with source_size, target and copies, the times that the mix takes each row. No shuffle where the sources are few."""
    ranked = _odds(sized, bounded(mix), seed)
    order_id = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    more = F.when(F.col("q").isNull() | F.col("edge").isNull(), F.lit(False)).when(F.col("range") < F.col("edge"), True).when(F.col("range") > F.col("edge"), False)
    more = more.otherwise(F.coalesce((F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (order_id <= F.col("cut_id"))), F.lit(False)))
    ranked = ranked.withColumn("copies", F.col("whole") + more.cast("long"))
    return ranked.drop("pull", "whole", "rest", "chance", "u", "q", "range", "edge", "cut_q", "cut_id")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    A null text has size 0 and gives nothing. A null source is a source of its own, last in order; a null id ranks by
    the word null. Rows with one id and source rank together and are taken or left together. An empty table gives an
    empty result, and a source of no words a target of 0. Other columns are ignored. Reruns agree.
    """
    sized = cut(sizes(docs))
    return apply(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    made = plan(cut(sizes(docs)))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    copies = apply(whole, made).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * CAST(floor(sqrt(size)) AS BIGINT)) AS BIGINT) AS pull FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums
), capped AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM ranked
), filled AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS full_at FROM capped
), levelled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM filled WINDOW before AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, CASE WHEN full_at <= level THEN CAST(cap AS DOUBLE) ELSE weight * max(level) OVER () END AS target FROM levelled
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), chances AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS rest,
    CASE WHEN s.pull > 0 THEN least(1.0::DOUBLE, (s.target - s.whole * s.source_size) * CAST(floor(sqrt(d.size)) AS BIGINT) / s.pull) ELSE 0 END AS chance,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), odds AS (
  SELECT *, CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM chances
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, q, doc_id) AS own FROM odds
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN q IS NOT NULL AND upto - own / 2::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""
