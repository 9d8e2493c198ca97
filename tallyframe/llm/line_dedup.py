"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A window is the fewest lines from a line on, or up to a line, that have MIN_WORDS words together; its fingerprint is the
line of the least hash in it, and neighbouring windows mostly select the same. Any run of lines of so many words holds
such windows, so a repeated run repeats their fingerprints: a line that is selected at one place only can't be part of
one, and its windows are out. The other fingerprints are extended both ways to the ends of their windows, and a window
meets the first place of the same lines around the same fingerprint; so a common line never pairs all its places. Every
line of a repeated run lies in a window of it: what the windows of later places cover, merged to runs, is deleted.
Only hashes and positions of lines are shuffled until the texts are put together again; nothing is joined line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD_PATTERN, bounded, cut

#: Words that a repeated run has at least.
MIN_WORDS = 50
_DOC = ["doc_id", "text_key"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, h, words, ends) of each line that has words; ends counts the words up to its end."""
    split = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    slim = split.select(*_DOC, "at", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD_PATTERN)).cast("long").alias("words")).where("words > 0")
    once = slim.repartition(*map(F.col, _DOC)).dropDuplicates([*_DOC, "at"])
    return once.withColumn("ends", F.sum("words").over(Window.partitionBy(*_DOC).orderBy("at")))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, backward, first, last, least, least_at, c1, c2): every window, its fingerprint's hash and line, and two hashes of its lines.

    Backward windows that are windows from a line on too are left out.
    """
    along = Window.partitionBy(*_DOC)
    begins = lines.withColumn("begins", F.col("ends") - F.col("words"))

    def framed(frame, backward: bool) -> DataFrame:
        ends = {"first": F.min("at").over(frame), "last": F.col("at")} if backward else {"first": F.col("at"), "last": F.max("at").over(frame)}
        cols = {"held": F.sum("words").over(frame), "list": F.collect_list("h").over(frame), "low": F.min(F.struct("h", "at")).over(frame), **ends}
        found = begins.withColumns(cols).where(F.col("held") >= min_words)
        if backward:
            found = found.where(F.col("held") - F.col("words") >= min_words)
        return found.select(
            *_DOC, F.lit(backward).alias("backward"), "first", "last", F.col("low.h").alias("least"), F.col("low.at").alias("least_at"), F.xxhash64("list").alias("c1"), F.xxhash64(F.lit("again"), "list").alias("c2")
        )

    ahead = framed(along.orderBy("begins").rangeBetween(0, min_words - 1), False)
    return ahead.unionByName(framed(along.orderBy("ends").rangeBetween(1 - min_words, 0), True))


def fingerprints(wins: DataFrame) -> DataFrame:
    """(doc_id, text_key, backward, least, least_at): the places that windows select, each once."""
    return wins.select(*_DOC, "backward", "least", "least_at").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first, last): the lines, merged to runs, of windows that stand at an earlier place; places order by doc_id, text and line."""
    wins = cut(windows(_lines(docs), min_words))
    several = fingerprints(wins).groupBy("backward", "least").agg(F.count("*").alias("places")).where("places > 1").select("backward", "least")
    met = cut(wins.join(bounded(cut(several)), ["backward", "least"], "left_semi").drop("least_at"))
    origins = met.groupBy("c1", "c2").agg(F.count("*").alias("places"), F.min(F.struct(*_DOC, "first")).alias("origin")).where("places > 1").drop("places")
    later = met.join(origins, ["c1", "c2"]).where(F.struct(*_DOC, "first") > F.col("origin"))
    spans = later.groupBy(*_DOC, "first").agg(F.max("last").alias("last"))
    so_far = F.max("last").over(Window.partitionBy(*_DOC).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > so_far, F.lit(True)).cast("int")
    numbered = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(Window.partitionBy(*_DOC).orderBy("first")))
    return numbered.groupBy(*_DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row of docs, without the later of repeated runs of lines.

    Lines part at line feeds and are equal as they stand; lines without words belong to no run and stay. A null text
    has no lines and stays null. Rows with a null id are kept as they are and are no sources. Rows that repeat an id
    and a text lose the same lines; rows with one id and different texts order by a hash of the text. A text of any
    number of lines, repeated ones too, takes time in proportion (times its logarithm). Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeated_runs(slim.where("doc_id is not null"), min_words)
    gap = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy(*_DOC).orderBy("first")), F.lit(-1)) - 1
    gone = runs.withColumn("gap", gap).groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "gap", (F.col("last") - F.col("first") + 1).alias("long")))).alias("gone"))
    joined = slim.withColumn("text_key", F.xxhash64("text")).join(gone, _DOC, "left")
    # a mark for each line up to the last run's end
    marks = F.flatten(F.transform("gone", lambda r: F.concat(F.array_repeat(F.lit(False), r["gap"]), F.array_repeat(F.lit(True), r["long"]))))
    marked = F.zip_with(F.split("text", "\n"), marks, lambda line, mark: F.struct(line.alias("line"), (F.coalesce(mark, F.lit(False)) & line.rlike(WORD_PATTERN)).alias("out")))
    kept = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter(marked, lambda x: ~x["out"])))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))
    return kept.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_lines - F.size("kept")).cast("long").alias("n_removed"), text.alias("text"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), counted AS (
  SELECT doc_id, place, md5(line) AS h, CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM parts
), lines AS (
  SELECT *, row_number() OVER along AS seq, CAST(sum(words) OVER along AS BIGINT) - words AS before FROM counted WHERE words > 0 WINDOW along AS (PARTITION BY doc_id ORDER BY place)
), windows AS (
  SELECT doc_id, seq, sum(words) OVER ahead AS held, string_agg(h, '') OVER ahead AS content FROM lines
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), firsts AS (
  SELECT content, min({'d': doc_id, 's': seq}) AS s FROM windows WHERE held >= 50 GROUP BY content HAVING count(*) > 1
), pairs AS (
  SELECT DISTINCT w.doc_id, f.s.d AS s_doc, w.seq - f.s.s AS shift FROM windows w JOIN firsts f ON w.content = f.content
  WHERE w.held >= 50 AND (w.doc_id > f.s.d OR (w.doc_id = f.s.d AND w.seq > f.s.s))
), same AS (
  SELECT p.doc_id, p.s_doc, p.shift, l.place, l.seq, l.words, l.seq - row_number() OVER (PARTITION BY p.doc_id, p.s_doc, p.shift ORDER BY l.seq) AS run
  FROM pairs p JOIN lines l ON l.doc_id = p.doc_id JOIN lines s ON s.doc_id = p.s_doc AND s.seq = l.seq - p.shift AND s.h = l.h
), gone AS (
  SELECT DISTINCT doc_id, place FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, s_doc, shift, run) AS held FROM same) WHERE held >= 50
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(p.line, chr(10) ORDER BY p.place) FROM parts p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place WHERE p.doc_id = d.doc_id), '') END AS text
FROM documents d
"""
