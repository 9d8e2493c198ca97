"""Fill-in-middle transformation by escaped marker injection, with DataFrame functions only.

A delimiter that the text's own characters can't form (they are escaped) goes behind each unit, which is a code point,
by one regexp_replace. The delimiters count the units, and substring_index takes the parts that stand before, between
and after two of them by rank; unescaped, the parts are assembled around the markers. One scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that stay plain, and of the others that have the suffix first.
PLAIN, SPM = 10, 20
SEED = "1"
#: The delimiter, the escape, and what stands for either behind an escape.
_MARK, _ESCAPE, _FOR_MARK, _FOR_ESCAPE = "\x1f", "\x1e", "m", "e"
#: A unit of an escaped text: an escaped character or any other one.
_UNIT = f"(?s){_ESCAPE}[{_FOR_MARK}{_FOR_ESCAPE}]|."


def marked(text: Column) -> Column:
    """text, escaped, with a delimiter behind each code point."""
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _FOR_ESCAPE)), F.lit(_MARK), F.lit(_ESCAPE + _FOR_MARK))
    return F.regexp_replace(escaped, _UNIT, f"$0{_MARK}")


def units(marks: Column) -> Column:
    """The number of delimiters."""
    return (F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit(_MARK), F.lit("")))).cast("long")


def plain_text(part: Column) -> Column:
    """A part of a marked text as it stood."""
    bare = F.replace(part, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + _FOR_MARK), F.lit(_MARK)), F.lit(_ESCAPE + _FOR_ESCAPE), F.lit(_ESCAPE))


def ranked_part(marks: Column, begin: Column, end: Column, n: Column) -> Column:
    """The units from begin (from 0) up to end of a marked text of n units."""
    upto = F.call_function("substring_index", marks, F.lit(_MARK), end.cast("int"))
    # a text up to its end has its last delimiter, one up to another unit has not
    return plain_text(F.call_function("substring_index", F.when(end >= n, marks).otherwise(F.concat(upto, F.when(end > 0, F.lit(_MARK)).otherwise(""))), F.lit(_MARK), (begin - end - 1).cast("int")))


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the hex sha256 of seed, colon and decimal id; a null id is the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text, output) of every row of docs.

    n counts the text's code points. form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain. Plain,
    with output the text itself, are empty and null texts, texts that hold a marker, and plain per cent of the rest.
    Places of the cuts and the form follow from the id alone, so reruns agree and repeated ids are cut at the same
    draws. Delimiter and escape characters in a text are text like any other. Other columns are ignored.
    """
    one, two, three, four = draws(F.col("doc_id"), seed)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = slim.withColumn("marks", marked(F.col("text"))).withColumn("n", units(F.col("marks")))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | held | (three % 100 >= 100 - plain), "plain").when(four % 100 < spm, "spm").otherwise("psm")
    x, y = one % (F.col("n") + 1), two % (F.col("n") + 1)
    placed = counted.withColumns({"form": form, "a": F.least(x, y), "b": F.greatest(x, y)})
    part = lambda begin, end: ranked_part(F.col("marks"), begin, end, F.col("n"))
    prefix, middle, suffix = part(F.lit(0).cast("long"), F.col("a")), part(F.col("a"), F.col("b")), part(F.col("b"), F.col("n"))
    parts = placed.withColumn("parts", F.when(F.col("form") != "plain", F.array(prefix, middle, suffix)))
    at = lambda i: F.col("parts")[i]
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), at(0), F.lit(SUFFIX), at(2), F.lit(MIDDLE), at(1)))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), at(2), F.lit(PREFIX), at(0), F.lit(MIDDLE), at(1))).otherwise(F.col("text"))
    )
    cut_up = F.col("form") != "plain"
    return parts.select("doc_id", "n", "form", F.when(cut_up, F.col("a")).alias("prefix_chars"), F.when(cut_up, F.col("b") - F.col("a")).alias("middle_chars"), "text", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that output and form came from. Texts that hold a marker are plain, so the markers found are the ones put in."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of fill_in_middle()."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS u, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS v FROM drawn
), formed AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
