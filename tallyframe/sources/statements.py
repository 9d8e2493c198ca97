"""Bank statements that aren't tables: tagged messages (MT940) and the text layer of a printed statement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import parse_comma_amount, parse_date, parse_paise
from tallyframe.operators.lineage import cut
from tallyframe.operators.ordinals import numbered
from tallyframe.sources.files import decode, without_comments

#: The grammar of a statement line and of a balance.
LINE = r"^([0-9]{6})([0-9]{4})?(RC|RD|C|D)([A-Za-z])?([0-9][0-9,]*)([A-Z][A-Za-z0-9]{3})(.*)$"
BALANCE = r"^([CD])([0-9]{6})([A-Za-z]{3})([0-9][0-9,]*)$"
TAG = re.compile(r"^:(\d{2}[A-Z]?):(.*)$")
QUARANTINE = ["path", "file_sha256", "row", "raw", "format_id", "reason"]


def is_mt940(text: str) -> float:
    """How many of the message's tags are there, as a confidence."""
    tags = {m[1] for line in text.splitlines() if (m := TAG.match(line))}
    need = [{"20"}, {"60F", "60M"}, {"61"}]
    return 0.0 if not all(tags & n for n in need) else 0.7 + 0.1 * len(tags & {"25", "28C", "86"})


def is_statement_text(text: str) -> float:
    """Dated lines with rupee amounts at their end."""
    dated = len(re.findall(r"(?m)^\d{1,2} [A-Z][a-z]{2} '\d{2}\b", text))
    money = len(re.findall(r"-?₹[\d,]+(?:\.\d{1,2})?\s+-?₹[\d,]+(?:\.\d{1,2})?\s*$", text, re.M))
    return 0.95 if dated >= 1 and money >= 1 else 0.0


def _tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tag blocks with their statement's number in the file; lines that don't begin with a tag continue the one before."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            body, skipped = without_comments(decode(content) or "")
            out, statement = [], 0
            for i, line in enumerate(body.splitlines(), skipped + 1):
                if m := TAG.match(line):
                    statement += m[1] == "20"
                    out.append([path, statement, i, m[1], m[2]])
                elif out and line.strip() not in ("", "-"):
                    out[-1][4] += "\n" + line
            yield pd.DataFrame(out, columns=["path", "statement", "row", "tag", "content"])


def parse_mt940(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine). A statement with one bad line, or whose opening and lines don't make its closing, gives no records at all."""
    tags = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_tags, "path string, statement int, row int, tag string, content string")
    by_row = Window.partitionBy("path", "statement").orderBy("row")
    head = F.element_at(F.split("content", "\n"), 1)
    part = lambda i, pattern=LINE: F.regexp_extract(head, pattern, i)
    info = F.when(F.lead("tag").over(by_row) == "86", F.lead("content").over(by_row))
    lines = tags.withColumn("info", info).where("tag = '61'")
    amount = parse_comma_amount(part(5))
    signed = F.when(part(3).isin("C", "RD"), amount).otherwise(-amount)
    when = parse_date(part(1), "yyMMdd")
    reason = F.when(~head.rlike(LINE), "BAD_STATEMENT_LINE").when(when.isNull(), "BAD_DATE").when(amount.isNull(), "BAD_DECIMAL").when(amount == 0, "AMBIGUOUS_DIRECTION")
    judged = lines.withColumns({"reason": reason, "moved": signed, "on": when, "reference": F.nullif(F.regexp_extract(part(7), r"//(.*)$", 1), F.lit(""))})
    repeated = F.row_number().over(Window.partitionBy("path", "statement", "content").orderBy("row"))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (repeated > 1) & F.col("reference").isNotNull(), "DUPLICATE_ROW").otherwise(F.col("reason")))
    worth = lambda: F.when(F.regexp_extract("content", BALANCE, 1) == "D", -parse_comma_amount(F.regexp_extract("content", BALANCE, 4))).otherwise(parse_comma_amount(F.regexp_extract("content", BALANCE, 4)))
    ends = tags.where(F.col("tag").isin("60F", "60M", "62F", "62M")).groupBy("path", "statement").agg(
        F.min(F.when(F.col("tag").startswith("60"), F.struct("row", worth().alias("v"))))["v"].alias("opening"), F.max(F.when(F.col("tag").startswith("62"), F.struct("row", worth().alias("v"))))["v"].alias("closing"))
    sums = judged.groupBy("path", "statement").agg(F.sum("moved").alias("moved_all"), F.count("reason").alias("bad"))
    state = ends.join(sums, ["path", "statement"], "full").withColumn("whole", (F.coalesce("bad", F.lit(0)) == 0) & F.coalesce(F.col("opening") + F.coalesce("moved_all", F.lit(0)) == F.col("closing"), F.lit(False)))
    full = judged.join(state.select("path", "statement", "opening", "whole"), ["path", "statement"])
    good = full.where("whole").withColumn("running", F.col("opening") + F.sum("moved").over(by_row)).withColumn("n", F.row_number().over(by_row))
    text = F.trim(F.regexp_replace(F.coalesce("info", "content"), r"\s*\n\s*", " "))
    marked = F.nullif(F.regexp_extract(text, r"(?i)\bUTR[:\s-]*([A-Za-z0-9]{6,22})\b", 1), F.lit(""))
    records = good.select(
        "path", "row", F.format_string("MT940-%02d-%05d", "statement", "n").alias("line_id"), F.col("on").alias("txn_date"), text.alias("narration"), F.when(F.col("moved") > 0, F.col("moved")).alias("credit"), F.when(F.col("moved") < 0, -F.col("moved")).alias("debit"),
        F.col("running").alias("balance"), F.coalesce(F.when(F.col("reference").rlike(r"^(?=.*[0-9])[A-Za-z0-9]{6,22}$"), F.col("reference")), marked).alias("utr"),
    )
    left = full.where("not whole").select("path", F.lit(None).cast("string").alias("file_sha256"), "row", F.col("content").alias("raw"), F.lit("mt940-v1").alias("format_id"), F.coalesce("reason", F.lit("STATEMENT_REJECTED")).alias("reason"))
    return records, left


#: How a row of a printed statement begins and ends, what is a page's furniture, and the lines a row may take.
_START = re.compile(r"^(\d{1,2} [A-Z][a-z]{2} '\d{2})\b")
_FURNITURE = re.compile(r"^\d{1,2} [A-Z][a-z]{2} '\d{2}\s*-\s*\d{1,2} [A-Z][a-z]{2} '\d{2}\s*$|^\d{1,3}\s*/\s*\d{1,3}\s*$")
_END = re.compile(r"(?:(?<=\s)|^)(?:(\d{6,})\s+)?(-?)₹(\S+)\s+₹(\S+)\s*$")
_END_ONLY = re.compile(r"^\s*(?:\d{6,}\s+)?-?₹\S+\s+₹\S+\s*$")
MOST_LINES = 6
_ENTRY = "path string, kind string, row long, raw string, day string, narration string, ref string, sign string, amount string, claimed string"


def page_entries(page: str, before: int) -> Iterator[tuple]:
    """(kind, row, raw, day, narration, ref, sign, amount, claimed) of a page whose first line has the number before + 1.

    kind is row, broken (a row that never ends, or an end without a begin) or furniture. A row begins at a date, when none is
    open, and ends at once where its lines have amount and balance. A line is glued to the one before it, as rows wrap
    inside words; one that is only the end of a row is a column of its own. Rows don't go on on the next page.
    """
    nothing, held, joined, start = (None,) * 6, [], "", 0
    for row, line in enumerate(page.split("\n"), before + 1):
        line = line.rstrip()
        if not line:
            continue
        ending = _END_ONLY.match(line)
        if _FURNITURE.match(line) or not (held or ending or _START.match(line)):
            yield ("furniture", row, line, *nothing)
        elif not held and not _START.match(line):
            yield ("broken", row, line, *nothing)
        else:
            start, joined = (start, joined + (" " if ending else "") + line) if held else (row, line)
            held.append(line)
            if end := _END.search(joined):
                day = _START.match(joined)
                yield ("row", start, "\n".join(held), day[1], joined[day.end() : end.start()].strip(), *end.groups())
                held = []
            elif len(held) >= MOST_LINES:
                yield ("broken", start, "\n".join(held), *nothing)
                held = []
    if held:
        yield ("broken", start, "\n".join(held), *nothing)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, page, before, latin in zip(batch["path"], batch["page"], batch["before"], batch["latin"], strict=True):
            text, dropped = bytes(page).decode("latin-1" if latin else "utf-8"), 0
            if before == 0:
                text, dropped = without_comments(text.removeprefix("\ufeff"))
            out += [(path, *e) for e in page_entries(text, before + dropped)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def statement_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every row, broken row and line of furniture of the text layers of printed statements, with physical line numbers.

    Pages part at form feeds, where Spark splits a file of any length; the lines before a page are a sum over the
    pages in order. A page is one value. Comments before the first page's lines are left out but counted.
    """
    order = ["path", "block", "at"]
    pages = cut(spark.read.option("lineSep", "\f").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("page"), (~F.is_valid_utf8("value")).alias("latin")))
    text = F.decode("page", "ISO-8859-1")
    sized = pages.select(*order, "latin", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n"))
    placed = cut(numbered(sized, order, "number", running={"upto": F.col("n")}).withColumn("upto", F.col("upto") - F.col("n")))
    files = placed.groupBy("path").agg(F.min("upto").alias("from"), F.max("latin").alias("latin"))
    full = pages.drop("latin").join(placed.select(*order, "upto"), order).join(files, "path")
    return full.select("path", "page", (F.col("upto") - F.col("from")).alias("before"), "latin").mapInPandas(_entries, _ENTRY)


def parse_statement_text(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine). A row whose balance doesn't follow from the balance that the row before it claimed, and its amount, is quarantined; the first row of a file is taken as it is.

    A reference of twelve digits is the utr; any other stays in the narration.
    """
    entries = cut(statement_entries(spark, path).where("kind <> 'furniture'"))
    size, balance, when = parse_paise(F.col("amount")), parse_paise(F.col("claimed")), F.try_to_date(F.regexp_replace("day", "'", ""), "d MMM yy")
    utr = F.when(F.col("ref").rlike("^[0-9]{12}$"), F.col("ref"))
    text = F.when(F.col("ref").isNotNull() & utr.isNull() & ~F.coalesce(F.contains("narration", "ref"), F.lit(False)), F.trim(F.concat_ws(" ", "narration", "ref"))).otherwise(F.col("narration"))
    judged = entries.withColumns({"moved": F.when(F.col("sign") == "-", -size).otherwise(size), "balance": balance, "on": when, "utr": utr, "narration": text})
    reason = (
        F.when(F.col("kind") == "broken", "TRUNCATED_ROW").when(F.col("on").isNull(), "BAD_DATE").when(F.col("moved").isNull() | F.col("balance").isNull(), "BAD_DECIMAL").when(F.col("moved") == 0, "AMBIGUOUS_DIRECTION").when(F.col("narration") == "", "MISSING_VALUE")
    )
    judged = judged.withColumn("reason", reason)
    # a row meets the one before it by their numbers: no window over a file
    good = cut(numbered(judged.where("reason is null"), ["path", "row"], "number"))
    earlier = good.select((F.col("number") + 1).alias("number"), F.col("path").alias("its_path"), F.col("balance").alias("claimed_before"))
    chained = good.join(earlier, "number", "left").withColumn("claimed_before", F.when(F.col("path") == F.col("its_path"), F.col("claimed_before")))
    off = F.coalesce(F.col("claimed_before") + F.col("moved") != F.col("balance"), F.lit(False))
    records = chained.where(~off).select(
        "path", "row", F.concat(F.lit("SLICE-"), F.lpad(F.col("row").cast("string"), F.greatest(F.lit(5), F.length(F.col("row").cast("string"))), F.lit("0"))).alias("line_id"), F.col("on").alias("txn_date"), "narration", F.when(F.col("moved") > 0, F.col("moved")).alias("credit"),
        F.when(F.col("moved") < 0, -F.col("moved")).alias("debit"), "balance", "utr",
    )
    left = judged.where("reason is not null").select("path", "row", "raw", "reason").unionByName(chained.where(off).select("path", "row", "raw", F.lit("ARITHMETIC_MISMATCH").alias("reason")))
    return records, left.select("path", F.lit(None).cast("string").alias("file_sha256"), F.col("row").cast("int").alias("row"), "raw", F.lit("slice-pdf-v1").alias("format_id"), "reason")
