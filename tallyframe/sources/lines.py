"""CSV rows with their physical line numbers from files of any size, read by byte ranges.

Spark splits a file at line feeds into ranges and reads each in order. Whether a range begins inside a quoted cell, and
at which line, depends on all ranges before it; so a first pass sums up each range for both cases (lines, where a row
last began, and how it ends), a prefix over the ranges of a file puts these together, and a second pass makes the rows.
A row that spans ranges comes as fragments, which meet by the line that it begins at.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.files import ROWS, normalise_header

#: Bytes of a row that spans ranges, at most; a longer one, such as all that follows a quote that is never closed, can't be used.
MOST_ROW_BYTES = 16_000_000
_MARK = b"\xef\xbb\xbf"
_FIELD = rb'(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)'
#: A line that ends inside a quoted cell: one that a row begins at, and one that begins inside a quoted cell.
_OPENS = re.compile(rb"(?:" + _FIELD + rb',)*+"(?:[^"]|"")*+\Z', re.DOTALL)
_STAYS = re.compile(rb'(?:[^"]|"")*+(?:\Z|"[^,]*+,(?:' + _FIELD + rb',)*+"(?:[^"]|"")*+\Z)', re.DOTALL)
_SUMMARY = "path string, block long, n long, last0 long, last1 long, ends0 boolean, ends1 boolean, nul boolean, latin boolean, head binary"
_MADE = "path string, block long, row long, part long, body binary, raw string, cells array<string>"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of a line (without its line feed) is inside a quoted cell, if its begin is, or isn't."""
    if b'"' not in line:
        return inside
    return bool((_STAYS if inside else _OPENS).match(line))


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The lines of each byte range; a range's lines follow each other."""
    held = None
    for batch in batches:
        for path, block, line in zip(batch["path"], batch["block"], batch["line"], strict=True):
            if held is None or held[0] != path or held[1] != block:
                if held:
                    yield held
                held = (path, int(block), [])
            held[2].append(bytes(line))
    if held:
        yield held


class _Start:
    """The begin of a file: its mark, the comments before the header, and the header's lines."""

    def __init__(self, lines: list[bytes]):
        if lines and lines[0].startswith(_MARK):
            lines[0] = lines[0][len(_MARK) :]
        self.skipped = 0
        while self.skipped < len(lines) and lines[self.skipped].lstrip().startswith(b"#"):
            self.skipped += 1
        to, inside = self.skipped, False
        while to < len(lines):
            inside = ends_inside(lines[to], inside)
            to += 1
            if not inside:
                break
        self.rows_from, self.head = to, b"\n".join(lines[self.skipped : to])
        self.inside = inside


def _is_utf8(line: bytes) -> bool:
    if line.isascii():
        return True
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, block, lines in _ranges(batches):
        start = _Start(lines) if block == 0 else None
        state, last = [False, True], [-1, -1]
        for i in range(start.rows_from if start else 0, len(lines)):
            for k in (0, 1):
                if not state[k]:
                    last[k] = i
                state[k] = ends_inside(lines[i], state[k])
        unusable = any(b"\0" in x for x in lines) or (start is not None and start.inside)
        row = (path, block, len(lines), *last, *state, unusable, not all(map(_is_utf8, lines)), start.head if start else None)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def _cells(text: str) -> list[str] | None:
    """The cells of a row; None where a carriage return stands alone outside quotes."""
    csv.field_size_limit(sys.maxsize)
    try:
        return next(csv.reader(line + "\n" for line in text.split("\n")), [])
    except csv.Error:
        return None


def _rows(fragments: bool):
    """Ranges with what is before them to whole rows, or to fragments of rows that span ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _MADE.split(", ")]
        known: dict = {}

        def noted() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, block, *rest in batch[["path", "block", "before", "inside", "open_at", "latin"]].drop_duplicates().itertuples(index=False):
                    known[path, int(block)] = rest
                yield batch

        for path, block, lines in _ranges(noted()):
            before, inside, open_at, latin = known[path, block]
            codec, at, out = "latin-1" if latin else "utf-8", 0, []
            if block == 0:
                start = _Start(lines)
                at = start.rows_from
            held, first, reaches = [], int(open_at) if inside else None, inside
            for i in range(at, len(lines)):
                if first is None:
                    first = before + i + 1
                held.append(lines[i])
                inside = ends_inside(lines[i], inside)
                if not inside:
                    if reaches and fragments:
                        out.append((path, block, first, block, b"\n".join(held), None, None))
                    elif not reaches and not fragments:
                        raw = b"\n".join(held).decode(codec)
                        out.append((path, block, first, None, None, raw.rstrip("\r\n"), _cells(raw)))
                    held, first, reaches = [], None, False
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if held and fragments:
                out.append((path, block, first, block, b"\n".join(held), None, None))
            if out:
                yield pd.DataFrame(out, columns=columns)

    return run


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joined fragments to rows; without a body the row is too long."""
    for batch in batches:
        out = []
        for path, row, body, latin in zip(batch["path"], batch["row"], batch["body"], batch["latin"], strict=True):
            raw = bytes(body).decode("latin-1" if latin else "utf-8") if body is not None else None
            out.append((path, row, "" if raw is None else raw.rstrip("\r\n"), None if raw is None else _cells(raw)))
        yield pd.DataFrame(out, columns=["path", "row", "raw", "cells"])


def read_rows_by_range(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows as read_rows() gives them, from files of any size by many tasks; file_sha256 is null, as no task sees a whole file.

    row is the physical line, from 1, that a row begins at; lines end at line feeds only. Quotes are the csv module's: they
    open a cell only at its begin, and double inside. A file with a NUL byte, or whose comments and header
    don't end within its first range, is one row 0 without cells. Rows have no cells, either, where they span ranges with over
    MOST_ROW_BYTES, or have a carriage return alone outside quotes. Where any line isn't UTF-8 the file is Latin-1. A
    task holds the lines of one range (spark.sql.files.maxPartitionBytes).
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    summed = lines.mapInPandas(_summaries, _SUMMARY)
    # a row for each range, so a file's are few
    along = Window.partitionBy("path").orderBy("block")
    earlier, every = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    # how a range is entered follows from the nearest earlier range whose end doesn't depend on its own begin, and the turns since
    fixed = F.when(F.col("ends0") == F.col("ends1"), F.col("ends0")).when(F.col("block") == 0, F.col("ends0"))
    turned = F.sum((fixed.isNull() & F.col("ends0")).cast("int")).over(along)
    state = summed.withColumns({"fixed": fixed, "turns": F.coalesce(turned, F.lit(0))})
    known = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(earlier)
    entered = state.withColumns({"known": known, "turns_before": F.coalesce(F.max("turns").over(earlier), F.lit(0)), "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    inside = F.coalesce(F.when((F.col("turns_before") - F.coalesce("known.turns", F.lit(0))) % 2 == 1, ~F.coalesce("known.fixed", F.lit(False))).otherwise(F.coalesce("known.fixed", F.lit(False))), F.lit(False))
    entered = entered.withColumn("inside", inside)
    began = F.when(F.col("inside"), F.col("last1")).otherwise(F.col("last0"))
    entered = entered.withColumn("began", F.when(began >= 0, F.col("before") + began + 1))
    spots = entered.select(
        "path", "block", "before", "inside", F.last("began", ignorenulls=True).over(earlier).alias("open_at"), F.max("nul").over(every).alias("nul"), F.max("latin").over(every).alias("latin"), F.first("head").over(along).alias("head")
    )
    from tallyframe.operators.lineage import cut

    spots = cut(spots)
    heads = spots.where("block = 0").select("path", "nul", "latin", "head")
    names = heads.mapInPandas(_names, "path string, nul boolean, latin boolean, header array<string>")
    placed = lines.join(F.broadcast(spots.where("not nul").drop("nul", "head")), ["path", "block"])
    whole = placed.mapInPandas(_rows(False), _MADE).select("path", "row", "raw", "cells")
    parts = placed.mapInPandas(_rows(True), _MADE).withColumn("size", F.sum(F.octet_length("body")).over(Window.partitionBy("path", "row")))
    joined = parts.groupBy("path", "row").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("size") <= MOST_ROW_BYTES, F.struct("part", "body")))).alias("parts"))
    body = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["body"])), "0A"))
    joined = joined.join(F.broadcast(heads.select("path", "latin")), "path").select("path", "row", F.when(F.col("size") <= MOST_ROW_BYTES, body).alias("body"), "latin")
    rows = whole.unionByName(joined.mapInPandas(_together, "path string, row long, raw string, cells array<string>")).join(F.broadcast(names.where("not nul")), "path")
    shaped = rows.select("path", F.lit(None).cast("string").alias("file_sha256"), F.col("row").cast("int").alias("row"), "raw", "header", "cells")
    bad = names.where("nul").select("path", F.lit(None).cast("string").alias("file_sha256"), F.lit(0).alias("row"), F.lit("").alias("raw"), F.lit(None).cast("array<string>").alias("header"), F.lit(None).cast("array<string>").alias("cells"))
    return shaped.unionByName(bad).select(*(c.split()[0] for c in ROWS.split(", ")))


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(p, nul, latin, [] if nul else [normalise_header(c) for c in _cells(bytes(head).decode("latin-1" if latin else "utf-8")) or ()]) for p, nul, latin, head in zip(batch["path"], batch["nul"], batch["latin"], batch["head"], strict=True)]
        yield pd.DataFrame(out, columns=["path", "nul", "latin", "header"])
