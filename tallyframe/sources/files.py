"""Raw rows of files in any known layout, with their row numbers and the reason why a row can't be used."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, file_sha256 string, row int, raw string, header array<string>, cells array<string>"
DETECTION = 0.60
HEAD_BYTES = 8192


def decode(content: bytes) -> str | None:
    """Text of UTF-8 with or without a mark, else Latin-1; None for bytes with a NUL."""
    if b"\0" in content:
        return None
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def normalise_header(name: str) -> str:
    """Lower case, single spaces, none around punctuation."""
    return re.sub(r"\s*([^\w\s])\s*", r"\1", re.sub(r"\s+", " ", name.strip().lower()))


def without_comments(text: str) -> tuple[str, int]:
    """text after its leading # lines, and how many they are."""
    lines, n = text.splitlines(keepends=True), 0
    while n < len(lines) and lines[n].lstrip().startswith("#"):
        n += 1
    return "".join(lines[n:]), n


def csv_rows(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(first physical line from 1, raw text, cells) of each CSV row; a quoted cell may span lines."""
    lines = text.splitlines(keepends=True)
    reader = csv.reader(lines)
    start = 0
    for cells in reader:
        yield start + 1, "".join(lines[start : reader.line_num]).rstrip("\r\n"), cells
        start = reader.line_num


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            sha, text = hashlib.sha256(content).hexdigest(), decode(content)
            if text is None:
                yield pd.DataFrame([(path, sha, 0, "", None, None)], columns=["path", "file_sha256", "row", "raw", "header", "cells"])
                continue
            body, skipped = without_comments(text)
            names: list[str] | None = None
            out = []
            for line, raw, cells in csv_rows(body):
                if names is None:
                    names = [normalise_header(c) for c in cells]
                    continue
                out.append((path, sha, line + skipped, raw, names, cells))
            yield pd.DataFrame(out, columns=["path", "file_sha256", "row", "raw", "header", "cells"])


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row of ROWS for each CSV row after the header; a file that can't be decoded gives one row 0 without cells."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_rows, ROWS)


def cell(name: str):
    """A cell by its header's normalised name; null where the file has no such column, '' where it is empty."""
    at = F.array_position("header", normalise_header(name))
    return F.when(at > 0, F.trim(F.get("cells", (at - 1).cast("int"))))


def optional(name: str):
    return F.nullif(cell(name), F.lit(""))


def header_confidence(names: list[str], required: tuple[str, ...], distinctive: tuple[str, ...]) -> float:
    """0 unless all required names are there; else 0.7 and a share of 0.3 for the distinctive ones."""
    have = {normalise_header(n) for n in names}
    if not all(normalise_header(r) in have for r in required):
        return 0.0
    return 0.7 + 0.3 * (sum(normalise_header(d) in have for d in distinctive) / len(distinctive) if distinctive else 1.0)
