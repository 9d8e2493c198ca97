"""URL filters: allow and block rules in a trie over reversed host labels and path segments; the longest match decides.

A small rule set is broadcast as a trie. A rule set beyond the bound is a table that meets the URLs by host suffix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, and bytes of them, that a trie may have to be broadcast.
TRIE_RULES, TRIE_BYTES = 1_000_000, 64 << 20
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Else both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Rules (verdict, host, path) by host labels from the right, then by path segments with their slash; plain nested dicts."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        node = node.setdefault("paths", {})
        parts = path.split("/")
        for part in parts[:-1]:
            node = node.setdefault(("path", part), {})
        # what follows the last slash may be the beginning of a segment: it goes on by character
        node = node.setdefault("tail", {})
        for character in parts[-1]:
            node = node.setdefault(character, {})
        held = node.get("rule")
        node["rule"] = (host + path, "block" if "block" in (verdict, held and held[1]) else verdict)
    return root


def find(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the rule with most host labels, and then with the longest path; block wins over an equal allow."""
    node, on_way = root, []
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        if "paths" in node:
            on_way.append(node["paths"])
    for paths in reversed(on_way):
        if (found := _along(paths, path)) is not None:
            return found
    return None


def _along(node: dict | None, path: str) -> tuple[str, str] | None:
    best, at = None, 0
    while node is not None:
        tail, k = node.get("tail"), at
        while tail is not None:
            best = tail.get("rule", best)
            tail, k = tail.get(path[k]) if k < len(path) else None, k + 1
        end = path.find("/", at)
        if end < 0:
            break
        node, at = node.get(("path", path[at:end])), end + 1
    return best


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """urls with host, path, rule and verdict; rules are (verdict, host, path), a list or a table with these columns.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path; the longest fitting rule
    decides, and its text is in rule. Null or malformed URLs have an empty host and path, and, fitting nothing, the
    default verdict. Columns of these four names that urls has already are replaced. Repeated rules count once.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = urls.withColumns({"host": host, "path": path})
    if isinstance(rules, DataFrame):
        slim = rules.select(*(F.col(c).cast("string") for c in ("verdict", "host", "path"))).na.drop()
        count, size = slim.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
        if count > TRIE_RULES or size > TRIE_BYTES:
            return _judge_by_join(parsed, slim, default)
        rules = [tuple(r) for r in slim.collect()]  # bounded just now
    trie = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [find(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]})

    held = "_found"
    while held in parsed.columns:
        held += "_"
    return parsed.withColumn(held, decide("host", "path")).withColumns({"rule": F.col(f"{held}.rule"), "verdict": F.col(f"{held}.verdict")}).drop(held)


def _judge_by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for a rule table of any size: each distinct host and path meets the rules of its host's suffixes."""
    keys = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keys.withColumn("suffix", F.explode(suffixes)).join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.col("verdict").alias("says")), "suffix")
    fits = met.where(F.col("path").startswith(F.col("prefix")))
    order = F.struct(F.size(F.split("suffix", r"\.")), F.length("prefix"), (F.col("says") == "block").cast("int"), F.concat("suffix", "prefix").alias("rule"), "says")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.says").alias("verdict"))
    return parsed.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

ORACLE_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rests
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
