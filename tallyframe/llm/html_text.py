"""HTML extraction by site template removal.

Pages are parsed to elements; every subtree is hashed, Spark counts on how many pages of a host a subtree stands, and
subtrees that recur on many pages of their host are deleted. So are elements that are no main text by their tag, class,
id or role. What is left of the article (or else of the main element, or else of the body) is the text.

The article itself is no template, even where a site shows one article many times. So a block inside articles is
template only if it stands on half of the host's pages and the texts around it differ: each page carries a sketch of its
text, which near copies mostly share, and half of the block's pages at least must have sketches of their own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import BROADCAST_ROWS, cut, give_back, small_batches
from tallyframe.llm.ngram_join import shingle_sets
from tallyframe.llm.url_filter import host_and_path

#: A subtree is template that stands on so many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: A block inside articles stands on this share of its host's pages, in so many different texts, and this share of its pages have texts of their own.
INNER_SHARE, MIN_TEXTS, OWN_TEXTS = 0.5, 5, 0.5
#: Elements that can be template inside an article; a heading, an item or a cell by itself, or words in a line, can't.
INNER = frozenset("address blockquote center details div dl fieldset figure hgroup header ol p section table ul".split())

#: Elements without content, with content that isn't markup, that part blocks, and that are no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav aside footer form script style noscript template iframe svg button select textarea head title menu dialog object embed canvas audio video xmp noembed noframes".split())
CLOSED_BY = {"p": BLOCKS - {"br", "button", "link", "meta", "option", "optgroup", "legend", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
DROPPED_NAMES = re.compile(
    r"(?:[a-z0-9]+[-_])*(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promos?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side-bar|"
    r"comments?|disqus|respond|replies|cookies?|consent|gdpr|notices?|popups?|modals?|newsletter|subscribe|subscription|share|sharing|social|related|widgets?|footer|masthead|pagination|skip-link)"
    r"(?:[-_](?:[0-9]+|box|bar|area|list|section|wrapper|container|block|unit|slot|item|items|form|links?|thread|body|banner|content|inner|outer|top|bottom|left|right|header|notice|message|text))*$"
)
NOT_ITSELF = re.compile(r"(?:has|with|no|without|is)[-_]")
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HEADER_NAMES = re.compile(r"(?:[a-z0-9]+[-_])*(?:page|site|top|main|global)?[-_]?header$")


class Node:
    __slots__ = ("digest", "first", "guarded", "last", "names", "parent", "parts", "roles", "tag")

    def __init__(self, tag: str, attributes: str, parent: int, first: int):
        self.tag, self.parent, self.first, self.last, self.parts, self.digest, self.guarded = tag, parent, first, first, [], b"", False
        self.names, self.roles = (), ()
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                words = value.strip("\"'").lower().split()
                if name.lower() in ("class", "id"):
                    self.names += tuple(words)
                else:
                    self.roles += tuple(words) if name.lower() == "role" else ()

    def unwanted(self, inside: bool) -> bool:
        """Whether its tag or names say that it is no main text. inside: an article or main element."""
        if self.tag in DROPPED or (self.tag == "header" and not inside):
            return True
        if self.tag in ("html", "body", "main") or self.guarded:
            return False
        if any(r in DROPPED_ROLES for r in self.roles):
            return True
        return any((DROPPED_NAMES.match(n) or (not inside and _HEADER_NAMES.match(n))) and not NOT_ITSELF.match(n) for n in self.names)


def parse(page: str, digests: bool) -> tuple[list[Node], list[str]]:
    """(elements in order of their start, pieces of text) of a page; an element spans pieces first to last. A blank piece parts blocks."""
    nodes, pieces, stack, is_open = [Node("", "", -1, 0)], [], [0], {}
    at, n = 0, len(page)

    def close() -> None:
        i = stack.pop()
        node = nodes[i]
        node.last = len(pieces)
        is_open[node.tag] -= 1
        if digests:
            node.digest = hashlib.blake2b("\0".join([node.tag, *node.names]).encode("utf-8", "replace") + b"\1" + b"\1".join(node.parts), digest_size=8).digest()
            nodes[stack[-1]].parts.append(node.digest)
            node.parts = []
        if node.tag in ("article", "main"):
            for j in stack:
                nodes[j].guarded = True

    def text(a: int, b: int) -> None:
        if a < b:
            pieces.append(page[a:b])
            if digests:
                nodes[stack[-1]].parts.append(" ".join(page[a:b].split()).encode("utf-8", "replace"))

    for m in iter(lambda: _TAG.search(page, at) if page.find(">", at) >= 0 or page.find("<!", at) >= 0 else None, None):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            pieces.append(" ")
        if m[1] or m[4]:
            if is_open.get(tag):
                while nodes[stack[-1]].tag != tag:
                    close()
                close()
            continue
        while len(stack) > 1 and (shuts := CLOSED_BY.get(nodes[stack[-1]].tag)) and tag in shuts:
            close()
        if tag in CLOSED_BY["p"] and is_open.get("p") and not any(nodes[j].tag in BLOCKS and nodes[j].tag != "p" for j in stack[_last(nodes, stack, "p") :]):
            while nodes[stack[-1]].tag != "p":
                close()
            close()
        attributes = m[3] if m[2] else m[6]
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path")):
            continue
        nodes.append(Node(tag, attributes, stack[-1], len(pieces)))
        stack.append(len(nodes) - 1)
        is_open[tag] = is_open.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            stop = end.start() if end else n
            text(at, stop)
            at = stop
    text(at, n)
    while len(stack) > 1:
        close()
    nodes[0].last = len(pieces)
    return nodes, pieces


def _last(nodes: list[Node], stack: list[int], tag: str) -> int:
    return next(i for i in range(len(stack) - 1, -1, -1) if nodes[stack[i]].tag == tag)


def _within(nodes: list[Node]) -> list[bool]:
    """Whether each element is, or lies in, an article or main element."""
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.tag in ("article", "main")
    return inside


def _id(node: Node) -> int:
    return int.from_bytes(node.digest, "little", signed=True)


def _found(nodes: list[Node], gone: list[bool]) -> list[int]:
    """The elements whose text is the page's: articles, or else main elements, or else all."""
    articles = [i for i, node in enumerate(nodes) if node.tag == "article" and not gone[i]]
    return articles or [i for i, node in enumerate(nodes) if (node.tag == "main" or "main" in node.roles) and not gone[i]] or [0]


def _text(nodes: list[Node], pieces: list[str], gone: list[bool]) -> str:
    keep = bytearray(len(pieces))
    for i in _found(nodes, gone):
        keep[nodes[i].first : nodes[i].last] = b"\1" * (nodes[i].last - nodes[i].first)
    for i, node in enumerate(nodes):
        if gone[i] and not gone[node.parent]:
            keep[node.first : node.last] = bytes(node.last - node.first)
    # each piece by itself: what markup parts is no reference
    return " ".join("".join(entities.unescape(p) if k else " " for p, k in zip(pieces, keep, strict=True)).split())


def _gone(nodes: list[Node], inside: list[bool], template: frozenset[int] = frozenset(), inner: frozenset[int] = frozenset()) -> list[bool]:
    """Whether each element is deleted, by its tag or names, as template outside or inside articles, or with one that it lies in."""
    gone = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        recurs = not node.guarded and ((template and not inside[i] and _id(node) in template) or (inner and inside[node.parent] and node.tag in INNER and _id(node) in inner))
        gone[i] = gone[node.parent] or bool(recurs) or node.unwanted(inside[i])
    return gone


def sketch(text: str) -> int:
    """The least hash of the text's 5-word shingles: texts with most shingles in common mostly have the same."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    grams, _ = shingle_sets(raw, np.array([0, len(raw)], np.int64), 5)
    return int(grams[0]) if len(grams) else 0


def subtrees(page: str) -> tuple[set[int], set[int], int]:
    """(outer, inner, sketch): hashes of the page's subtrees with content that neither hold nor lie in an article or main
    element, hashes of those inside one that aren't deleted by tag or name, and the sketch of the page's text."""
    nodes, pieces = parse(page, True)
    inside = _within(nodes)
    outer = {_id(node) for i, node in enumerate(nodes) if i and not inside[i] and not node.guarded and node.last > node.first and node.tag not in ("html", "body")}
    gone = _gone(nodes, inside)
    inner = {_id(node) for i, node in enumerate(nodes) if i and inside[node.parent] and not gone[i] and not node.guarded and node.tag in INNER and node.last > node.first}
    return outer, inner, sketch(_text(nodes, pieces, gone)) if inner else 0


def main_text(page: str, template: frozenset[int] = frozenset(), inner: frozenset[int] = frozenset()) -> str:
    """The page's main text without the template's subtrees: blocks in order, white space as single spaces, references decoded."""
    nodes, pieces = parse(page, bool(template or inner))
    return _text(nodes, pieces, _gone(nodes, _within(nodes), template, inner))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "subtree", "sketch"]
    for batch in batches:
        hosts, hashes, sketches = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            outer, inner, text = subtrees(page)
            hosts += [host] * (len(outer) + len(inner))
            hashes += [*outer, *inner]
            sketches += [None] * len(outer) + [text] * len(inner)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(sketches, pa.int64())], names=names)
    give_back()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "template", "inner")), strict=True)
        texts = [main_text(page, frozenset(template or ()), frozenset(inner or ())) for page, template, inner in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template, inner): the hashes of each host's recurring subtrees outside and inside of articles; at most a page's number of subtrees over min_share."""
    on_host = pages.where("host <> ''")
    seen = on_host.select("host", "html").mapInArrow(_counted, "host string, subtree long, sketch long")
    # first by text, so that a block of one text many times is one row
    by_text = seen.groupBy("host", "subtree", "sketch").agg(F.count("*").alias("pages"))
    counts = by_text.groupBy("host", "subtree", F.col("sketch").isNotNull().alias("is_inner")).agg(F.sum("pages").alias("pages"), F.count("sketch").alias("texts")).where(F.col("pages") >= min_pages)
    sizes = on_host.groupBy("host").agg(F.count("*").alias("all_pages"))
    differs = (F.col("texts") >= MIN_TEXTS) & (F.col("texts") >= F.col("pages") * OWN_TEXTS) & (F.col("pages") >= F.col("all_pages") * INNER_SHARE)
    recurring = counts.join(sizes, "host").where(F.when(F.col("is_inner"), differs).otherwise(F.col("pages") >= F.col("all_pages") * min_share))
    return recurring.groupBy("host").agg(*(F.collect_list(F.when(w, F.col("subtree"))).alias(c) for c, w in (("template", ~F.col("is_inner")), ("inner", F.col("is_inner")))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    A null page is empty and has an empty text. Pages of a null or malformed url belong to no host, and lose elements
    by tag and class only. Repeated rows are pages of their own: a page many times is one text, and its blocks stay.
    Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    slim = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_and_path(F.col("url").cast("string"))[0].alias("host"))
    found = cut(templates(slim)).withColumnRenamed("host", "site")
    # broadcast by the number of hashes, not of hosts
    hashes = found.agg(F.sum(F.size("template") + F.size("inner") + 8)).first()[0] or 0
    joined = slim.join(F.broadcast(found) if hashes <= BROADCAST_ROWS else found, F.col("host") == F.col("site"), "left").select("page_id", "url", "html", "template", "inner")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url {dict(pages.dtypes)['url']}, text string"
    return joined.mapInArrow(_extracted, schema).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
