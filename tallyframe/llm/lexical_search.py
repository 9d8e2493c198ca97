"""Ranked lexical search: WAND over shards of documents, the shards' heaps merged.

1. A shard is what a task reads until it has SHARD_BYTES of text. The query terms in it become an inverted index:
   postings by term and document, with document lengths. Each shard is one row of a written table, so the texts are
   read once; all later passes read postings of query terms only.
2. Document frequencies, the number of documents and of terms are summed over the shards.
3. In each shard a term has the largest impact that any of its documents gets from it. For each query the documents
   are taken block by block. Terms whose largest impacts together don't reach the threshold of the query's heap can't
   bring a document in alone: only documents of the others are candidates, and of these only pivots, those whose terms'
   largest impacts together reach the threshold, are scored. The heap goes with the task from shard to shard.
4. Each task returns its heaps; Spark ranks them by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, give_back, hash_spans, pack, small_batches, text_buffers, unpack, words_of

#: Fixed values of the ranking: see score_parts().
K1_PART, B_PER_CENT, SCALE = 8, 75, 1_000_000_000
#: Bytes of text and number of documents of a shard at most (but for one document), and documents of a block.
SHARD_BYTES, SHARD_DOCS, BLOCK = 16_000_000, 16_384, 1024
#: Bytes of text that are cut into words at a time.
SLICE = 4_000_000
#: Bytes of query texts that one pass over the documents takes; more queries are more passes.
QUERY_BYTES = 8_000_000
_NOT_IN_TERMS = np.zeros(256, dtype=bool)
_NOT_IN_TERMS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_HEAP_DDL = "query int, doc_id long, score long"


class Queries:
    """Query texts as terms: hashes in ascending order, and for each query its terms' places there with their repeats."""

    def __init__(self, texts: list[str]):
        raw, offsets = text_buffers(pa.array(texts, pa.string()))
        low, starts, lengths, query = words_of(raw, offsets, _NOT_IN_TERMS)
        self.hashes, place = np.unique(hash_spans(low, starts, lengths), return_inverse=True) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        both, times = np.unique(query.astype(np.int64) * max(1, len(self.hashes)) + place, return_counts=True)
        owner, term = both // max(1, len(self.hashes)), both % max(1, len(self.hashes))
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.terms = [(term[a:b], times[a:b].astype(np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are terms, their places)."""
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        hit = self.hashes[np.minimum(at, max(0, len(self.hashes) - 1))] == h[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
        return maybe[hit], at[hit]


def _index(queries: Queries):
    """Batches of (id, text) to shards: (docs, terms, body). docs and terms count all documents with a term and all their terms; body has those with query terms."""

    def shard(ids: list[np.ndarray], nulls: list[np.ndarray], sizes: list[np.ndarray], docs: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
        doc_id, null, n = np.concatenate(ids), np.concatenate(nulls), np.concatenate(sizes)
        # in order of id, null ids last
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((doc_id, null))] = np.arange(len(n))
        key, tf = np.unique(np.concatenate(places) * len(n) + rank[np.concatenate(docs)], return_counts=True)
        term, doc = key // len(n), key % len(n)
        used, doc = np.unique(doc, return_inverse=True)
        back = np.argsort(rank)[used]
        body = pack(doc_id[back], null[back].astype(np.uint8), n[back].astype(np.uint64), term.astype(np.uint32), doc.astype(np.uint32), tf.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([body], pa.binary())], names=["docs", "terms", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, sizes, docs, places, held, bytes_held = [], [], [], [], [], 0, 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            column = batch.column(0)
            null, keys = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
                low, starts, lengths, doc = words_of(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], _NOT_IN_TERMS)
                which, place = queries.places(hash_spans(low, starts, lengths)) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                ids.append(keys[at:to])
                nulls.append(null[at:to])
                sizes.append(np.bincount(doc, minlength=to - at))
                docs.append(doc[which] + held)
                places.append(place.astype(np.int64))
                held, bytes_held, at = held + to - at, bytes_held + int(offsets[to] - offsets[at]), to
                if bytes_held >= SHARD_BYTES or held >= SHARD_DOCS:
                    yield shard(ids, nulls, sizes, docs, places)
                    ids, nulls, sizes, docs, places, held, bytes_held = [], [], [], [], [], 0, 0
        if held:
            yield shard(ids, nulls, sizes, docs, places)
        del ids, nulls, sizes, docs, places
        give_back()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each shard."""
    for batch in batches:
        for body in batch.column(0).to_pylist():
            term, df = np.unique(unpack(body)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(df.astype(np.int64))], names=["term", "df"])


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_parts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to its document's score, in whole numbers."""
    m = 100 - B_PER_CENT + (B_PER_CENT * n * n_docs) // max(1, n_terms)
    return weights * ((SCALE * tf) // (1000 * tf + K1_PART * m))


class Heap:
    """The best documents of a query so far: higher scores first, equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.nulls, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """The least score that can still come in; an equal one may, by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        scores, nulls, ids = np.concatenate([self.scores, scores]), np.concatenate([self.nulls, nulls]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.nulls, self.ids = scores[best], nulls[best], ids[best]


class Shard:
    """The postings of one shard with their impacts, each term's largest impact, and where each term's postings of each block are."""

    def __init__(self, body: bytes, weights: np.ndarray, n_docs: int, n_terms: int):
        ids, null, n, term, doc, tf = unpack(body)
        self.ids, self.null, term, self.doc = ids.view(np.int64), null.astype(bool), term.astype(np.int64), doc.astype(np.int64)
        self.impact = score_parts(weights[term], tf.astype(np.int64), n.astype(np.int64)[self.doc], n_docs, n_terms)
        self.blocks = -(-len(self.ids) // BLOCK)
        own, first = np.unique(term, return_index=True)
        self.place = {int(t): i for i, t in enumerate(own)}
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)
        width = self.blocks * BLOCK
        self.edges = np.searchsorted(term * width + self.doc, (own[:, None] * width + np.arange(self.blocks + 1) * BLOCK).ravel()).reshape(len(own), self.blocks + 1)

    def search(self, terms: np.ndarray, times: np.ndarray, heap: Heap) -> int:
        """Offer the heap the documents that may belong in it; returns how many were scored."""
        have = [(self.place[int(t)], int(q)) for t, q in zip(terms, times, strict=True) if int(t) in self.place]
        if not have:
            return 0
        most = np.array([q * int(self.most[i]) for i, q in have])
        order = np.argsort(-most, kind="stable")
        rows, times, most = [have[i][0] for i in order], [have[i][1] for i in order], most[order]
        # what the terms from each one on can add together at most
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        scored = 0
        for b in range(self.blocks):
            threshold = heap.threshold
            if rest[0] < threshold:
                break
            bound = np.zeros(BLOCK, np.int64)
            for i, row in enumerate(rows):
                # documents of the terms from here on only can't reach the threshold: they are no candidates
                if rest[i] < threshold:
                    break
                bound[self.doc[self.edges[row, b] : self.edges[row, b + 1]] - b * BLOCK] += most[i]
            else:
                i = len(rows)
            pivots = np.flatnonzero((bound > 0) & (bound + rest[i] >= threshold))
            for j in range(i, len(rows)):
                if not len(pivots):
                    break
                own = self.doc[self.edges[rows[j], b] : self.edges[rows[j], b + 1]] - b * BLOCK
                at = np.minimum(np.searchsorted(own, pivots), max(0, len(own) - 1))
                if len(own):
                    bound[pivots] += np.where(own[at] == pivots, most[j], 0)
                pivots = pivots[bound[pivots] + rest[j + 1] >= threshold]
            if not len(pivots):
                continue
            total = np.zeros(len(pivots), np.int64)
            for row, q in zip(rows, times, strict=True):
                own = self.doc[self.edges[row, b] : self.edges[row, b + 1]] - b * BLOCK
                if len(own):
                    at = np.minimum(np.searchsorted(own, pivots), len(own) - 1)
                    total += np.where(own[at] == pivots, q * self.impact[self.edges[row, b] + at], 0)
            scored += len(pivots)
            good = np.flatnonzero(total >= threshold)
            heap.offer(total[good], self.null[pivots[good] + b * BLOCK], self.ids[pivots[good] + b * BLOCK])
        return scored


def _search(queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Shards to the heaps of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in queries.terms]
        for batch in batches:
            for body in batch.column(0):
                shard = Shard(body.as_py(), weights, n_docs, n_terms)
                for (terms, times), heap in zip(queries.terms, heaps, strict=True):
                    shard.search(terms, times, heap)
        query = np.repeat(np.arange(len(heaps), dtype=np.int32), [len(h.ids) for h in heaps])
        ids, nulls, scores = (np.concatenate([getattr(h, name) for h in heaps]) if heaps else np.zeros(0, np.int64) for name in ("ids", "nulls", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])
        give_back()

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs (doc_id, text) for each row of queries (item_id, text).

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A null or empty text has
    none; a query without terms, or whose terms no document has, returns nothing, and so does an empty table. Scores are
    above 0. Rows of docs that share an id are documents of their own, equal ones in any order; null ids come last
    among equal scores. Equal rows of queries count once; different texts of one id are ranked each for itself. The text of a
    document is taken whole, and alone if it is longer than a shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = cut(queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // QUERY_BYTES) + 1
    out = None
    for i in range(passes):
        found = _one_pass(rows, asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i), k)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    items = asked.orderBy("item_id", "text").collect()  # QUERY_BYTES or so
    queries = Queries([r.text or "" for r in items])
    index = cut(rows.mapInArrow(_index(queries), "docs long, terms long, body binary"))
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("docs"), F.sum("terms")).first())
    df = np.zeros(len(queries.hashes), np.int64)
    for r in index.select("body").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each query term
        df[r.term] = r.df
    weights = np.array([weight(int(x), n_docs) for x in df], np.int64)
    heaps = index.select("body").mapInArrow(_search(queries, weights, n_docs, n_terms, k), _HEAP_DDL)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sized AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM words WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counted, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, nd
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN counted USING (term), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
