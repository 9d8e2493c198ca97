"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is assigned to its centroid's list and
coded. Some of the queries meet all vectors, which tells how many lists the queries need. Queries meet the lists of
their best centroids, score codes by asymmetric tables, and rerank exactly on the original vectors the best of each
list and all that the codes' errors could have hidden. Equal vectors are one entry with their smallest ids, so that a
very common vector costs no more than another, and long lists are split into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut

#: Distinct vectors that centroids and codebooks are fitted on, about.
SAMPLE_ROWS = 20_000
#: Lists: the square root of the number of vectors, at most MOST_LISTS. A query reads as many of them as held this share
#: of the neighbours, among all vectors, of SOUNDINGS of the queries.
MOST_LISTS, SHARE, SOUNDINGS = 4096, 0.985, 400
#: Values of a code, dimensions that share one, and codes of a block of a list that are reranked for a query at least;
#: others are where errors CAUTION times as large, for their vectors, as the largest among these would lift them to the best.
CODES, SPAN, RERANK, CAUTION = 256, 4, 96, 1.5
#: Vectors of a block and queries of a slice, about, and parts that the ids of a very common vector are dealt to.
BLOCK, SLICE, SALTS = 4096, 4096, 256


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    codebooks: list[np.ndarray]

    def spans(self) -> list[slice]:
        d = self.centroids.shape[1]
        return [slice(a, min(a + SPAN, d)) for a in range(0, d, SPAN)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each row, in parts of bounded size."""
    half = (centres**2).sum(axis=1) / 2
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([np.argmax(x[a : a + step] @ centres.T - half, axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), len(centres))])
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """Centroids and, of each span of dimensions of the residuals, a codebook."""
    centroids = _means(sample, lists, 10, 11)
    rest = sample - centroids[_nearest(sample, centroids)]
    return Index(centroids, [_means(rest[:, a : a + SPAN], CODES, 6, 13 + a) for a in range(0, sample.shape[1], SPAN)])


def _vectors(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, "embedding")
            cell = _nearest(x, index.centroids)
            rest = x - index.centroids[cell]
            codes = np.zeros((len(x), len(index.codebooks)), np.uint8)
            for m, (s, book) in enumerate(zip(index.spans(), index.codebooks, strict=True)):
                own = _nearest(rest[:, s], book)
                codes[:, m] = own
                rest[:, s] -= book[own]
            error = np.sqrt((rest**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*batch.schema.names, "cell", "code", "error"])

    return run


def _sound(index: Index, soundings: np.ndarray, k: int):
    """(sounding, score, depth): of each batch the k best for each sounding, and which of the sounding's lists holds them, from 0."""
    order = np.argsort(np.argsort(-(soundings @ index.centroids.T), axis=1, kind="stable"), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), BLOCK):
                batch = whole.slice(a, BLOCK)
                scores, cell = soundings @ _vectors(batch, "embedding").T, batch.column("cell").to_numpy()
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
                columns = np.repeat(np.arange(len(scores), dtype=np.int32), best.shape[1]), np.take_along_axis(scores, best, axis=1).ravel(), np.take_along_axis(order, cell[best], axis=1).ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sounding", "score", "depth"])

    return run


def _probes(index: Index, coded: DataFrame, queries: DataFrame, k: int) -> int:
    """How many lists hold SHARE of the k nearest of SOUNDINGS queries, chosen by a hash, by brute force over all vectors."""
    some = queries.orderBy(F.xxhash64("vec_id"), "k1", "k2").select("embedding").limit(SOUNDINGS).toArrow()
    if not len(some):
        return 1
    met = coded.select("embedding", "cell").mapInArrow(_sound(index, _vectors(some, "embedding"), k), "sounding int, score double, depth int")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("sounding").orderBy(F.desc("score"), F.desc("depth")))).where(F.col("r") <= k)
    return int(np.quantile(best.select("depth").toArrow().column("depth").to_numpy(), SHARE)) + 2


def _probe(index: Index, probes: int, sizes: np.ndarray, k: int):
    """The lists that each query reads: its best ones, and more of them until they hold k entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, "embedding")
            if not len(x):
                continue
            near = np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")
            depth = np.maximum(probes, (np.cumsum(sizes[near], axis=1) < k).sum(axis=1) + 1)
            rows, ranks = np.nonzero(np.arange(near.shape[1])[None, :] < depth[:, None])
            taken = batch.select(["k1", "k2"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near[rows, ranks].astype(np.int32))], names=["k1", "k2", "cell"])

    return run


_FOUND = "q1 long, q2 long, score double, vec_id long"


def _search(index: Index, k: int):
    """A block's vectors and the queries that probe it: the best codes by asymmetric tables, then exact scores, with all ids of a vector."""
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not len(queries) or not len(block):
            return schema.empty_table()
        q, x = _vectors(queries, "embedding"), _vectors(block, "embedding")
        codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        error, size = block.column("error").to_numpy(), np.sqrt((q**2).sum(axis=1))
        ids, out = block.column("ids").to_pylist(), []
        keys = list(zip(queries.column("k1").to_pylist(), queries.column("k2").to_pylist(), strict=True))
        base = q @ index.centroids[block.column("cell")[0].as_py()]
        step = max(1, 2_000_000 // len(x))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            rough = np.repeat(base[a : a + step, None], len(x), axis=1)
            for m, (s, book) in enumerate(zip(index.spans(), index.codebooks, strict=True)):
                rough += (part[:, s] @ book.T)[:, codes[:, m]]
            best = np.argpartition(-rough, RERANK - 1, axis=1)[:, :RERANK] if len(x) > RERANK else np.tile(np.arange(len(x)), (len(part), 1))
            exact = (x[best] * part[:, None, :]).sum(axis=2)
            for i in range(len(part)):
                rows, scores = best[i], exact[i]
                if len(x) > len(rows) > k:
                    # the codes' errors are at most |query| * error; what share of that they reach is seen where the score is known
                    most = size[a + i] * error
                    share = min(1.0, CAUTION * float(np.max(np.divide(np.abs(scores - rough[i, rows]), most[rows], out=np.zeros(len(rows)), where=most[rows] > 0))))
                    open_ = rough[i] + share * most + 1e-12 * np.abs(rough[i]) >= np.partition(scores, -k)[-k]
                    open_[rows] = False
                    more = np.flatnonzero(open_)
                    rows, scores = np.concatenate([rows, more]), np.concatenate([scores, (x[more] * part[i]).sum(axis=1)])
                kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
                scored = sorted((-score, v) for score, row in zip(scores[kept].tolist(), rows[kept].tolist(), strict=True) for v in ids[row])[:k]
                out += [(*keys[a + i], -score, v) for score, v in scored]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, k1, k2) of the vectors that take part, with a 128-bit key of the content."""
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    slim = slim.where(sound)
    sizes = slim.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    slim = slim.where(F.size("embedding") == (sizes.d if sizes else 0))
    # -0.0 and 0.0 are one value
    flat = F.transform("embedding", lambda v: v + F.lit(0.0))
    return slim.withColumn("embedding", flat).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit("key"), "embedding")})


def nearest(embeddings: DataFrame, is_query=None, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that were found of each query, by inner product in double precision.

    is_query is a condition on vec_id; every vector but the query's own is a candidate, ties go to smaller ids. Vectors
    that are null, empty, zero, of a size other than the most common one, or hold nulls or non-finite values, take no part; so don't null ids. A
    repeated row counts once. Fewer candidates than k give all of them; an empty table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows = cut(valid(embeddings))
    key = ["k1", "k2"]
    salted = rows.select(*key, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    some = salted.withColumn("r", F.dense_rank().over(Window.partitionBy(*key, "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = some.withColumn("r", F.dense_rank().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("r") <= k + 1).groupBy(*key).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    shapes = rows.groupBy(*key).agg(F.first("embedding").alias("embedding"))
    distinct = cut(shapes.join(ids, key))
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    share = min(1.0, SAMPLE_ROWS / count)
    sample = distinct.where(F.pmod(F.col("k1"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("embedding").toArrow()
    if not len(sample):
        sample = distinct.select("embedding").limit(1000).toArrow()
    index = fit(_vectors(sample, "embedding"), min(MOST_LISTS, max(1, int(np.sqrt(count)))))

    width = "k1 long, k2 long, embedding array<double>, ids array<long>, cell int, code binary, error double"
    coded = cut(distinct.select("k1", "k2", "embedding", "ids").mapInArrow(_assign(index), width))
    held = {r.cell: r["count"] for r in coded.groupBy("cell").count().collect()}  # a row a list
    sizes = np.array([held.get(c, 0) for c in range(len(index.centroids))], np.int64)

    asked = rows.where(is_query).select(*key).distinct().join(distinct, key).select(*key, "embedding")
    needed = _probes(index, coded, rows.where(is_query), k + 1)
    probes = cut(asked.mapInArrow(_probe(index, needed, sizes, k + 1), "k1 long, k2 long, cell int"))
    # lists are dealt to blocks and their queries to slices, both of bounded size; each block meets each slice. A row a list.
    shape = probes.groupBy("cell").count().select("cell", F.ceil(F.col("count") / SLICE).alias("slices")).join(coded.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).alias("blocks")), "cell")
    shape = F.broadcast(cut(shape))  # at most MOST_LISTS rows
    dealt = coded.join(shape, "cell").withColumn("block", F.pmod("k2", "blocks")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices", "blocks")
    sent = probes.join(shape, "cell").withColumn("slice", F.pmod("k1", "slices")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(asked, key).drop("slices", "blocks")
    meeting = ["cell", "block", "slice"]
    found = sent.groupBy(*meeting).cogroup(dealt.groupBy(*meeting)).applyInArrow(_search(index, k + 1), _FOUND)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    queries = rows.where(is_query).select("k1", "k2", F.col("vec_id").alias("query_id")).distinct()
    out = queries.join(lists, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select("query_id", F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "n")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
