"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words and their first bytes (three lengths), hashed to a fixed number of slots.
The machine scores w0 + sum(w_i) + sum over pairs <v_i, v_j>, so that two terms together can weigh more, or less, than
their sum. It is fitted on a bounded sample of labelled rows, over the slots that stand in most of them: no slot has to
tell the classes apart by itself. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import forget, give_back, hash_spans, mix64, small_batches, text_buffers, words_of, _K

#: Slots that terms are hashed to.
SLOTS = 1 << 20
#: Labelled rows that a model is fitted on, about; a hash of the id chooses them from all labelled rows.
SAMPLE_ROWS = 40_000
#: Slots that a fit weighs: those of the most sampled documents, at most ACTIVE, each in SUPPORT documents at least.
ACTIVE, SUPPORT = 32_768, 10
#: The fit: factors of a slot, documents of a step, step size, spread of the factors at the start.
FACTORS, BATCH, RATE, SPREAD = 4, 256, 0.1, 0.05
#: Two rounds of (epochs, shrinkage of weights, shrinkage of factors): the first brings most slots to zero, by what they do
#: alone and in pairs; the second fits the others again, shrinking less.
ROUNDS = ((10, 4e-3, 8e-3), (20, 5e-4, 1e-3))
#: Rows from which the shrinkage is as in ROUNDS; fewer ones shrink more where they have more slots than rows, by the root
#: of what they lack, as chance then makes many slots look telling.
FULL_ROWS = 20_000
PREFIXES = (3, 4, 5)
_SEPARATORS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the distinct terms of each text."""
    low, starts, lengths, doc = words_of(raw, offsets, _SEPARATORS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [hash_spans(low, starts, lengths)]
    docs = [doc]
    for k in PREFIXES:
        longer = lengths > k
        found.append(mix64(hash_spans(low, starts[longer], np.full(int(longer.sum()), k, np.int64)) * _K + np.uint64(k)))
        docs.append(doc[longer])
    keys = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(20) | np.concatenate(found) >> np.uint64(44))
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def _chunks(batch: pa.RecordBatch, column: int, size: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of parts of a batch of about size bytes; a text is never cut."""
    raw, offsets = text_buffers(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of five words of each text, 0 for shorter ones: near copies mostly share it."""
    forget()
    for batch in batches:
        least = np.zeros(batch.num_rows, np.int64)
        for at, _, raw, offsets in _chunks(batch, 2):
            low, starts, lengths, doc = words_of(raw, offsets)
            if len(starts) > 5:
                h = hash_spans(low, starts, lengths)
                g = h[:-4]
                for k in range(1, 5):
                    g = mix64(g * _K + h[k : len(h) - 4 + k])
                inside = doc[:-4] == doc[4:]  # no five words over the end of a text
                g, own = g[inside], doc[:-4][inside]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                if len(first):
                    least[at + own[first]] = np.minimum.reduceat(g, first).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["doc_id", "toxic", "sketch"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, raw, offsets in _chunks(batch, 2):
            counts += np.bincount(terms(raw, offsets)[1], minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])
    give_back()


def _places(slots: np.ndarray) -> np.ndarray:
    place = np.full(SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots), dtype=np.int32)
    return place


def _featured(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(slots)
        for batch in batches:
            rows: list[bytes] = []
            for _, to, raw, offsets in _chunks(batch, 2):
                doc, slot = terms(raw, offsets)
                own = place[slot]
                doc, own = doc[own >= 0], own[own >= 0].astype(np.uint16)
                rows += [x.tobytes() for x in np.split(own, np.searchsorted(doc, np.arange(1, len(offsets) - 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "own"])
        give_back()

    return run


def margins(model: Model, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The machine's raw scores of documents with counts[i] active terms each, listed in own."""
    rows = np.repeat(np.arange(len(counts)), counts)
    n, v = len(counts), model.factors[own]
    total = model.bias + np.bincount(rows, model.weights[own], minlength=n)
    for f in range(model.factors.shape[1]):
        total += 0.5 * (np.bincount(rows, v[:, f], minlength=n) ** 2 - np.bincount(rows, v[:, f] ** 2, minlength=n))
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(labels: np.ndarray, counts: np.ndarray, own: np.ndarray, slots: np.ndarray) -> Model:
    """Proximal AdaGrad on the balanced logistic loss, from a fixed start and in a fixed order, so that equal samples give equal models.

    Document i has counts[i] of the entries of own, which are places in slots.
    """
    positives = int(labels.sum())
    model = Model(slots[:0], 9.0 if positives else -9.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not positives or positives == len(labels):
        return model
    factors = np.random.default_rng(7).normal(0, SPREAD, (len(slots), FACTORS))
    model = Model(slots, 0.0, np.zeros(len(slots)), factors)
    scarce = max(1.0, min(float(np.sqrt(FULL_ROWS / len(labels))), len(slots) / len(labels)))
    for epochs, weight_shrink, factor_shrink in ROUNDS:
        model = _descend(model, labels, counts, own, epochs, weight_shrink * scarce, factor_shrink * scarce)
        live = (model.weights != 0) | model.factors.any(axis=1)
        kept, ends = live[own], np.cumsum(counts)
        counts = np.array([np.count_nonzero(kept[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], np.int64)
        own = (np.cumsum(live) - 1).astype(np.uint16)[own[kept]]
        model = Model(model.slots[live], model.bias, model.weights[live], model.factors[live])
    return model


def _descend(model: Model, labels: np.ndarray, counts: np.ndarray, own: np.ndarray, epochs: int, weight_shrink: float, factor_shrink: float) -> Model:
    """Steps from model; what is zero in it stays zero."""
    n, m, positives = len(labels), len(model.slots), int(labels.sum())
    ends = np.cumsum(counts)
    cost = np.where(labels == 1, 0.5 * n / positives, 0.5 * n / (n - positives))
    bias, w, v = model.bias, model.weights.copy(), np.ascontiguousarray(model.factors.T)
    w_free, v_free = (w != 0) | (not w.any()), v != 0
    bias_seen, w_seen, v_seen = 1e-6, np.full(m, 1e-6), np.full((FACTORS, m), 1e-4)
    shrunk = lambda x, by, free: np.where(free, np.sign(x) * np.maximum(np.abs(x) - by, 0), 0)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            part = order[a : a + BATCH]
            sizes = counts[part]
            rows = np.repeat(np.arange(len(part)), sizes)
            at = np.repeat(ends[part] - np.cumsum(sizes), sizes) + np.arange(len(rows))
            slot = own[at].astype(np.int64)
            each = [x[slot] for x in v]
            sums = [np.bincount(rows, x, minlength=len(part)) for x in each]
            margin = bias + np.bincount(rows, w[slot], minlength=len(part)) + 0.5 * sum(s * s - np.bincount(rows, x * x, minlength=len(part)) for s, x in zip(sums, each, strict=True))
            error = cost[part] * (_sigmoid(margin) - labels[part]) / len(part)
            bias_seen += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_seen)
            error = error[rows]
            grad = np.bincount(slot, error, minlength=m)
            w_seen += grad**2
            step = RATE / np.sqrt(w_seen)
            w = shrunk(w - step * grad, step * weight_shrink, w_free)
            for f in range(FACTORS):
                grad = np.bincount(slot, error * (sums[f][rows] - each[f]), minlength=m)
                v_seen[f] += grad**2
                step = RATE / np.sqrt(v_seen[f])
                v[f] = shrunk(v[f] - step * grad, step * factor_shrink, v_free[f])
    return Model(model.slots, float(bias), w, np.ascontiguousarray(v.T))


def held_out(column):
    """True for rows that a fit never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a sample of about sample_rows labelled rows (bounded; chosen by a hash of the id) that held_out() leaves.

    Near copies within the sample count once, and so do rows that share an id. Labels that are null or have a null id
    are ignored. Without rows of both classes the model is a constant. The model doesn't depend on partitions or their order.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by sample_rows
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    kept = sample.mapInArrow(_sketch, "doc_id long, toxic int, sketch long").groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").collect()
    if not kept:
        return Model(np.zeros(0, np.int64), -9.0, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = docs.sparkSession.createDataFrame(kept, "doc_id long, toxic int").dropDuplicates(["doc_id"])
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    counted = sample.mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    slots = np.array(sorted(r.slot for r in counted.orderBy(F.desc("n"), "slot").limit(ACTIVE).collect()), np.int64)
    # a row of the sample is two bytes for each of its weighed slots
    rows = sample.mapInArrow(_featured(slots), "doc_id long, toxic int, own binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("own").alias("own")).drop("doc_id").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["own"]))
    counts = np.array([len(r["own"]) // 2 for r in rows], np.int64)
    own, toxic = np.frombuffer(b"".join(r["own"] for r in rows), np.uint16), np.array([r["toxic"] for r in rows])
    del rows
    model = train(toxic, counts, own, slots)
    del own, toxic, counts
    give_back()
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(model.slots)
        for batch in batches:
            out = np.empty(batch.num_rows)
            at_text = batch.schema.get_field_index("text")
            for at, to, raw, offsets in _chunks(batch, at_text):
                doc, slot = terms(raw, offsets)
                own = place[slot]
                out[at:to] = _sigmoid(margins(model, np.bincount(doc[own >= 0], minlength=to - at), own[own >= 0]))
            names = [n for n in batch.schema.names if n != "text"] + ["score"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:-1]] + [pa.array(out)], names=names)
        give_back()

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts get the score of a text without terms. A null id is scored too, with held_out false.
    Repeated rows are scored each; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs, all columns and rows, without those that score(...) rejects. Scores and texts stay in one pass: no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(model.slots)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for at, to, raw, offsets in _chunks(batch, batch.schema.get_field_index("text")):
                doc, slot = terms(raw, offsets)
                own = place[slot]
                out[at:to] = _sigmoid(margins(model, np.bincount(doc[own >= 0], minlength=to - at), own[own >= 0]))
            yield batch.filter(pa.array(out < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
