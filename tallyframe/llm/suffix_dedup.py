"""Suffix-array dedup: byte strings of a fixed length that stand in an earlier document are removed.

Only suffixes cut to LENGTH bytes matter, here called windows. They are sorted in buckets, as follows.

1. Texts that are equal as a whole are one text of their smallest id; the later copies are removed without any sorting.
2. Each window has an anchor, the GRAM bytes in it whose hash is least. Equal windows have the same anchor at the same
   place, and neighbours mostly share one, so windows travel together as a chunk: the text around their anchor, some
   4 bytes a window. Sampled splitters partition the suffixes that begin at anchors by their leading GRAM bytes. Each task sends
   equal chunks of a block once, with their places.
3. A bucket sorts by multikey quicksort: first the anchors' suffixes by their leading bytes, which drops all that are alone;
   then the rest of the windows, eight bytes at a time, where a run whose next bytes are all equal needs no sort.
   Runs left at the end are equal windows; those of larger ids than a run's smallest are removed.
4. If more suffixes share their leading bytes than one bucket should hold, the splitters repeat. Blocks then deal them to
   all buckets between, and the first places that each of these finds are compared across their boundaries in a
   second round of the same sort. So no bucket gathers all places of a passage that many documents have.
5. What is removed goes back to its document as intervals, merged to maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded, cut, give_back, hash_spans, mix64, null_safe_source_sizes, pack, small_batches, text_buffers, tidy, unpack

#: Bytes of a string that must not stand in an earlier document, and leading bytes by which suffixes are partitioned.
LENGTH, GRAM = 50, 16
#: Bytes of text of a block, whose equal chunks travel once, and for each bucket.
BLOCK, BUCKET = 4_000_000, 6_000_000
#: Bytes of text, about, that splitters are sampled from; of its chunks every KEY_STEP-th counts.
SAMPLE_BYTES, KEY_STEP = 32_000_000, 16
#: Windows for which anchors are searched at a time; positions in them fit the low bits of a hash.
_SLICE_BITS = 20
#: Bytes of intervals that may be broadcast to the documents; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SENT = pa.schema([("bucket", pa.int32()), ("heavy", pa.int32()), ("home", pa.int32()), ("body", pa.binary())])
_SENT_DDL = "bucket int, heavy int, home int, body binary"


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of a text that has eight more bytes than its places."""
    return np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), shape=(len(raw) - 7,), strides=(1,))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def chunks(padded: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of windows of one text with one anchor. padded: the texts and eight bytes more than GRAM."""
    total = int(offsets[-1]) - length + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3
    step = np.zeros(total + 1, np.int32)
    inner = offsets[1:-1]
    np.add.at(step, np.clip(inner - length + 1, 0, total), 1)
    np.subtract.at(step, np.clip(inner, 0, total), 1)
    inside = np.cumsum(step[:-1]) == 0
    eights, width, mask = _eights(padded), length - GRAM + 1, np.uint64((1 << _SLICE_BITS) - 1)
    out = []
    for a in range(0, total, (1 << _SLICE_BITS) - width):
        b = min(total, a + (1 << _SLICE_BITS) - width)
        size = b - a + width - 1
        h = mix64(eights[a : a + size] * _K1 + eights[a + 8 : a + 8 + size] * _K2)
        least, covers = (h & ~mask) | np.arange(size, dtype=np.uint64), 1
        while covers < width:
            shift = min(covers, width - covers)
            least = np.minimum(least[: len(least) - shift], least[shift:])
            covers += shift
        anchor, ok = (least & mask).astype(np.int64), inside[a:b]
        edges = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])]))
        n = np.diff(np.append(edges, b - a))
        good = ok[edges]
        out.append((edges[good] + a, n[good], anchor[edges[good]] + a))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _alike(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each class of equal spans, the class of each span); spans of equal hash are told apart by a second one."""
    h = hash_spans(padded, starts, lengths)
    _, first, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[of] > 1)
    if len(several):
        again = np.zeros(len(h), np.uint64)
        again[several] = hash_spans(padded, starts[several], lengths[several], _K2)
        if (again != again[first[of]]).any():
            _, first, of = np.unique(np.stack([h, again]), axis=1, return_index=True, return_inverse=True)
    return first, of


def _leading(padded: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The GRAM bytes at each anchor as byte strings, which compare as bytes."""
    return padded[anchors[:, None] + np.arange(GRAM)].view(f"S{GRAM}").ravel()


class Block:
    """Texts of a task, as chunks with their places: places are (chunk, text, offset)."""

    def __init__(self):
        self.ids, self.keys, self.texts, self.held = [], [], [], 0

    def add(self, ids: np.ndarray, keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.ids.append(ids)
        self.keys.append(keys)
        self.texts.append((raw, offsets))
        self.held += len(raw)

    def join(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = np.concatenate([r for r, _ in self.texts] + [np.zeros(GRAM + 8, np.uint8)])
        sizes = np.concatenate([np.diff(o) for _, o in self.texts])
        return np.concatenate(self.ids), np.concatenate(self.keys), raw, np.concatenate([[0], np.cumsum(sizes)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (id, key, text) as (ids, keys, padded bytes, offsets) of BLOCK bytes or one text."""
    block = Block()
    for batch in batches:
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        raw, offsets = text_buffers(batch.column(2))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
            block.add(ids[at:to], keys[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
            if block.held >= BLOCK:
                yield block.join()
                block = Block()
    if block.ids:
        yield block.join()


def _body(padded, starts, lengths, at, place_chunk, place_doc, place_off, ids, keys) -> bytes:
    """A message: chunks (their lengths, anchors and bytes), places in order of chunk, and the documents of the places."""
    order = np.argsort(place_chunk, kind="stable")
    used, doc = np.unique(place_doc[order], return_inverse=True)
    times = np.bincount(place_chunk, minlength=len(starts)).astype(np.uint32)
    text = padded[_gather(starts, lengths)]
    return pack(lengths.astype(np.uint16), at.astype(np.uint16), text, times, doc.astype(np.uint32), place_off[order].astype(np.uint32), ids[used], keys[used])


def _deal(splitters: np.ndarray, length: int):
    """Batches of (id, key, text) to messages for buckets; heavy is the first of the buckets that share a run of leading bytes, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, padded, offsets in _blocks(batches):
            start, windows, anchor = chunks(padded, offsets, length)
            if not len(start):
                continue
            size, doc = windows + length - 1, np.searchsorted(offsets, start, side="right") - 1
            first, of = _alike(padded, start, size)
            lead = _leading(padded, anchor[first])
            low, high = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
            shared = high - low >= 2
            salt = int(mix64(ids[:1].astype(np.uint64) + keys[:1].view(np.uint64))[0] >> np.uint64(1))
            bucket, heavy = np.where(shared, low + salt % np.maximum(1, high - low), high), np.where(shared, low, -1)
            order = np.lexsort((heavy, bucket))
            edges = np.flatnonzero(np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (heavy[order][1:] != heavy[order][:-1]), [True]]))
            # places in order of their chunk's message
            rank = np.empty(len(first), np.int64)
            rank[order] = np.arange(len(first))
            place = np.argsort(rank[of], kind="stable")
            upto = np.searchsorted(rank[of][place], np.append(edges[:-1], len(first)))
            rows = []
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own, p = first[order[a:b]], place[upto[i] : upto[i + 1]]
                body = _body(padded, start[own], size[own], anchor[own] - start[own], rank[of[p]] - a, doc[p], start[p] - offsets[doc[p]], ids, keys)
                rows.append((int(bucket[order[a]]), int(heavy[order[a]]), -1, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)
        give_back()

    return run


def equal_windows(padded: np.ndarray, starts: np.ndarray, lead: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, runs): the windows that have an equal one of another document, in order of runs of equal ones.

    starts: where the windows begin; lead: runs that are known to agree so far, as numbers; doc: ids. Multikey
    quicksort: eight bytes are one key, and only runs whose keys differ are sorted by the next one.
    """
    eights = _eights(padded)
    order = np.argsort(lead, kind="stable")
    run = lead[order]
    for at in [*range(0, length - 8, 8), length - 8, None]:
        # runs of one window, or of one document, are through
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        if len(first):
            ids = doc[order]
            mixed = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first))[run]
            order, run = order[mixed], run[mixed]
        if at is None or not len(order):
            break
        key = eights[starts[order] + at].byteswap()
        same = np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] == key[:-1])])
        unsorted = np.zeros(int(run[-1]) + 1, dtype=bool)
        unsorted[run[~same]] = True
        todo = np.flatnonzero(unsorted[run])
        if len(todo):
            by = todo[np.lexsort((key[todo], run[todo]))]
            order[todo], key[todo] = order[by], key[by]
        run = np.cumsum(np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] != key[:-1])])) - 1
    return order, run


def _settle(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """The messages of a bucket: (ids, keys, starts, ends) of what goes, and the first places of its chunks as the parts of a message."""
    parts = [unpack(b) for b in bodies]
    size, at, times = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1, 3))
    padded = np.concatenate([p[2] for p in parts] + [np.zeros(GRAM + 8, np.uint8)])
    starts = np.cumsum(size) - size
    docs_before = np.cumsum([0] + [len(p[6]) for p in parts])
    doc = np.concatenate([p[4].astype(np.int64) + n for p, n in zip(parts, docs_before[:-1], strict=True)])
    off = np.concatenate([p[5] for p in parts]).astype(np.int64)
    ids, keys = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (6, 7))
    del parts
    first, of = _alike(padded, starts, size)
    klass = np.repeat(of, times)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, klass, ids[doc])
    later = ids[doc] > least[klass]
    gone = [(doc[later], off[later], off[later] + size[first][klass[later]])]
    doc, off, klass = doc[~later], off[~later], klass[~later]

    # the anchors' suffixes by their leading bytes: only those with another document's are looked into
    lead = _leading(padded, starts[first] + at[first])
    _, group = np.unique(lead, return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, least)
    open_now = np.flatnonzero(low[group] < high[group])
    windows = size[first[open_now]] - length + 1
    owner = np.repeat(open_now, windows)
    inner = _gather(np.zeros(len(open_now), np.int64), windows)
    begin = starts[first[owner]] + inner
    order, run = equal_windows(padded, begin, group[owner] * np.int64(length) + at[first[owner]] - inner, least[owner], length)
    flagged = np.zeros(len(owner), dtype=bool)
    if len(order):
        heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        flagged[order] = np.minimum.reduceat(least[owner[order]], heads)[np.cumsum(np.concatenate([[True], run[1:] != run[:-1]])) - 1] < least[owner[order]]
    # runs of flagged windows of one chunk, at every first place of it
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    opens = flagged & (edge | ~np.concatenate([[False], flagged[:-1]])) if len(owner) else flagged
    closes = flagged & np.concatenate([edge[1:] | ~flagged[1:], [True]]) if len(owner) else flagged
    span_class, span_from, span_to = owner[opens], inner[opens], inner[closes] + length
    by = np.argsort(klass, kind="stable")
    upto = np.searchsorted(klass[by], np.arange(len(first) + 1))
    many = upto[span_class + 1] - upto[span_class]
    p = by[_gather(upto[span_class], many)]
    gone.append((doc[p], off[p] + np.repeat(span_from, many), off[p] + np.repeat(span_to, many)))
    g_doc, g_from, g_to = (np.concatenate(c) for c in zip(*gone, strict=True))
    return ids[g_doc], keys[g_doc], g_from, g_to, (padded, starts[first], size[first], at[first], klass, doc, off, ids, keys)


def _replies(ids, keys, begin, end, homes: int) -> list[tuple]:
    home = (mix64(ids.astype(np.uint64) ^ keys.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((begin, keys, ids, home))
    edges = np.searchsorted(home[order], np.arange(homes + 1))
    rows = []
    for h in np.flatnonzero(np.diff(edges)):
        o = order[edges[h] : edges[h + 1]]
        new = np.concatenate([[True], (ids[o][1:] != ids[o][:-1]) | (keys[o][1:] != keys[o][:-1])])
        rows.append((-1, -1, int(h), pack(ids[o][new], keys[o][new], (np.cumsum(new) - 1).astype(np.uint32), begin[o].astype(np.uint32), (end - begin)[o].astype(np.uint32))))
    return rows


def _sort(homes: int, length: int):
    """A bucket's messages to replies for homes of documents, and to messages of first places for the round that compares across boundaries."""

    def run(table: pa.Table) -> pa.Table:
        heavy, bodies, rows = np.array(table.column("heavy")), table.column("body"), []
        for h in np.unique(heavy):
            ids, keys, begin, end, firsts = _settle([bodies[int(i)].as_py() for i in np.flatnonzero(heavy == h)], length)
            rows += _replies(ids, keys, begin, end, homes)
            if h >= 0:
                rows.append((int(h), -1, -1, _body(*firsts)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def merged(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of numbered documents as maximal runs, in order; touching ones are one run."""
    order = np.lexsort((begin, ids))
    ids, begin, end = ids[order], begin[order], end[order]
    if not len(ids):
        return ids, begin, end
    far = np.int64(max(int(end.max()), 1) + 1)
    reach = np.maximum.accumulate(ids * far + end)
    new = np.concatenate([[True], ids[1:] * far + begin[1:] > reach[:-1]])
    new[1:] |= ids[1:] != ids[:-1]
    heads = np.flatnonzero(new)
    return ids[heads], begin[heads], reach[np.append(heads[1:], len(ids)) - 1] - ids[heads] * far


def _collect(table: pa.Table) -> pa.Table:
    """The replies of one home to a row for each text: spans is its runs as pairs of 64-bit numbers, begin and end."""
    parts = [unpack(b) for b in table.column("body").to_pylist()]
    before = np.cumsum([0] + [len(p[0]) for p in parts])
    ids, keys = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
    both, number = np.unique(np.stack([ids, keys]), axis=1, return_inverse=True)
    doc = np.concatenate([number.ravel()[p[2].astype(np.int64) + n] for p, n in zip(parts, before[:-1], strict=True)])
    begin = np.concatenate([p[3] for p in parts]).astype(np.int64)
    doc, begin, end = merged(doc, begin, begin + np.concatenate([p[4] for p in parts]).astype(np.int64))
    edges = np.searchsorted(doc, np.arange(both.shape[1] + 1))
    pairs = np.stack([begin, end], axis=1)
    spans = [pairs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table([pa.array(both[0]), pa.array(both[1]), pa.array(spans, pa.binary())], names=["doc_id", "text_key", "spans"])


def _keys(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, padded, offsets in _blocks(batches):
            _, _, anchor = chunks(padded, offsets, length)
            yield pa.RecordBatch.from_arrays([pa.array(_leading(padded, anchor[::KEY_STEP]).tolist(), pa.binary())], names=["lead"])

    return run


def sampled_splitters(texts: DataFrame, total: int, buckets: int, length: int) -> np.ndarray:
    """Quantiles of the leading bytes of anchors in a sample of the texts (doc_id, text_key, text); they repeat where many suffixes share them."""
    sample = texts if total <= SAMPLE_BYTES else texts.sample(SAMPLE_BYTES / total, 13)
    rows = sample.mapInArrow(_keys(length), "lead binary").collect()  # a bounded sample
    lead = np.sort(np.array([bytes(r.lead) for r in rows], f"S{GRAM}"))
    return lead[np.arange(1, buckets) * len(lead) // buckets] if len(lead) else lead


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, whole, spans) of each text that loses something; whole: all of it, else spans says what. docs: (doc_id, text_key, text), no nulls."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = cut(docs.select("doc_id", "text_key", F.unhex(F.sha2(F.col("text"), 256)).alias("sha"), F.octet_length("text").alias("bytes")))
    same = hashed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = cut(hashed.where(F.col("bytes") >= length).join(same, "sha").where("doc_id > first").select("doc_id", "text_key").distinct())
    texts = docs.join(bounded(later), ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key", "text")
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(2 * shuffles, total // BUCKET)
    splitters = sampled_splitters(texts, total, buckets, length)
    dealt = texts.mapInArrow(_deal(splitters, length), _SENT_DDL)
    settled = cut(dealt.groupBy("bucket").applyInArrow(tidy(_sort(buckets, length)), _SENT_DDL), free=True)
    across = settled.where("home < 0").groupBy("bucket").applyInArrow(tidy(_sort(buckets, length)), _SENT_DDL)
    replies = settled.where("home >= 0").unionByName(across)
    spans = cut(replies.groupBy("home").applyInArrow(tidy(_collect), "doc_id long, text_key long, spans binary"), free=True)
    return later.select("doc_id", "text_key", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("spans")).unionByName(spans.select("doc_id", "text_key", F.lit(False).alias("whole"), "spans"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, whole, spans) to (doc_id, n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        out = []
        for text, whole, spans in zip(*(batch.column(i).cast(pa.binary()) if i == 1 else batch.column(i) for i in (1, 2, 3)), strict=True):
            held = text.as_buffer() if text.is_valid else b""
            view, pieces, at, gone, runs = memoryview(held), [], 0, 0, np.zeros((0, 2), np.int64)
            if whole.as_py():
                runs = np.array([[0, len(view)]])
            elif spans.is_valid:
                runs = np.frombuffer(spans.as_py(), np.int64).reshape(-1, 2)
            for begin, end in runs.tolist():
                pieces.append(view[at:begin])
                at, gone = end, gone + end - begin
            pieces.append(view[at:])
            out.append((len(view), gone, len(runs), b"".join(pieces)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs (doc_id, text), without each byte that lies in a string of length bytes that starts in a document of a smaller id too.

    A null text is empty. Texts are UTF-8 bytes, and kept may part a character. Strings never cross documents, and are
    judged on the input. Within one document, and between rows of one id, nothing is a repetition. Rows of a null id
    stay whole and are nobody's first. A text shorter than length loses nothing. Long texts are taken whole. n_spans counts
    maximal runs. Other columns are ignored; an empty table gives an empty result.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    gone = removed_spans(rows.where("doc_id is not null").select("doc_id", "text_key", "text"), length)
    size = gone.agg(F.sum(24 + F.coalesce(F.octet_length("spans"), F.lit(0)))).first()[0] or 0
    joined = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, ["doc_id", "text_key"], "left")
    return joined.select("doc_id", "text", "whole", "spans").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(made: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeats()."""
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: The same by all strings of all places; for small tables only.
ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents
), places AS (
  SELECT doc_id, p, array_slice(x, p + 1, p + 50) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(0, octet_length(x) - 49))) AS p FROM texts)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM places GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, p FROM places JOIN firsts USING (s) WHERE first < doc_id
), opened AS (
  SELECT doc_id, p, CASE WHEN p <= max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM gone
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opened) GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN a > before THEN hex(array_slice(x, before + 1, a)) ELSE '' END, '' ORDER BY a) AS head, max(b) AS upto, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM edges JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(x) > coalesce(upto, 0) THEN hex(array_slice(x, coalesce(upto, 0) + 1, octet_length(x))) ELSE '' END)) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
