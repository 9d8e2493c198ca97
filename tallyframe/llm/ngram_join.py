"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

How the work is dealt out:

1. Each task turns its texts into sets of hashed word n-grams and sends them, packed, to buckets of the hash space.
   A bucket counts in how many documents an n-gram stands and sends back those that stand in more than one.
2. Gathered again by document, the n-grams that nobody shares come first in the rare-first order. A document whose
   prefix is filled by them can have no partner and is out. So the text is read once, and only the shared n-grams
   of the remaining documents are kept, in rare-first order; overlaps are exact, as unshared ones never overlap.
3. Documents with equal sets are one class. Prefix n-grams of the classes meet by n-gram. First each meets the least
   class of its n-gram (a star). Where a prefix n-gram still stands in different components, further turns choose other
   centres, and at last all pairs across components are made. Pairs inside a component could change nothing and aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, differences, give_back, hash_spans, mix64, null_safe_source_sizes, pack, small_batches, text_buffers, tidy, unpack, without, words_of, _K
from tallyframe.llm.components import connected_components

#: n-grams that a task holds before it sends them on, and that a bucket should hold.
BLOCK, BUCKET = 1_000_000, 1_500_000
#: Bytes of text whose words a task looks at together; a longer text is looked at whole.
CHUNK = 1_000_000
#: Bits of an n-gram's hash that are dropped, so that packed differences get shorter; 56 stay.
DROPPED = np.uint64(8)
#: Ranges of the hash space in the suffix filter's histogram.
RANGES = 16
#: Turns in which prefix n-grams meet at centres before what is left meets across components, and kinds of centres a turn.
TURNS, CENTRES = 2, 8
#: Ranges of the histograms that stand in for the sets where pairs across components are made.
SLICES = 512

_SENT = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("rows", pa.int64()), ("alone", pa.int64()), ("same", pa.binary()), ("grams", pa.binary())])
_SENT_DDL, _DOCS_DDL = "part int, ids binary, body binary", "doc_id long, n long, rows long, alone long, same binary, grams binary"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the ascending distinct n-gram hashes of each text, one text after the other.

    A text with fewer words than size has its whole sequence as its one n-gram; one without words has none.
    """
    low, starts, lengths, doc = words_of(raw, offsets)
    n_docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    h = hash_spans(low, starts, lengths)
    words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(words)])
    grams = h.copy()
    for k in range(1, min(size, len(h))):
        grams[: len(h) - k] = mix64(grams[: len(h) - k] * _K + h[k:])
    out, counts = [], np.zeros(n_docs, np.int64)
    for d in np.flatnonzero(words):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1] >> DROPPED)
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        else:
            one = h[a : a + 1] + np.uint64(b - a)
            for x in h[a + 1 : b]:
                one = mix64(one * _K + x)
            g = one >> DROPPED
        out.append(g)
        counts[d] = len(g)
    return np.concatenate(out), counts


def _send(size: int, buckets: int, parts: int):
    """Batches of (id, text) to packed messages: part < buckets takes n-grams of a range of hashes, part >= buckets the sizes of documents."""

    def flush(ids: list[np.ndarray], sets: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        doc_ids, sizes = np.concatenate(ids), np.concatenate(counts)
        grams, doc = np.concatenate(sets), np.repeat(np.arange(len(doc_ids), dtype=np.uint32), sizes)
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
        top = (grams >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[b], edges[b + 1]
            used, local = np.unique(doc[lo:hi], return_inverse=True)
            kept = np.argsort(doc_ids[used], kind="stable")
            place = np.empty(len(kept), np.uint32)
            place[kept] = np.arange(len(kept), dtype=np.uint32)
            rows.append((int(b), pack(differences(doc_ids[used][kept])), pack(differences(grams[lo:hi]), place[local])))
        home = part_of(doc_ids, parts)
        order = np.lexsort((doc_ids, home))
        edges = np.searchsorted(home[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            own = order[edges[p] : edges[p + 1]]
            rows.append((buckets + int(p), pack(differences(doc_ids[own])), pack(sizes[own])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, counts, held = [], [], [], 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
                own, n = shingle_sets(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], size)
                ids.append(keys[at:to])
                sets.append(own)
                counts.append(n)
                held += len(own)
                at = to
                if held >= BLOCK:
                    yield flush(ids, sets, counts)
                    ids, sets, counts, held = [], [], [], 0
        if ids:
            yield flush(ids, sets, counts)
        del ids, sets, counts
        give_back()

    return run


def part_of(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc_ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _count(buckets: int, parts: int):
    """One bucket's messages to messages for parts of the documents: (n-gram, document frequency, times in the document) where an n-gram came more than once."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= buckets:
            return pa.table([pa.array([part] * len(table), pa.int32()), table.column("ids"), table.column("body")], schema=_SENT)
        grams, docs = [], []
        for ids, body in zip(table.column("ids").to_pylist(), table.column("body").to_pylist(), strict=True):
            own, (steps, place) = np.cumsum(unpack(ids)[0].view(np.int64)), unpack(body)
            grams.append(np.cumsum(steps))
            docs.append(own[place])
        g, d = np.concatenate(grams), np.concatenate(docs)
        del grams, docs
        order = np.argsort(g, kind="stable")
        g = g[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        run_of = np.cumsum(new) - 1
        many = np.bincount(run_of)[run_of] > 1
        g, d = g[many], d[order[many]]
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        if not len(g):
            return _SENT.empty_table()
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))
        times = np.diff(np.append(first, len(g))).astype(np.uint32)
        g, d = g[first], d[first]
        run_of = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        df = np.bincount(run_of)[run_of].astype(np.uint32)
        home = part_of(d, parts)
        order = np.lexsort((g, d, home))
        g, d, df, times, home = g[order], d[order], df[order], times[order], home[order]
        edges = np.searchsorted(home, np.arange(parts + 1))
        rows = [(buckets + int(p), pack(differences(d[a:b])), pack(g[a:b], df[a:b], times[a:b])) for p in np.flatnonzero(np.diff(edges)) for a, b in [(edges[p], edges[p + 1])]]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return run


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(num / den * n) + 1."""
    return n - (num * n + den - 1) // den + 1


#: Bytes of an n-gram's hash that can be other than 0, of the 8 that it has in memory.
_BYTES = 8 - int(DROPPED) // 8


def narrow(grams: np.ndarray) -> bytes:
    """Hashes without their empty bytes: sets are kept twice, and sent to their pairs."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def widen(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def _gather(num: int, den: int):
    """The messages of one part of the documents to a row each; grams (rare first) only where the prefix reaches shared n-grams."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, who, grams, dfs, times = [], [], [], [], [], []
        for own, body in zip(table.column("ids").to_pylist(), table.column("body").to_pylist(), strict=True):
            d, parts = np.cumsum(unpack(own)[0].view(np.int64)), unpack(body)
            if len(parts) == 1:
                ids.append(d)
                sizes.append(parts[0].astype(np.int64))
            else:
                who.append(d)
                for to, x in zip((grams, dfs, times), parts, strict=True):
                    to.append(x)
        d, n = np.concatenate(ids), np.concatenate(sizes)
        doc, at = np.unique(d, return_inverse=True)
        rows, n = np.bincount(at), np.bincount(at, weights=n).astype(np.int64)
        shared, out = np.zeros(len(doc), np.int64), [None] * len(doc)
        same = [None] * len(doc)
        if who:
            w, g, df, t = (np.concatenate(x) for x in (who, grams, dfs, times))
            at = np.searchsorted(doc, w)
            n -= np.bincount(at, weights=t.astype(np.int64) - 1, minlength=len(doc)).astype(np.int64)
            shared = np.bincount(at, weights=df > 1, minlength=len(doc)).astype(np.int64)
            alive = n - shared < prefix_length(n, num, den)
            keep = alive[at] & (df > 1)
            at, g, df = at[keep], g[keep], df[keep]
            order = np.lexsort((g, df, at))
            at, g = at[order], g[order]
            edges = np.searchsorted(at, np.arange(len(doc) + 1))
            for i in np.flatnonzero(alive & (n > 0)):
                own = g[edges[i] : edges[i + 1]]
                out[i] = narrow(own)
                if len(own) == n[i]:
                    same[i] = _digest(own)
        return pa.table([pa.array(doc), pa.array(n), pa.array(rows.astype(np.int64)), pa.array(n - shared), pa.array(same, pa.binary()), pa.array(out, pa.binary())], schema=_DOCS)

    return run


def _digest(grams: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(np.sort(grams).tobytes(), digest_size=16).digest()


def _prefixes(num: int, den: int):
    """Rows of _DOCS to prefix n-grams: (gram, class, doc_id, n, place in the rare-first order, n-grams that nobody shares)."""
    schema = pa.schema([("gram", pa.int64()), ("class", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("alone", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for doc, n, alone, same, blob in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "alone", "same", "grams")), strict=True):
                g = widen(blob)[: int(prefix_length(np.int64(n), num, den)) - alone].astype(np.int64)
                cols[0].append(g)
                cols[1] += [same or doc.to_bytes(8, "little", signed=True)] * len(g)
                cols[2].append(np.full(len(g), doc))
                cols[3].append(np.full(len(g), n, np.int32))
                cols[4].append(np.arange(alone, alone + len(g), dtype=np.int32))
                cols[5].append(np.full(len(g), alone, np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if i != 1 else c, f.type) for i, (c, f) in enumerate(zip(cols, schema, strict=True))], schema=schema)
        give_back()

    return run


def _verified(num: int, den: int):
    """Pairs with both documents' shared n-grams to the pairs that link. The suffix filter, sizes by range of hash, comes before the exact overlap."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(g: np.ndarray) -> np.ndarray:
        return np.bincount((g >> np.uint64(52)).astype(np.int64), minlength=RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, na, nb, ga, gb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = widen(ga), widen(gb)
                least = -(-num * (na + nb) // (num + den))
                if (len(x) + len(y) - int(np.abs(spread(x) - spread(y)).sum())) // 2 < least:
                    continue
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                if den * overlap >= num * (na + nb - overlap):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)
        give_back()

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) of doc_ids, each verified once."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ga", "gb")
    return joined.mapInArrow(_verified(num, den), "a long, b long")


def _least(num: int, den: int):
    """The least overlap of two sets of n and n2 that link."""
    return F.ceil(F.lit(num) * (F.col("n") + F.col("n2")) / F.lit(num + den))


def _fits(num: int, den: int):
    """Length and positional filters on columns n, place, alone and n2, place2, alone2 of two prefix entries of one n-gram.
    What nobody shares stands first and overlaps with nothing."""
    most = F.lit(1) + F.least(F.col("n") - F.col("place") - 1, F.col("n2") - F.col("place2") - 1) + F.least(F.col("place") - F.col("alone"), F.col("place2") - F.col("alone2"))
    return (F.lit(den) * F.least("n", "n2") >= F.lit(num) * F.greatest("n", "n2")) & (most >= _least(num, den)) & (F.least(F.col("n") - F.col("alone"), F.col("n2") - F.col("alone2")) >= _least(num, den))


def _still_open(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """The prefix entries, with their components, of n-grams that stand in more than one component."""
    if links is None:
        placed = entries.withColumn("comp", F.col("doc_id"))
    else:
        components = connected_components(links)
        placed = entries.join(components, entries["doc_id"] == components["node"], "left").select(*entries.columns, F.coalesce("component", "doc_id").alias("comp"))
    several = placed.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("gram")
    return cut(placed.join(several, "gram"))


def _star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each entry with a centre of its n-gram, if that is in another component. In the first turn the centre is the least
    document, so that a group of copies makes few pairs; later turns choose others, by a hash, for each of CENTRES kinds of n-grams."""
    choice = F.lit(0) if not turn else F.xxhash64("doc_id", F.pmod("gram", F.lit(CENTRES)), F.lit(turn))
    centres = placed.groupBy("gram").agg(F.min(F.struct(choice.alias("by"), "doc_id", "n", "place", "alone", "comp")).alias("c"))
    centres = centres.select("gram", *(F.col(f"c.{c}").alias(t) for c, t in (("doc_id", "doc2"), ("n", "n2"), ("place", "place2"), ("alone", "alone2"), ("comp", "comp2"))))
    return placed.join(centres, "gram").where("comp <> comp2")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix filter's histogram: how many of a document's shared n-grams fall in each of SLICES ranges, up to four in unary bits, and the sum of what is over."""
    for batch in batches:
        bits, over = [], []
        for blob in batch.column("grams").to_pylist():
            counts = np.bincount((widen(blob) >> np.uint64(56 - 9)).astype(np.int64), minlength=SLICES)
            unary = np.array([0, 1, 3, 7, 15], np.uint8)[np.minimum(counts, 4)]
            bits.append((unary[0::2] | unary[1::2] << 4).astype(np.uint8).view(np.int64).tolist())
            over.append(int(np.maximum(counts - 4, 0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.list_(pa.int64())), pa.array(over, pa.int32())], names=["doc_id", "bits", "over"])


def _crossing_pairs(placed: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of entries of one n-gram in different components that pass all filters. One side leaves out the n-gram's largest
    component, so that a large group that is linked already meets only what isn't in it. The smaller document of a pair
    must share nearly all it has: unary histograms under AND, counted, bound the overlap from above."""
    largest = placed.groupBy("gram", "comp").agg(F.count("*").alias("members")).groupBy("gram").agg(F.max(F.struct("members", "comp")).alias("top")).select("gram", F.col("top.comp").alias("top"))
    full = cut(placed.join(largest, "gram").join(heads.select("doc_id", "grams").mapInArrow(_signatures, "doc_id long, bits array<long>, over int"), "doc_id"))
    other = full.select("gram", "top", *(F.col(c).alias("doc2" if c == "doc_id" else f"{c}2") for c in ("doc_id", "n", "place", "alone", "comp", "bits", "over")))
    common = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseAND(F.get("bits2", F.lit(i)))) for i in range(SLICES // 16)), F.least("over", "over2"))
    left = full.where("comp <> top").drop("top")
    joined = left.join(other, (left["gram"] == other["gram"]) & F.expr("comp <> comp2 and (comp2 = top or doc_id < doc2)") & _fits(num, den) & (common >= _least(num, den)))
    return joined.drop(other["gram"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents whose n-gram sets have Jaccard similarity num / den or more.

    Words are what stands between ASCII white space, A-Z lower-cased. A null or empty text has no n-grams and is its
    own component; one with fewer words than size has its whole sequence as its one n-gram. Rows that share an id are
    one document with the union of their sets, returned once for each row. A row with a null id takes no part: its
    n_shingles is returned with a null component. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = null_safe_source_sizes(rows, "text") // 6
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * shuffles, total // BUCKET)
    parts = buckets

    sent = rows.where("id is not null").mapInArrow(_send(size, buckets, parts), _SENT_DDL)
    counted = sent.groupBy("part").applyInArrow(tidy(_count(buckets, parts)), _SENT_DDL)
    gathered = counted.groupBy("part").applyInArrow(tidy(_gather(num, den)), _DOCS_DDL)
    del sent, counted
    table = cut(gathered, free=True)
    del gathered

    sets = table.where("grams is not null")
    entries = sets.select("doc_id", "n", "alone", "same", "grams").mapInArrow(_prefixes(num, den), "gram long, class binary, doc_id long, n int, place int, alone int")
    entries = cut(entries.groupBy("gram", "class").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("place").alias("place"), F.min("alone").alias("alone")).drop("class"))
    classes = sets.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")).where("members > 1")
    copies = sets.where("same is not null").select("doc_id", "same").join(classes, "same").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    copies = cut(copies)
    heads = cut(without(sets.select("doc_id", "n", "grams"), copies.select("a")))

    links = tested = None
    for turn in range(TURNS + 1):
        placed = _still_open(entries, links)
        if placed.isEmpty():
            break
        pairs = _star_pairs(placed, turn).where(_fits(num, den)) if turn < TURNS else _crossing_pairs(placed, heads, num, den)
        pairs = pairs.select(F.greatest("doc_id", "doc2").alias("a"), F.least("doc_id", "doc2").alias("b")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs)
        tested = tested.union(pairs) if tested else pairs
        found = _links(pairs, heads, num, den)
        links = cut(links.union(found) if links else found, free=True)

    final = cut(connected_components(links.union(copies) if links else copies))
    # a null id has no place in the table above: its n-grams are counted by themselves
    unnamed = rows.where("id is null").mapInArrow(_sizes(size), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    named = table.select("doc_id", "n", "rows").join(final, F.col("doc_id") == F.col("node"), "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "rows")
    repeated = named.where("rows > 1").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows", "i")
    return named.where("rows = 1").drop("rows").union(repeated).union(unnamed)


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(*text_buffers(batch.column(1)), size)[1])], names=["n_shingles"])

    return run


#: The same by all pairs of shared n-grams and a recursive walk over the links; for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS start FROM documents UNION SELECT l.y, r.start FROM reach r JOIN links l ON l.x = r.node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(start) FROM reach WHERE node = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
