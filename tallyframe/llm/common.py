"""Shared helpers of the training-data operators: hashing of words, packing of arrays, cutting of lineage."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the word-shingle operators: space and the controls from tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A run of anything but these; the same pattern in Java and in RE2.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Beyond this many bytes a single word goes through blake2b and not through the vectorised hash.
LONG_WORD = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master; on a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder. free: shuffle files that only the old lineage needed go now, and not at some time."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if free:
        release(out.sparkSession)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a batch between the JVM and a worker, where rows are whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let this session's batches to workers have BATCH_ROWS rows, if nobody has chosen a number: 10,000 texts are tens of MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The name under which a worker keeps what later tasks of the same kind can use again.
TASK_MEMORY = "tallyframe_task_memory"


def forget() -> None:
    """Drop what a worker keeps for later tasks: those of another kind have no use for it."""
    sys.modules.pop(TASK_MEMORY, None)


def give_back(keep: bool = False) -> None:
    """Return a worker's freed memory to the system at the end of a task: an idle worker needn't hold it. keep: what it keeps for later tasks stays."""
    if not keep:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function of a group's table that gives its memory back when it is through."""

    def inner(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return inner


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe_source_sizes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words_of(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased and padded bytes, starts, lengths, document of each word) of the concatenated texts."""
    low = np.zeros(len(raw) + 8, dtype=np.uint8)
    np.take(_LOWER, raw, out=low[: len(raw)])
    inside = np.zeros(len(raw) + 1, dtype=bool)
    np.logical_not(separator[raw], out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return low, starts, lengths, docs


def hash_spans(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: np.uint64 = _K) -> np.ndarray:
    """A 64-bit hash of each span of the padded bytes, eight bytes at a time; another odd k gives another hash."""
    eights = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), shape=(max(len(low) - 7, 1),), strides=(1,))
    h = mix64((eights[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * k)
    rest, at = np.flatnonzero(lengths > 8), 8
    while len(rest) and at < LONG_WORD:
        left = lengths[rest] - at
        h[rest] = mix64(h[rest] * k + (eights[starts[rest] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
    for i in rest:
        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(low[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstd; sorted integers should come as differences."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        parts += [np.array([len(a), a.itemsize], np.int64).tobytes(), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as unsigned integers of the same width."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    out, at = [], 8
    for _ in range(int(raw[:8].view(np.int64)[0])):
        n, width = (int(x) for x in raw[at : at + 16].view(np.int64))
        planes = raw[at + 16 : at + 16 + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").ravel())
        at += 16 + n * width
    return out


def differences(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


#: Rows of ids, or of other small keys, that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it should be cheap to count), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is among the one column of ids; null ids stay."""
    return docs.join(bounded(ids.toDF(id_col)), id_col, "left_anti").select(*docs.columns)
