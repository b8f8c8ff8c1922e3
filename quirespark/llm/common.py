"""Helpers shared by the training-data operators.

Text is handled a chunk of a few megabytes at a time as one byte array with
document offsets, so that numpy works over many documents per call and memory
does not depend on how many rows Spark puts into an Arrow batch.

Ids are integers below 2**62. An id that is no integer (a text such as "a7", a number too large for 64 bits) counts as
none in every operator: the row is handled like one with a null id, and null in the result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 2 << 20
_INT_TYPES = {"tinyint", "smallint", "int", "bigint"}


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the cluster's shared checkpoint folder and read again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


NO_ID = 1 << 62


def key_of(id_col: str, text_col: str) -> Column:
    """Bigint key of a row: its id, or for a null id a number from NO_ID on, made from the text; so ids come before rows without one."""
    made = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(F.col(f"`{id_col}`").try_cast("bigint"), made)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k (key), id (bigint, may be null), text (null becomes empty); nothing else survives."""
    return df.select(
        key_of(id_col, text_col).alias("k"), F.col(id_col).try_cast("bigint").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text over all rows."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text each, whole rows always."""
    for rb in batches:
        if not rb.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(rb.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < rb.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = min(max(to, at + 1), rb.num_rows)
            yield rb.slice(at, to - at)
            at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def strings(buf: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Arrow column of the byte ranges between offsets (string unless kind is given)."""
    data, n = pa.py_buffer(np.ascontiguousarray(buf)), len(off) - 1
    if off[-1] < 1 << 31:
        a = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32)), data])
    else:
        a = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64)), data])
    return a.cast(kind or pa.string())


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_pow = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, 1 << 16)
        for i, b in enumerate((BASE, _BASE_INV)):
            p = np.full(m, b, U)
            p[0] = 1
            _pow[i] = np.cumprod(p, dtype=U)
    return _pow[0], _pow[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many spans at once; equal spans have equal hashes wherever they lie."""
    n = len(codes)
    p, inv = _powers(n + 1)
    s = np.zeros(n + 1, U)
    np.cumsum(codes * p[:n], out=s[1:])
    return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space, never across documents), and where each document's words begin."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_WS[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = ink[full]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = ink[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_CODE[buf], starts, ends) if len(starts) else np.empty(0, U)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n)."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    o = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=o[1:])
    return np.repeat(starts - o, lens) + np.arange(total, dtype=np.int64)


class Blobs:
    """Rows gathered per bucket as packed columns, so that a shuffle moves few large rows.

    ``add`` takes a bucket number per row and equally long columns; ``take`` gives
    Arrow batches (bucket int, blob binary). A blob is read by ``unpack``.
    """

    schema = "bucket int, blob binary"

    def __init__(self, kinds: list[str], flush: int = 8 << 20):
        self.kinds, self.flush, self.held, self.size = [np.dtype(k) for k in kinds], flush, [], 0

    def add(self, bucket: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket.astype(np.int32), [c.astype(k, copy=False) for c, k in zip(cols, self.kinds)]))
            self.size += len(bucket) * sum(k.itemsize for k in self.kinds)
        if self.size >= self.flush:
            yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket = np.concatenate([b for b, _ in self.held])
        cols = [np.concatenate([c[i] for _, c in self.held]) for i in range(len(self.kinds))]
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[order], [c[order] for c in cols]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        to = np.r_[at[1:], len(bucket)]
        blobs = [b"".join([np.int64(e - s).tobytes(), *(c[s:e].tobytes() for c in cols)]) for s, e in zip(at, to)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """Columns of several blobs, concatenated."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for i, k in enumerate(kinds):
            out[i].append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds)]


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Whole buckets of a partition that is sorted by bucket, one at a time."""
    now, held = None, []
    for rb in batches:
        blobs = rb.column(1)
        for i, b in enumerate(rb.column(0).to_pylist()):
            blob = blobs[i].as_py()  # one at a time: no second copy of the batch
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def in_buckets(df: DataFrame, n: int) -> DataFrame:
    """Blob rows brought together by bucket: one shuffle of few, large rows. A bucket's number is its partition's, so no partition gets several by chance."""
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 from the top bits of a hash."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


class Spans:
    """Hashes of many spans of the same codes, asked for again and again."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        p, self.inv = _powers(n + 1)
        self.sum = np.zeros(n + 1, U)
        np.cumsum(codes * p[:n], out=self.sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sum[ends] - self.sum[starts]) * self.inv[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))
