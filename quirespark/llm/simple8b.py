"""Token ids as Simple-8b words.

A 64-bit word starts with a 4-bit selector that says how many ids of how many bits
follow. Each block of 256 ids is coded by itself and its first word's place is kept,
so decoding works on all blocks at once. Ids of more than 60 bits are escaped: selector
0 stands for one id in the next raw word. A word takes as many of the next ids as fit;
the last word of a block may be padded with zeros, whose number the block's length tells.

Defined results: a null list counts as an empty one; null ids inside a list are refused
by a null row in the output columns; negative ids go through the escape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, VOCABULARY, vocabulary
from .common import U, chunks, lists, record, strings, utf8

BLOCK = 256
#: ids and bits of selectors 1..15; selector 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


def pack(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offsets of documents, word offset of each block within its document, block offsets of documents)."""
    values = values.astype(np.int64).view(U)
    lens = np.diff(off)
    nb = -(-lens // BLOCK)
    boff = np.r_[0, np.cumsum(nb)]
    doc = np.repeat(np.arange(len(lens)), nb)
    k = np.arange(len(doc)) - boff[doc]
    bs = off[doc] + k * BLOCK
    be = np.minimum(bs + BLOCK, off[doc + 1])
    # Bits of each id.
    v = values.copy()
    bits = np.zeros(len(v), np.int8)
    for s in (32, 16, 8, 4, 2, 1):
        big = v >= (U(1) << U(s))
        bits += (s * big).astype(np.int8)
        v = np.where(big, v >> U(s), v)
    bits += (v > 0).astype(np.int8)
    # The selector of a word that starts at each id: the one of most ids that all fit; ids behind the block count as 0 bits.
    n = len(values)
    end = np.repeat(be, be - bs)
    left = end - np.arange(n)
    sel = np.zeros(n, np.int8)
    wide = {1: bits}
    for w in (2, 4, 8, 16, 32, 64):  # widest id of windows of powers of two, not looking past the block
        a = wide[w // 2]
        b = np.zeros(n, np.int8)
        h = w // 2
        b[: max(0, n - h)] = a[h:]
        wide[w] = np.maximum(a, np.where(left > h, b, 0)) if n > h else a
    for s in range(15, 0, -1):
        c = int(COUNT[s])
        p = 1 << (c.bit_length() - 1)
        p = min(p, 64)
        m = wide[p]
        if c > p:
            h = c - p
            b = np.zeros(n, np.int8)
            b[: max(0, n - h)] = m[h:]
            m = np.maximum(m, np.where(left > h, b, 0))
        sel[m <= BITS[s]] = s
    took = COUNT[sel]
    # All blocks in step: one word of each per round.
    at, live = bs.copy(), np.arange(len(bs))
    live = live[bs < be]
    who, where = [], []
    while len(live):
        who.append(live)
        where.append(at[live])
        at[live] += took[at[live]]
        live = live[at[live] < be[live]]
    if not who:
        return np.empty(0, U), np.zeros(len(off), np.int64), np.empty(0, np.int32), boff
    who, where = np.concatenate(who), np.concatenate(where)
    where = where[np.lexsort((where, who))]
    who = np.sort(who)
    s = sel[where].astype(np.int64)
    size = 1 + (s == 0)
    first = np.r_[0, np.cumsum(size)]
    word = np.zeros(int(first[-1]), U)
    word[first[:-1]] = s.astype(U)
    raw = np.flatnonzero(s == 0)
    word[first[raw] + 1] = values[where[raw]]
    for q in range(2, 16):
        r = np.flatnonzero(s == q)
        if not len(r):
            continue
        x = word[first[r]]
        for j in range(int(COUNT[q])):
            i = where[r] + j
            ok = i < be[who[r]]
            x[ok] |= values[i[ok]] << U(4 + j * int(BITS[q]))
        word[first[r]] = x
    block_at = first[np.searchsorted(who, np.arange(len(bs)))]
    doc_at = np.r_[block_at, len(word)][boff]
    return word, doc_at, (block_at - doc_at[doc]).astype(np.int32), boff


def unpack(word: np.ndarray, doc_at: np.ndarray, lens: np.ndarray, block_at: np.ndarray, boff: np.ndarray) -> np.ndarray:
    """Flat ids of all documents: one step decodes a word of every block."""
    lens = lens.astype(np.int64)
    off = np.r_[0, np.cumsum(lens)]
    doc = np.repeat(np.arange(len(lens)), np.diff(boff))
    at = doc_at[doc] + block_at
    to = off[doc] + (np.arange(len(doc)) - boff[doc]) * BLOCK
    end = np.minimum(to + BLOCK, off[doc + 1])
    out = np.zeros(int(off[-1]), U)
    live = np.flatnonzero(to < end)
    while len(live):
        w = word[at[live]]
        s = (w & U(15)).astype(np.int64)
        for q in np.unique(s).tolist():
            r = live[s == q]
            if q == 0:
                out[to[r]] = word[at[r] + 1]
                continue
            if q == 1:
                continue
            x, mask = w[s == q], U((1 << int(BITS[q])) - 1)
            for j in range(int(COUNT[q])):
                i = to[r] + j
                ok = i < end[r]
                out[i[ok]] = (x[ok] >> U(4 + j * int(BITS[q]))) & mask
        to[live] += COUNT[s]
        at[live] += 1 + (s == 0)
        live = live[to[live] < end[live]]
    return out.view(np.int64)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int32()), ("n_words", pa.int32()), ("block_offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("round_trip", pa.bool_())])
_DDL = "doc_id bigint, n_ids int, n_words int, block_offsets array<int>, words binary, round_trip boolean"


def _rows(ids_col, values: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    word, doc_at, block_at, boff = pack(values, off)
    same = unpack(word, doc_at, np.diff(off), block_at, boff) == values
    bad = np.r_[0, np.cumsum(~same)]
    return record(_OUT, ids_col, np.diff(off).astype(np.int32), np.diff(doc_at).astype(np.int32), lists(block_at, boff, pa.int32()), strings(word.view(np.uint8), doc_at * 8, pa.binary()), bad[off[1:]] == bad[off[:-1]])


def encode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Texts to token ids to words, in one pass: doc_id, n_ids, n_words, block_offsets, words, round_trip."""

    def run(batches):
        bpe = vocabulary(path)
        for rb in chunks(batches, most=CHUNK):
            ids, off = bpe.encode(*utf8(rb.column(1)))
            yield _rows(rb.column(0), ids.astype(np.int64), off)

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _DDL)


def encode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The same from a column of ids (array of integers)."""

    def run(batches):
        for rb in batches:
            a = rb.column(1)
            a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
            rows = [x for x in a.to_pylist()]
            ok = [x is None or None not in x for x in rows]
            rows = [(x or []) if g else [] for x, g in zip(rows, ok)]
            off = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64)
            out = _rows(rb.column(0), np.fromiter((i for x in rows for i in x), np.int64, int(off[-1])), off)
            if not all(ok):
                keep = pa.array(ok)
                cols = [out.column(0)] + [pa.compute.if_else(keep, c, pa.nulls(len(ok), c.type)) for c in out.columns[1:]]
                out = pa.RecordBatch.from_arrays(cols, schema=_OUT)
            yield out

    return tokens.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids")).mapInArrow(run, _DDL)


def decode_ids(coded: DataFrame) -> DataFrame:
    """doc_id, ids from what the encoders return; null where words are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            buf, at = utf8(rb.column(2))
            n = np.nan_to_num(rb.column(1).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            nb = -(-n // BLOCK)
            offs = np.array([o for x in rb.column(3).to_pylist() for o in (x or [])], np.int64)
            ids = unpack(np.ascontiguousarray(buf).view(U), at // 8, n, offs, np.r_[0, np.cumsum(nb)])
            out = lists(ids, np.r_[0, np.cumsum(n)], pa.int64())
            yield record(schema, rb.column(0), pa.compute.if_else(rb.column(2).is_valid(), out, pa.nulls(len(out), out.type)))

    return coded.select("doc_id", "n_ids", "words", "block_offsets").mapInArrow(run, "doc_id bigint, ids array<bigint>")
