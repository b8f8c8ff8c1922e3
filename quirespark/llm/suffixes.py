"""Repeated passages by difference-cover blockwise suffix grouping.

Suffixes start at words; a passage is a run of at least ``LENGTH`` words that occurs at
two places. The whole corpus is never ordered at once:

1. Cover sample. Positions p with p mod 31 in a perfect difference set, 6 of 31. For any two
   suffixes some shift below 31 puts both into the sample, so two equal runs of 50 words hold
   sampled suffixes that agree on 20 words. The sample is ordered by its first 20 words (by
   their hash: any fixed order of words serves), bucket by bucket, and suffixes that share
   their place are tied. What ties within a task is told at once, and one of it goes on, so a
   passage of very many documents sends a row per task.
2. Blocks. Only suffixes that a tied cover suffix can reach within its shift may be part of a
   repeat; the rest are proven unique by step 1. They are ordered by their first 50
   words, one bucket (a range of the order) at a time, so memory is a bucket's. Suffixes that
   stay equal through all 50 (two hashes of 96 bits in all) are a repeat; their order is by
   (doc_id, position), and the first of them is the occurrence that stays.
3. Passages. Repeated windows of a document are joined to spans.

This departs from a suffix array: order is needed up to 50 words only, which one hash of a window
gives, so no tie is left for cover ranks to resolve; see the README for what ranks would cost.
Buckets travel as packed columns. Every window of the corpus is covered: nothing is sampled
away, no group is capped.

Defined results: words are separated by ASCII white space; texts of fewer words have no
passage; null and empty texts stay as they are; equal rows (same id, same text) are one
document and do not repeat each other; repeats within a document count, and of overlapping
ones the first window stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Blobs, Spans, U, by_bucket, chunks, cut, in_buckets, key_of, keyed, lists, mix, ranges, record, spread, strings, total_bytes, unpack, utf8, word_hashes, words

LENGTH = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every difference modulo 31 occurs once
ROWS_PER_BUCKET = 250_000
DOC_BUCKET_BYTES = 8 << 20
CHUNK = 512 << 10  # bytes of text that are hashed at a time
_SAMPLE = ["u8", "i8", "i4"]
_WINDOW = ["u8", "u4", "i8", "i4"]
_TIED = ["i8", "i4"]
_SEEN = ["i8", "i4", "i8", "i4"]


def _sorted_groups(h: np.ndarray, more: np.ndarray, k: np.ndarray, i: np.ndarray):
    """Rows of hashes that occur at more than one place, ordered by (hashes, key, position), and where each begins."""
    o = np.argsort(h, kind="stable")
    s = h[o]
    eq = s[1:] == s[:-1]
    o = o[np.r_[eq, False] | np.r_[False, eq]]
    o = o[np.lexsort((i[o], k[o], more[o], h[o]))]
    h, more, k, i = h[o], more[o], k[o], i[o]
    if not len(h):
        return h, k, i, np.empty(0, np.int64)
    same = np.r_[False, (h[1:] == h[:-1]) & (more[1:] == more[:-1])]
    once = ~(same & np.r_[False, (k[1:] == k[:-1]) & (i[1:] == i[:-1])])  # equal rows are one place
    h, more, k, i = h[once], more[once], k[once], i[once]
    new = np.r_[True, (h[1:] != h[:-1]) | (more[1:] != more[:-1])]
    size = np.diff(np.r_[np.flatnonzero(new), len(h)])
    many = np.repeat(size > 1, size)
    return h[many], k[many], i[many], np.flatnonzero(new[many])


def repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, at, first_k, first_at): arrays per document of the windows that repeat, and the first occurrence of each."""
    if length < PERIOD:
        raise ValueError(f"passages must have at least {PERIOD} words")
    d = keyed(docs, id_col, text_col)
    short = length - PERIOD + 1
    size = total_bytes(d)
    n_sample = max(8, int(size / 6 * len(COVER) / PERIOD) // ROWS_PER_BUCKET)
    n_docs = max(8, size // DOC_BUCKET_BYTES)
    residue = np.zeros(PERIOD, bool)
    residue[list(COVER)] = True

    def cover(batches):
        blobs, held, size = Blobs(_SAMPLE), [], 0

        def flush():
            h, k, i = (np.concatenate(c) for c in zip(*held))
            th, tk, ti, at = _sorted_groups(h, np.zeros(len(h), np.uint8), k, i)
            once = ~np.isin(h, th[at])
            yield from blobs.add(n_sample + spread(mix(tk.view(U)), n_docs), th, tk, ti)  # tied, whatever else there is
            for rows in ((h[once], k[once], i[once]), (th[at], tk[at], ti[at])):
                yield from blobs.add(spread(rows[0], n_sample), *rows)

        for rb in chunks(batches, most=CHUNK):
            buf, off = utf8(rb.column(2))
            s, e, first = words(buf, off)
            at = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(s))
            p = np.flatnonzero(residue[at % PERIOD] & (left >= short) & (np.repeat(np.diff(first), np.diff(first)) >= length))
            if not len(p):
                continue
            held.append((Spans(word_hashes(buf, s, e))(p, p + short), np.repeat(rb.column(0).to_numpy(), np.diff(first))[p], at[p]))
            size += len(p)
            if size > ROWS_PER_BUCKET:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        yield from blobs.take()

    def ties(batches):
        blobs = Blobs(_TIED)
        for bucket, held in by_bucket(batches):
            h, k, i = unpack(held, _SAMPLE)
            if bucket < n_sample:
                _, k, i, _ = _sorted_groups(h, np.zeros(len(h), np.uint8), k, i)
            yield from blobs.add(spread(mix(k.view(U)), n_docs), k, i)
        yield from blobs.take()

    def per_doc(batches):
        for _, held in by_bucket(batches):
            k, i = unpack(held, _TIED)
            o = np.lexsort((i, k))
            k, i = k[o], i[o]
            once = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]
            k, i = k[once], i[once]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), strings(i.astype("<i4").view(np.uint8), np.r_[at, len(k)] * 4, pa.binary())], ["tk", "tied"])

    tied = in_buckets(in_buckets(d.mapInArrow(cover, Blobs.schema), n_sample + min(n_docs, n_sample)).mapInArrow(ties, Blobs.schema), n_docs).mapInArrow(per_doc, "tk bigint, tied binary")
    tied = cut(tied)
    n_tied = tied.agg(F.sum(F.length("tied"))).first()[0] or 0
    n_block = max(8, n_tied // 4 * PERIOD // len(COVER) // ROWS_PER_BUCKET)

    def blocks(batches):
        blobs = Blobs(_WINDOW)
        for rb in chunks(batches, most=CHUNK):
            buf, off = utf8(rb.column(2))
            s, e, first = words(buf, off)
            count = np.diff(first)
            raw, toff = utf8(rb.column(3))
            p = np.frombuffer(raw.tobytes(), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(rb.num_rows), np.diff(toff) // 4)
            lo = first[doc] + np.maximum(p - PERIOD + 1, 0)
            hi = first[doc] + np.minimum(p, count[doc] - length) + 1  # windows must end within the document
            ok = lo < hi
            mark = np.zeros(len(s) + 1, np.int32)
            np.add.at(mark, lo[ok], 1)
            np.subtract.at(mark, hi[ok], 1)
            w = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            if not len(w):
                continue
            codes = word_hashes(buf, s, e)
            h, more = Spans(codes)(w, w + length), Spans(mix(codes ^ U(0x5851F42D4C957F2D)))(w, w + length) >> U(32)
            at = w - np.repeat(first[:-1], count)[w]
            yield from blobs.add(spread(h, n_block), h, more, np.repeat(rb.column(0).to_numpy(), count)[w], at)
        yield from blobs.take()

    def repeats(batches):
        blobs = Blobs(_SEEN)
        for _, held in by_bucket(batches):
            _, k, i, at = _sorted_groups(*unpack(held, _WINDOW))
            size = np.diff(np.r_[at, len(k)])
            yield from blobs.add(spread(mix(k.view(U)), n_docs), k, i, np.repeat(k[at], size), np.repeat(i[at], size))
        yield from blobs.take()

    def windows(batches):
        for _, held in by_bucket(batches):
            k, i, fk, fi = unpack(held, _SEEN)
            o = np.lexsort((i, k))
            k, i, fk, fi = k[o], i[o], fk[o], fi[o]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            off = np.r_[at, len(k)]
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), *(strings(np.ascontiguousarray(x).view(np.uint8), off * x.itemsize, pa.binary()) for x in (i, fk, fi))], ["wk", "at", "first_k", "first_at"])

    whole = d.join(tied, d.k == tied.tk).select("k", "id", "text", "tied")
    sent = in_buckets(whole.mapInArrow(blocks, Blobs.schema), n_block).mapInArrow(repeats, Blobs.schema)
    return in_buckets(sent, n_docs).mapInArrow(windows, "wk bigint, at binary, first_k binary, first_at binary")


def spans_of(k: int, at: np.ndarray, first_k: np.ndarray, first_at: np.ndarray, length: int) -> list[tuple[int, int, bool, int]]:
    """(start, end, stays, first document) of one document, in words: windows joined to spans, first and later occurrences apart.

    A later window that overlaps its own first occurrence begins where that ends.
    """
    out = []
    own = first_k == k
    stays = own & (first_at == at)
    start = np.where(own & ~stays, np.maximum(at, first_at + length), at)
    for flag in (True, False):
        m = np.flatnonzero(stays == flag)
        if not len(m):
            continue
        o = m[np.argsort(start[m], kind="stable")]
        s, e = start[o].astype(np.int64), at[o].astype(np.int64) + length
        top = np.maximum.accumulate(e)
        new = np.r_[True, s[1:] > top[:-1]]
        b = np.flatnonzero(new)
        out += list(zip(s[b].tolist(), top[np.r_[b[1:], len(s)] - 1].tolist(), [flag] * len(b), np.minimum.reduceat(first_k[o], b).tolist()))
    return out


def _windows(rb: pa.RecordBatch, names=("at", "first_k", "first_at")):
    cols = [rb.column(rb.schema.get_field_index(n)).to_pylist() for n in names]
    for a, b, c in zip(*cols):
        yield None if a is None else (np.frombuffer(a, "<i4"), np.frombuffer(b, "<i8"), np.frombuffer(c, "<i4"))


_OUT = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("stays", pa.bool_()), ("first_doc_id", pa.int64())])


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, stays, first_doc_id: every passage of at least ``length`` words that occurs elsewhere, with the document of its first occurrence."""

    def run(batches):
        for rb in batches:
            rows = []
            for k, w in zip(rb.column(0).to_pylist(), _windows(rb)):
                rows += [(k if k < NO_ID else None, s, e, flag, f if f < NO_ID else None) for s, e, flag, f in spans_of(k, *w, length)]
            if rows:
                yield record(_OUT, *map(list, zip(*rows)))

    return repeated_windows(docs, length, id_col, text_col).mapInArrow(run, "doc_id bigint, start_word int, end_word int, stays boolean, first_doc_id bigint")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words of the spans; the white space before a kept word stays."""
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    s, e, _ = words(buf, np.array([0, len(buf)]))
    parts, at = [], 0
    for a, b in spans:
        cut_from = int(s[a]) if b < len(s) else (int(e[a - 1]) if a else 0)
        parts.append(raw[at : max(at, cut_from)])
        at = int(s[b]) if b < len(s) else int(e[-1])
    return b"".join([*parts, raw[at:]]).decode()


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; from the text every later occurrence of a repeated passage is gone."""
    w = repeated_windows(docs, length, id_col, text_col)
    rows = docs.select(F.struct("*").alias("r"), key_of(id_col, text_col).alias("k"), F.col(text_col).alias("t"))
    joined = rows.join(w, rows.k == w.wk, "left").select("r", "k", "t", "at", "first_k", "first_at")

    def run(batches):
        for rb in batches:
            texts = []
            for k, t, x in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), _windows(rb)):
                later = sorted((s, e) for s, e, stays, _ in spans_of(k, *x, length) if not stays) if x is not None and t is not None else []
                texts.append(without(t, later) if later else t)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(texts, pa.string())], ["r", "t"])

    done = joined.mapInArrow(run, f"r {docs.schema.simpleString()}, t string")
    return done.select(F.col("r").withField(f"`{text_col}`", F.col("t")).alias("r")).select("r.*")
