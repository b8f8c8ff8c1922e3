"""SimHash near-duplicates by deletion-variant signatures.

A document's signature has 128 bits, over its set of distinct words (lower case). Two
signatures are linked if they differ in at most 19 bits and one of 14 segments differs in at
most one: 7 segments, and 7 more with the bits in another order. Signatures that differ in up
to 13 bits always have such a segment (13 differences cannot put two into each of 7), so
up to there the link is the distance alone; of pairs at 19 bits about 0.98 are linked. Documents
are near-duplicates along chains of links. No cap, no sampling.

A segment is indexed by its variants with one bit left out: equal variants are candidates,
and every candidate is verified over 128 bits. To index 128 variants per signature without
shuffling 128 rows, a segment is cut into parts and a signature goes once per part to the
bucket of all the other parts. Wherever the left-out bit lies, both partners are in the bucket
without that part, where the variants are made, sorted and joined on equality as arrays. The
more signatures, the more parts (2 to the segment's width), so that a bucket's key has bits enough
for its rows to be as many at any size; the links are the same. Within a bucket verified pairs become
stars, so a group of thousands of copies sends one edge per member. Groups are the connected
components. Of each group the least doc_id stays. With 18-bit segments candidates grow as
the square of the signatures over 2**17; ``segments=4`` (32 bits, exact up to 7) is for
corpora of billions.

Defined results: null and empty texts are copies of each other; texts of the same words are
copies whatever the order; rows that share a doc_id are one document, of which one row
stays (the first by its JSON); a null id is a document of its own per distinct text, whose key
comes after every integer id (below 2**62), so it stays only in a group without an integer id,
and such a group's group_id is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE_CODE, NO_ID, Blobs, U, by_bucket, chunks, cut, in_buckets, key_of, keyed, mix, ranges, record, span_hashes, unpack, utf8, words
from .components import components
from .quality import _LOWER

SEGMENTS = 7
MOST = 19
_ORDERS = (np.arange(128), np.arange(128) * 53 % 128)
ROWS_PER_BUCKET = 60_000
_SIG = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
_M52 = U((1 << 52) - 1)


def sign(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower 64 bits of each document's signature."""
    n = len(off) - 1
    starts, ends, first = words(buf, off)
    out = np.zeros((n, 16), np.uint8)
    if len(starts):
        h = span_hashes(BYTE_CODE[_LOWER[buf]], starts, ends)
        doc = np.repeat(np.arange(n, dtype=U), np.diff(first))
        for lo in range(0, n, 4096):  # 12 bits of document beside 52 of hash
            a, b = first[lo], first[min(n, lo + 4096)]
            if a == b:
                continue
            key = np.sort(((doc[a:b] - U(lo)) << U(52)) | (h[a:b] >> U(12)))
            key = key[np.r_[True, key[1:] != key[:-1]]]
            d = (key >> U(52)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            m = key & _M52
            bits = np.unpackbits(np.stack([mix(m), mix(m ^ U(0x5851F42D4C957F2D))], 1).view(np.uint8), axis=1)
            count = np.diff(np.r_[at, len(key)])
            total = np.stack([bits[s : s + c].sum(0, dtype=np.int32) for s, c in zip(at.tolist(), count.tolist())])
            out[lo + d[at]] = np.packbits(2 * total > count[:, None], axis=1)
    v = out.view(U)
    return v[:, 0].copy(), v[:, 1].copy()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for rb in chunks(batches, "text"):
            hi, lo = sign(*utf8(rb.column(2)))
            yield record(_SIG, rb.column(0), rb.column(1), hi.view(np.int64), lo.view(np.int64))

    return keyed(docs, id_col, text_col).mapInArrow(run, "k bigint, id bigint, hi bigint, lo bigint")


def bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    at = [128 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def reordered(hi: np.ndarray, lo: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures with their bits in another order."""
    bits = np.unpackbits(np.stack([lo, hi], 1).view(np.uint8), axis=1, bitorder="little")[:, order]
    v = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(U)
    return v[:, 1].copy(), v[:, 0].copy()


def segment(hi: np.ndarray, lo: np.ndarray, at: int, width: int) -> np.ndarray:
    mask = U((1 << width) - 1)
    if at + width <= 64:
        return (lo >> U(at)) & mask
    if at >= 64:
        return (hi >> U(at - 64)) & mask
    return ((lo >> U(at)) | (hi << U(64 - at))) & mask


class Stars:
    """Components of the pairs seen in one bucket, as (member, least member)."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            live = x != y
            if not live.any():
                return
            a, b, x, y = a[live], b[live], x[live], y[live]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def parts(width: int, rows: int) -> list[tuple[int, int]]:
    """First bit and width of the parts of a segment: the fewest that leave a bucket key of enough values for so many rows."""
    for t in (2, 3, 6):
        if 1 << (width - -(-width // t)) >= rows // ROWS_PER_BUCKET:
            break
    else:
        t = width
    at = [width * i // t for i in range(t + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def near_pairs(hi: np.ndarray, lo: np.ndarray, most: int, seg: np.ndarray, free: range, same: bool, step: int = 2_000_000):
    """Verified pairs whose segments agree (if ``same``) or differ in one of the ``free`` bits."""

    def candidates(starts, lens):
        total = np.r_[0, np.cumsum(lens)]
        at = 0
        while at < len(lens):
            to = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
            yield np.repeat(np.arange(at, to), lens[at:to]), ranges(starts[at:to], lens[at:to])
            at = to

    def ok(a, b):
        near = np.bitwise_count(hi[a] ^ hi[b]).astype(np.int16) + np.bitwise_count(lo[a] ^ lo[b]) <= most
        return a[near], b[near]

    if same:
        o = np.argsort(seg, kind="stable")
        s = seg[o]
        end = np.searchsorted(s, s, side="right")
        for i, j in candidates(np.arange(1, len(o) + 1), end - np.arange(len(o)) - 1):
            yield ok(o[i], o[j])
    for bit in free:
        b = U(1 << bit)
        on = (seg & b) != 0
        zero, one = np.flatnonzero(~on), np.flatnonzero(on)
        zs, os_ = seg[zero], seg[one] ^ b  # both without the bit: the variant
        one = one[np.argsort(os_, kind="stable")]
        os_ = np.sort(os_)
        first = np.searchsorted(os_, zs, side="left")
        for i, j in candidates(first, np.searchsorted(os_, zs, side="right") - first):
            yield ok(zero[i], one[j])


def edges(sigs: DataFrame, count: int, segments: int = SEGMENTS) -> DataFrame:
    """Star edges (a, b) between representatives of linked signatures; ``sigs`` has rep, hi, lo, about ``count`` rows."""
    segs = bounds(segments)
    cuts = [parts(width, count) for _, width in segs]
    each = max(map(len, cuts))
    split = max(1, -(-count // ROWS_PER_BUCKET))
    kinds = ["i8", "u8", "u8"]

    def send(batches):
        blobs = Blobs(kinds)
        for rb in batches:
            rep, hi, lo = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            hi, lo = hi.view(U), lo.view(U)
            for t, order in enumerate(_ORDERS):
                h, l = reordered(hi, lo, order)
                for s, (at, width) in enumerate(segs):
                    x = segment(h, l, at, width)
                    for part, (first, size) in enumerate(cuts[s]):
                        rest = x & U(~(((1 << size) - 1) << first) & ((1 << 64) - 1))
                        yield from blobs.add((mix(rest + U(1)) % U(split)).astype(np.int32) + ((t * segments + s) * each + part) * split, rep, hi, lo)
        yield from blobs.take()

    def meet(batches):
        for bucket, held in by_bucket(batches):
            rep, hi, lo = unpack(held, kinds)
            o = np.argsort(rep, kind="stable")
            rep, hi, lo = rep[o], hi[o], lo[o]
            s, part = divmod(bucket // split, each)
            at, width = segs[s % segments]
            first, size = cuts[s % segments][part]
            stars = Stars(len(rep))
            for a, b in near_pairs(hi, lo, max(MOST, 2 * segments - 1), segment(*reordered(hi, lo, _ORDERS[s // segments]), at, width), range(first, first + size), part == 0):
                stars.add(a, b)
            m = np.flatnonzero(stars.label != np.arange(len(rep)))
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(rep[m]), pa.array(rep[stars.label[m]])], ["a", "b"])

    sent = sigs.select("rep", "hi", "lo").mapInArrow(send, Blobs.schema)
    return in_buckets(sent, max(12, 2 * segments * split)).mapInArrow(meet, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """(k, id, hi, lo, root): each row's key, id, signature and the key of its group's document that stays."""
    sigs = cut(signatures(docs, id_col, text_col))
    reps = sigs.groupBy("hi", "lo").agg(F.min("k").alias("rep"))
    linked = components(edges(reps, sigs.count(), segments).union(_same_key(sigs)))
    rooted = reps.join(linked, reps.rep == linked.node, "left").select("hi", "lo", F.coalesce("root", "rep").alias("root"))
    return sigs.join(rooted, ["hi", "lo"]).select("k", "id", "hi", "lo", "root")


def _same_key(sigs: DataFrame) -> DataFrame:
    """Edges between the signatures' representatives of rows that share a key though their texts differ."""
    w = Window.partitionBy("hi", "lo")
    several = sigs.groupBy("k").agg(F.min(F.struct("hi", "lo")).alias("x"), F.max(F.struct("hi", "lo")).alias("y")).where("x <> y").select("k")
    reps = sigs.join(several, "k", "left_semi").select("hi", "lo").distinct().join(sigs, ["hi", "lo"]).groupBy("hi", "lo").agg(F.min("k").alias("rep"))
    s = sigs.join(several, "k", "left_semi").join(reps, ["hi", "lo"])
    return s.select(F.col("k").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """doc_id, group_id (the group's least doc_id), group_rows (rows of the group), duplicate (whether another document of the group stays instead); one row per row."""
    g = cut(groups(docs, id_col, text_col, segments).select("k", "id", "root"))
    size = g.groupBy("root").agg(F.count("*").alias("group_rows"))
    return g.join(size, "root").select(
        F.col("id").alias("doc_id"), F.when(F.col("root") < NO_ID, F.col("root")).alias("group_id"), "group_rows", (F.col("k") != F.col("root")).alias("duplicate"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates: one row per group, all columns."""
    g = cut(groups(docs, id_col, text_col, segments).groupBy("k").agg(F.min("root").alias("root"), F.count("*").alias("n")).where("root <> k or n > 1"))
    gone, once = g.where("root <> k").select("k"), g.where("root = k and n > 1").select("k")
    rows = docs.select(F.struct("*").alias("r"), key_of(id_col, text_col).alias("k"))
    kept = rows.join(gone, "k", "left_anti")
    if once.isEmpty():
        return kept.select("r.*")
    first = kept.join(once, "k", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.to_json("r")))).where("rn = 1").select("r.*")
    return kept.join(once, "k", "left_anti").select("r.*").union(first)
