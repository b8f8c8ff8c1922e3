"""Improbable-feature digests of documents.

Every window of 64 bytes has an entropy. Windows of rare entropy, counted over the whole
corpus, are improbable and rank low; in every run of 64 successive windows the
lowest rank (leftmost of equals) scores a point, and windows of at least 16 points are the
document's features. Features are hashed into chained Bloom filters of 256 bytes, 160
features each. Two digests are compared filter by filter through the bits they share, normalised
between what chance shares and what equality shares (0..100).

The search takes as queries every row whose id is divisible by ``every`` (20; 1 for all)
and compares them with all rows. Documents of equal features are a class; two classes are linked
if they share at least half of the features of the smaller, and the score of a link is that of the
digests. A link must show in any choice of more than half of the smaller's features, so of each
class only the cheapest such choice is looked up (those that fewest others hold), and those held
by nobody on the other side need not be: a passage that very many documents share is looked up only for
documents that are mostly that passage. Where holders of a feature are very many they are spread over
all buckets and the look-ups sent to each. No link is lost and nothing is capped.

Defined results: null, empty and short texts (under 127 bytes) have no feature, an empty
digest, no class and no match; equal rows match with 100 if their ids differ; rows that share an
id do not match each other; of equal scores the least id is the match; rows without an id are
no queries, but are found (with a null match_id). Classes are told apart by a 64-bit hash of their
features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE_CODE, NO_ID, Blobs, Spans, U, by_bucket, chunks, cut, in_buckets, keyed, mix, record, spread, strings, unpack, utf8

WINDOW = 64
RUN = 64
POPULAR = 16
BINS = 1001
LOWEST = 100  # windows of less entropy (of 1000) are never features
FILTER_BITS = 2048
PER_FILTER = 160
_F = np.round(np.array([0.0, *[c * np.log2(c) for c in range(1, WINDOW + 1)]]) * (1 << 20)).astype(np.int64)
_FEATURES_PER_BUCKET = 100_000
_BLOCK = 1024  # holders of a feature that are paired at once
_HOT = 64  # holders of a feature among those that a task sends at a time, beyond which they are spread
_POSTING = ["u8", "i8", "i4", "u1", "i4"]  # feature, class, number of the class's features, flags, others that hold it
_QUERY, _MORE, _SPREAD, _PROBE = 1, 2, 4, 8


def entropies(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy (0..1000) of the window at every byte, and the number of windows of each document; what runs over a document's end is void."""
    n = len(buf)
    count = np.maximum(np.diff(off) - WINDOW + 1, 0)
    if n < WINDOW:
        return np.zeros(n, np.int16), count
    order = np.argsort(buf, kind="stable")
    value = order + buf[order].astype(np.int64) * (n + 2 * WINDOW)
    rank = np.arange(n)
    last = np.searchsorted(value, value + WINDOW - 1, side="right")  # equal bytes within the next 63
    ahead = last - rank - 1
    # How many ranges (r, r + ahead] cover each rank: equal bytes within the 63 before.
    step = np.zeros(n + 2, np.int64)
    step[1 : n + 1] += 1
    step -= np.bincount(last, minlength=n + 2)
    before = np.cumsum(step)[:n]
    enter, leave = np.empty(n, np.int64), np.empty(n, np.int64)
    enter[order] = _F[before + 1] - _F[before]
    leave[order] = _F[ahead] - _F[ahead + 1]
    total = np.cumsum(enter)
    gone = np.r_[0, np.cumsum(leave)]
    out = np.zeros(n, np.int16)
    f = total[WINDOW - 1 :] + gone[: n - WINDOW + 1]
    out[: n - WINDOW + 1] = np.clip((1000 * ((6 * WINDOW << 20) - f)) // (6 * WINDOW << 20), 0, 1000)
    return out, count


def ranks_of(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy: the fewer windows have it, the lower."""
    out = np.empty(BINS, np.int64)
    out[np.lexsort((np.arange(BINS), histogram))] = np.arange(BINS)
    out[:LOWEST] = BINS
    return out


def features(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows, distinct within a document and in order, and each document's offset into them."""
    n, none = len(buf), (np.empty(0, U), np.zeros(len(off), np.int64))
    e, count = entropies(buf, off)
    runs = np.maximum(count - RUN + 1, 0)
    if not runs.sum():
        return none
    bits = max(1, int(n).bit_length())
    key = (rank[e] << bits) + np.arange(n)
    m = key
    for s in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-s], m[s:])
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, off[:-1][runs > 0], 1)
    np.subtract.at(valid, (off[:-1] + runs)[runs > 0], 1)
    low = m[np.flatnonzero(np.cumsum(valid)[: len(m)])]
    low = low[low >> bits < BINS] & ((1 << bits) - 1)
    p = np.flatnonzero(np.bincount(low, minlength=n) >= POPULAR)
    if not len(p):
        return none
    h = Spans(BYTE_CODE[buf])(p, p + WINDOW)
    doc = np.searchsorted(off, p, side="right") - 1
    o = np.lexsort((p, h, doc))
    first = np.r_[True, (h[o][1:] != h[o][:-1]) | (doc[o][1:] != doc[o][:-1])]
    keep = np.sort(o[first])
    return h[keep], np.searchsorted(p[keep], off)


def digest(h: np.ndarray) -> np.ndarray:
    """Chained filters of a document's features, [filters, bytes]."""
    k = -(-len(h) // PER_FILTER)
    bits = np.zeros((k, FILTER_BITS), np.uint8)
    chain = np.arange(len(h)) // PER_FILTER
    for j in range(5):
        bits[chain, ((h >> U(11 * j)) & U(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> int:
    """0..100 of two digests: for each filter of the shorter the best of the other, averaged."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    x, y = a.view(U), b.view(U)
    na, nb = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    both = np.stack([np.bitwise_count(r & y).sum(1, dtype=np.int64) for r in x])
    most = np.minimum(na[:, None], nb[None]).astype(float)
    chance = na[:, None] * nb[None] / FILTER_BITS
    cutoff = chance + 0.3 * (most - chance)
    s = np.where(both > cutoff, (both - cutoff) / np.maximum(most - cutoff, 1e-9), 0.0)
    return int(round(100 * float(s.max(1).mean())))


def histogram(docs: DataFrame) -> np.ndarray:
    """Windows of each entropy over the whole corpus."""

    def run(batches):
        acc = np.zeros(BINS, np.int64)
        for rb in chunks(batches):
            buf, off = utf8(rb.column(2))
            e, count = entropies(buf, off)
            ok = np.zeros(len(buf) + 1, np.int32)
            np.add.at(ok, off[:-1][count > 0], 1)
            np.subtract.at(ok, (off[:-1] + count)[count > 0], 1)
            acc += np.bincount(e[np.cumsum(ok)[:-1] > 0], minlength=BINS)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], ["b", "n"])

    out = np.zeros(BINS, np.int64)
    for r in docs.mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most 1,001 rows
        out[r.b] = r.n
    return out


def _needed(n: np.ndarray) -> np.ndarray:
    return (n + 1) // 2


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _postings(classes: DataFrame, n: int) -> DataFrame:
    """Blobs by feature: every holder, but of more than ``_HOT`` in one go only so many, queries first; the rest goes to its class's bucket at once."""

    def send(batches):
        blobs, held, size = Blobs(_POSTING), [], 0

        def flush():
            h, g, m, f = (np.concatenate(c) for c in zip(*held))
            o = np.lexsort((g, f & _QUERY == 0, h))
            h, g, m, f = h[o], g[o], m[o], f[o]
            at = _runs(h)
            count = np.diff(np.r_[at, len(h)])
            rest = np.arange(len(h)) - np.repeat(at, count) >= _HOT
            f = f | np.where(np.repeat(count > _HOT, count), _MORE | _SPREAD, 0).astype(np.uint8)
            many = np.full(len(h), 1 << 30, np.int32)
            yield from blobs.add(np.where(rest, n + spread(mix(g.view(U)), n), spread(h, n)), h, g, m, f, many)

        for rb in batches:
            raw, at = utf8(rb.column(1))
            h, count = np.frombuffer(raw.tobytes(), U), np.diff(at) // 8
            held.append((h, np.repeat(rb.column(0).to_numpy(), count), np.repeat(count, count).astype(np.int32), np.repeat(rb.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) * _QUERY, count)))
            size += len(h)
            if size > 300_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        yield from blobs.take()

    return classes.select("g", "features", "query").mapInArrow(send, Blobs.schema)


def _candidates(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): classes of queries and others that may be linked, each pair once."""

    def count(batches):
        blobs = Blobs(_POSTING)
        for bucket, held in by_bucket(batches):
            h, g, m, f, many = unpack(held, _POSTING)
            if bucket < n:
                o = np.lexsort((g, h))
                h, g, m, f = h[o], g[o], m[o], f[o]
                at = _runs(h)
                size = np.diff(np.r_[at, len(h)])
                asking, all_, hot = np.repeat(np.add.reduceat(f & _QUERY, at, dtype=np.int32), size), np.repeat(size, size).astype(np.int32), np.repeat(np.bitwise_or.reduceat(f & _MORE, at), size) > 0
                many = np.where(hot, 1 << 30, np.where(f & _QUERY, all_ - 1, asking)).astype(np.int32)
                f = (f & _QUERY) | np.where(hot, _SPREAD, 0).astype(np.uint8)
                keep = many > 0
                h, g, m, f, many = h[keep], g[keep], m[keep], f[keep], many[keep]
            yield from blobs.add(spread(mix(g.view(U)), n), h, g, m, f & ~np.uint8(_MORE), many)
        yield from blobs.take()

    def choose(batches):
        blobs = Blobs(_POSTING)
        for _, held in by_bucket(batches):
            h, g, m, f, many = unpack(held, _POSTING)
            o = np.lexsort((h, many, g))
            h, g, m, f, many = h[o], g[o], m[o], f[o], many[o]
            at = _runs(g)
            size = np.diff(np.r_[at, len(g)])
            probe = np.arange(len(g)) - np.repeat(at, size) <= np.repeat(size, size) - _needed(m)
            f = f | np.where(probe, _PROBE, 0).astype(np.uint8)
            hot = f & _SPREAD > 0
            yield from blobs.add(np.where(hot, spread(mix(g.view(U)), n), spread(h, n)), h, g, m, np.where(hot, f & ~np.uint8(_PROBE), f), many)
            far = np.flatnonzero(hot & probe)
            for at_ in range(0, len(far), 4096):
                p = far[at_ : at_ + 4096]
                r = np.repeat(p, n)
                yield from blobs.add(np.tile(np.arange(n), len(p)), h[r], g[r], m[r], f[r] | np.uint8(_MORE), many[r])  # a look-up, not a holder
        yield from blobs.take()

    def meet(batches):
        for _, held in by_bucket(batches):
            h, g, m, f, _ = unpack(held, _POSTING)
            o = np.lexsort((g, h))
            h, g, m, f = h[o], g[o], m[o], f[o]
            at = _runs(h)
            to = np.r_[at[1:], len(h)]
            asks = np.add.reduceat((f & _PROBE > 0).astype(np.int64), at) if len(h) else at
            seen = set()
            for s, e in zip(at[(asks > 0) & (to - at > 1)].tolist(), to[(asks > 0) & (to - at > 1)].tolist()):
                asking, holds = np.flatnonzero(f[s:e] & _PROBE > 0) + s, np.flatnonzero(f[s:e] & _MORE == 0) + s
                own = f[asking] & _QUERY > 0
                for x, y in ((asking[own], holds), (asking[~own], holds[f[holds] & _QUERY > 0])):
                    job = tuple(np.stack([g[z], m[z], f[z] & _QUERY], 1).astype(np.int64).tobytes() for z in (x, y))
                    if job in seen:
                        continue  # features of equal holders pair them once
                    seen.add(job)
                    step = 24 * _BLOCK
                    right = [job[1][q : q + step] for q in range(0, len(job[1]), step)]
                    for p in range(0, len(job[0]), step):
                        yield pa.RecordBatch.from_arrays([pa.array([job[0][p : p + step]] * len(right), pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    def pair(batches):
        for rb in batches:
            got, size = [], 0
            for a, b in zip(rb.column(0), rb.column(1)):
                x, y = (np.frombuffer(z.as_py(), np.int64).reshape(-1, 3) for z in (a, b))
                i, j = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
                # The one that asks is the smaller; one of the two is a query's, and comes first.
                ok = (x[i, 0] != y[j, 0]) & (x[i, 1] <= y[j, 1])
                i, j = i[ok], j[ok]
                for left, right, q in ((x[i], y[j], x[i, 2]), (y[j], x[i], y[j, 2])):
                    got.append(np.stack([left[q > 0, 0], right[q > 0, 0]], 1))
                    size += len(got[-1])
                if size > _BLOCK * _BLOCK:
                    yield from distinct(got)
                    got, size = [], 0
            yield from distinct(got)

    def distinct(got):
        if got:
            p = np.unique(np.concatenate(got), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    sent = in_buckets(_postings(classes, n), n).mapInArrow(count, Blobs.schema)
    sent = in_buckets(in_buckets(sent, n).mapInArrow(choose, Blobs.schema), n)
    return sent.mapInArrow(meet, "a binary, b binary").repartition(n).mapInArrow(pair, "a bigint, b bigint").distinct()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20) -> DataFrame:
    """doc_id, n_features, n_filters, digest of every row, class_id (least id of equal features), and for queries n_links (linked classes), match_id and match_score (null for others and without a match)."""
    d = keyed(docs, id_col, text_col)
    rank = ranks_of(histogram(d))
    made = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("features", pa.binary())])

    def select(batches):
        for rb in chunks(batches):
            h, at = features(*utf8(rb.column(2)), rank)
            yield record(made, rb.column(0), rb.column(1), strings(h.view(np.uint8), at * 8, pa.binary()))

    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    table = cut(d.mapInArrow(select, "k bigint, id bigint, features binary").withColumn("g", F.xxhash64("features")))
    some = table.where("length(features) > 0")
    classes = cut(some.groupBy("g").agg(F.max("features").alias("features"), F.max(asks).alias("query"), F.min("k").alias("k1")))
    total = (table.agg(F.sum(F.length("features"))).first()[0] or 0) // 8
    n = max(8, total // _FEATURES_PER_BUCKET)
    scored = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.int32())])

    def compare(batches):
        last: dict[bytes, np.ndarray] = {}

        def of(raw: bytes) -> np.ndarray:
            if raw not in last:
                if len(last) > 2000:
                    last.clear()
                last[raw] = digest(np.frombuffer(raw, U))
            return last[raw]

        for rb in batches:
            out = []
            for a, b, x, y in zip(*(rb.column(i).to_pylist() for i in range(4))):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                if len(np.intersect1d(p, q, assume_unique=True)) >= _needed(min(len(p), len(q))):
                    out.append((a, b, similarity(of(x), of(y))))
            if out:
                yield record(scored, *map(list, zip(*out)))

    left, right = classes.select(F.col("g").alias("a"), F.col("features").alias("x")), classes.select(F.col("g").alias("b"), F.col("features").alias("y"))
    links = _candidates(classes, n).join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, score int")
    links = cut(links)
    # The two least keys of a class and the two best partners of a class are enough: a row leaves out at most one, its own key.
    least = some.select("g", "k").distinct().withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k"))).where("n <= 2").select("g", "k")
    least = cut(least)
    partner = links.where("score > 0").join(least.select(F.col("g").alias("b"), F.col("k").alias("f")), "b").select(F.col("a").alias("g"), (-F.col("score")).alias("s"), "f")
    partner = partner.union(least.join(classes.where("query").select("g"), "g").select("g", F.lit(-100), F.col("k"))).groupBy("g", "f").agg(F.min("s").alias("s"))
    one = partner.groupBy("g").agg(F.min(F.struct("s", "f")).alias("one"))
    two = partner.join(one, "g").where("f <> one.f").groupBy("g").agg(F.min(F.struct("s", "f")).alias("two"))
    count = links.groupBy(F.col("a").alias("g")).agg(F.count("*").alias("n_links"))
    found = classes.join(one, "g", "left").join(two, "g", "left").join(count, "g", "left").select("g", "k1", "one", "two", "n_links")
    shown = pa.schema([*made, ("g", pa.int64()), ("n_features", pa.int32()), ("digest", pa.binary())])

    def build(batches):
        for rb in batches:
            rows = [digest(np.frombuffer(x, U)).tobytes() for x in rb.column(2).to_pylist()]
            yield record(shown, *rb.columns, pa.compute.divide(pa.compute.binary_length(rb.column(2)), 8).cast(pa.int32()), rows)

    def shown_rows(rows: DataFrame) -> DataFrame:
        return rows.select("k", "id", "features", "g").mapInArrow(build, "k bigint, id bigint, features binary, g bigint, n_features int, digest binary").drop("features")

    # Rows without features are a class of their own, and perhaps a large one: they need no join.
    joined = shown_rows(some).join(found, "g", "left")
    bare = shown_rows(table.where("length(features) = 0"))
    digests = joined.unionByName(bare.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema if f.name not in bare.columns]))
    m = F.when(asks, F.when(F.col("one.f") == F.col("k"), F.col("two")).otherwise(F.col("one")))
    return digests.withColumn("m", m).select(
        F.col("id").alias("doc_id"), "n_features", (F.length("digest") / (FILTER_BITS // 8)).cast("int").alias("n_filters"), "digest",
        F.when(F.col("k1") < NO_ID, F.col("k1")).alias("class_id"), F.when(asks, F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("m.f") < NO_ID, F.col("m.f")).alias("match_id"), (-F.col("m.s")).alias("match_score"),
    )
