"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are packed into
bins of ``capacity``. Only the histogram of piece lengths (at most ``capacity``
entries, whatever the corpus) reaches the driver. There single lengths, pair sums and
triple sums are indexed, each sum with a combination that makes it. Every length, from long
to short, looks up its exact complement in the three; a combination is consumed as often as
the counts allow, and replaced in the index when a length of it has run out. What no combination
fills goes through best-fit decreasing, again a whole count at a time. The outcome is
a list of patterns with multiplicities, which the executors turn into places: a
piece's ordinal among the pieces of its length selects pattern, bin and offset. Ordinals
are counted in shares of a length of about ``SHARE`` pieces, so that a hot length is no single task.

Defined results: null or empty text has no piece and no row; equal rows are packed
once each; a null id stays null in the output; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, key_of, record

CAPACITY = 2048
SHARE = 1 << 20


def _most(cnt: np.ndarray, pattern: tuple[int, ...]) -> int:
    return min(int(cnt[x]) // pattern.count(x) for x in pattern)


class Sums:
    """Which single lengths, pairs and triples make a sum, of lengths of which pieces are left."""

    def __init__(self, cnt: np.ndarray):
        self.cnt, top = cnt, len(cnt)
        lengths = np.flatnonzero(cnt)
        # The larger part of a pair, the largest of a triple; 0 where there is none.
        self.two, self.three = np.zeros(top, np.int64), np.zeros(top, np.int64)
        for a in lengths.tolist():
            b = lengths[(lengths <= a) & (lengths + a < top)]
            self.two[a + b] = a
        for a in lengths.tolist():
            b = np.flatnonzero(self.two[: top - a])
            self.three[a + b] = a

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        a = int(self.two[total])
        if not a:
            return None
        if _most(self.cnt, (*used, a, total - a)):
            return a, total - a
        x = np.arange(total - 1, (total - 1) // 2, -1)
        x = x[(self.cnt[x] > 0) & (self.cnt[total - x] > 0)]
        for a in x.tolist():
            if _most(self.cnt, (*used, a, total - a)):
                self.two[total] = a
                return a, total - a
        if not len(x):
            self.two[total] = 0  # lengths only ever run out
        return None

    def triple(self, total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        a = int(self.three[total])
        if not a:
            return None
        if self.cnt[a] and (p := self.pair(total - a, (*used, a))):
            return (a, *p)
        x = np.arange(total - 2, 0, -1)
        for a in x[(self.cnt[x] > 0) & (self.two[total - x] > 0)].tolist():
            if p := self.pair(total - a, (*used, a)):
                self.three[total] = a
                return (a, *p)
        if not ((self.cnt[x] > 0) & (self.two[total - x] > 0)).any():
            self.three[total] = 0
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths of a bin, long to short) and how many bins have each."""
    cnt = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        cnt[n] += c
    out: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(cnt)
    left: dict[int, int] = {}
    for n in range(capacity, 0, -1):
        while cnt[n]:
            gap = capacity - n
            if not gap:
                found = (n,)
            elif cnt[gap] and _most(cnt, (n, gap)):
                found = (n, gap)
            elif p := sums.pair(gap, (n,)) or sums.triple(gap, (n,)):
                found = (n, *p)
            else:
                left[n] = int(cnt[n])
                cnt[n] = 0
                break
            m = _most(cnt, found)
            for x in found:
                cnt[x] -= m
            out.append((tuple(sorted(found, reverse=True)), m))
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], m: int) -> None:
        g = capacity - sum(pattern)
        open_at.setdefault(g, []).append((pattern, m))
        gaps[g] = True

    for n in sorted(left, reverse=True):
        m = left[n]
        while m:
            fit = np.flatnonzero(gaps[n:])
            if len(fit):
                g = n + int(fit[0])
                pattern, q = open_at[g].pop()
                t = min(q, m)
                if q > t:
                    open_at[g].append((pattern, q - t))
                gaps[g] = bool(open_at[g])
                put((*pattern, n), t)
                m -= t
            else:
                per = capacity // n
                if m >= per:
                    put((n,) * per, m // per)
                if m % per:
                    put((n,) * (m % per), 1)
                m = 0
    return out + [x for g in sorted(open_at) for x in open_at[g]]


class Places:
    """Where the t-th piece of a length goes, as sorted arrays for binary search."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, bin0, taken = [], 0, {}
        for pattern, m in patterns:
            at = 0
            for slot, n in enumerate(pattern):
                t = taken.get(n, 0)
                rows.append((n, t, bin0, slot, at))
                taken[n], at = t + m, at + n
            bin0 += m
        r = np.array(rows or np.empty((0, 5)), np.int64).reshape(-1, 5)
        r = r[np.lexsort((r[:, 1], r[:, 0]))]
        self.key, self.first, self.bin0, self.slot, self.at = (r[:, 0] << 44) + r[:, 1], r[:, 1], r[:, 2], r[:, 3], r[:, 4]

    def __call__(self, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (n << 44) + t, side="right") - 1
        return self.bin0[i] + t - self.first[i], self.slot[i], self.at[i]


_OUT = pa.schema([("bin_id", pa.int64()), ("slot", pa.int32()), ("bin_offset", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("piece_start", pa.int64()), ("n_tokens", pa.int32())])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, n_tokens: Column | None = None, share: int = SHARE) -> DataFrame:
    """One row per piece: bin_id, slot, bin_offset, doc_id, piece_no, piece_start, n_tokens.

    ``n_tokens`` is the length of a row in tokens; by default one for each run without white space.
    """
    n = n_tokens if n_tokens is not None else F.regexp_count(F.col(text_col), F.lit(r"\S+"))
    d = cut(docs.select(key_of(id_col, text_col).alias("k"), F.col(id_col).try_cast("bigint").alias("id"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).where("n > 0"))
    pieces = d.select("k", "id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("piece")).select(
        "k", "id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("bigint") * capacity).cast("int").alias("len")
    )
    counts = {r.len: r.n for r in pieces.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    shares = docs.sparkSession.createDataFrame([(x, -(-c // share)) for x, c in counts.items()], "len int, shares int")
    pieces = pieces.join(F.broadcast(shares), "len").select("k", "id", "piece", "len", F.expr("cast(pmod(xxhash64(k, piece), shares) as int)").alias("part"))
    # Ordinals within a length: a row number in each share, behind the shares before it.
    ranked = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("len", "part").orderBy("k", "piece")) - 1)
    base = np.zeros((capacity + 1, max([1, *(-(-c // share) for c in counts.values())])), np.int64)
    if base.shape[1] > 1:
        for r in pieces.groupBy("len", "part").agg(F.count("*").alias("n")).collect():  # at most capacity + pieces / share rows
            base[r.len, r.part] = r.n
    base = np.cumsum(base, 1) - base
    places = Places(plan(counts, capacity))

    def place(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            c = {f: rb.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(rb.schema.names) if f != "id"}
            length = c["len"].astype(np.int64)
            b, slot, at = places(length, c["rn"].astype(np.int64) + base[length, c["part"]])
            yield record(_OUT, b, slot.astype(np.int32), at.astype(np.int32), rb.column(rb.schema.get_field_index("id")), c["piece"].astype(np.int32), c["piece"].astype(np.int64) * capacity, length.astype(np.int32))

    return ranked.mapInArrow(place, "bin_id bigint, slot int, bin_offset int, doc_id bigint, piece_no int, piece_start bigint, n_tokens int")
