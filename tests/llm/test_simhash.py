import random

import numpy as np
import pytest

from quirespark.llm import simhash
from quirespark.llm.common import utf8


def groups_by_hand(rows):
    """Union of all linked pairs, by comparing every signature with every other: at most 19 bits, and a segment of either order that differs in at most one."""
    import pyarrow as pa

    hi, lo = simhash.sign(*utf8(pa.array([t or "" for _, t in rows])))
    bits = np.unpackbits(np.stack([lo, hi], 1).view(np.uint8), axis=1, bitorder="little")
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        x = bits ^ bits[i]
        close = [x[:, order][:, at : at + width].sum(1) <= 1 for order in simhash._ORDERS for at, width in simhash.bounds(7)]
        for j in np.flatnonzero((x.sum(1) <= 19) & np.any(close, axis=0)):
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
        for j in range(i):
            if rows[i][0] is not None and rows[i][0] == rows[j][0]:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def edited(text, share, seed):
    g = random.Random(seed)
    w = text.split()
    for i in range(len(w)):
        if g.random() < share:
            w[i] = f"new{g.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark, prose):
    rows, g = [], random.Random(4)
    for n in range(120):
        base = prose(g.choice((20, 60, 200, 800)), 1000 + n)
        rows += [(10 * n + c, edited(base, 0.02 * c, c)) for c in range(g.randrange(1, 5))]
    random.Random(1).shuffle(rows)
    want = {}
    for (i, _), root in zip(rows, groups_by_hand(rows)):
        want.setdefault(root, set()).add(i)
    got = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.duplicate == (r.doc_id != r.group_id)
    pairs = lambda x: {(a, b) for s in x.values() for a in s for b in s if a < b}
    assert pairs(got) == pairs(want)
    # Groups are named by their least id.
    assert all(min(v) == k for k, v in got.items())


@pytest.mark.parametrize("rows_per_bucket", [60_000, 5])
def test_up_to_thirteen_bits_is_exact(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(simhash, "ROWS_PER_BUCKET", rows_per_bucket)  # more rows than buckets: more parts
    g = np.random.default_rng(5)
    sig = g.integers(0, 1 << 63, (40, 2), dtype=np.int64)
    rows = []
    for n, (hi, lo) in enumerate(sig.tolist()):
        rows.append((100 * n, hi, lo))
        for c in range(1, 8):
            x = (hi << 64) | lo
            for b in g.choice(128, 13, replace=False).tolist():
                x ^= 1 << b
            a, b = (x >> 64) & (2**64 - 1), x & (2**64 - 1)
            rows.append((100 * n + c, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    from quirespark.llm.components import components

    e = simhash.edges(spark.createDataFrame(rows, "rep bigint, hi bigint, lo bigint").repartition(3), len(rows))
    got = {r.node: r.root for r in components(e).collect()}
    assert all(got.get(r[0], r[0]) == r[0] // 100 * 100 for r in rows)


def test_parts_cover_a_segment_whatever_the_rows():
    for rows in (0, 10**6, 10**8, 10**9, 10**11):
        for width in (18, 19, 32):
            p = simhash.parts(width, rows)
            assert [b for a, n in p for b in range(a, a + n)] == list(range(width))
    assert len(simhash.parts(18, 10**6)) == 2 and len(simhash.parts(18, 10**8)) == 3 and len(simhash.parts(18, 10**11)) == 18


def test_clean_documents_stay_and_copies_go(spark, prose):
    rows = [(i, prose(150, i)) for i in range(300)] + [(1000 + i, prose(150, i)) for i in range(40)]
    rows += [(2000 + i, prose(150, i).upper()) for i in range(40)]
    left = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left == set(range(300))


def test_odd_rows(odd, odd_rows, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # Texts without words are copies of each other; 6 is a copy of 5; the null id with a text is one document; 9 is one document, with two texts.
    assert ids == [(False, i) for i in (-3, 1, 4, 5, 7, 8, 9, 10, 11)] + [(True, 0)]
    again = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.dedup(odd.repartition(1)).collect())
    assert again == ids  # the same rows stay, however they are partitioned
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.dedup(nothing).count() == 0
