import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirespark.llm import packing


def valid(counts, patterns, capacity):
    used = Counter()
    for p, m in patterns:
        assert m > 0 and sum(p) <= capacity
        for x in p:
            used[x] += m
    assert used == Counter({k: v for k, v in counts.items() if v})


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    g = random.Random(seed)
    cap = g.choice((10, 37, 256))
    counts = {n: g.randrange(0, 30) for n in range(1, cap + 1) if g.random() < 0.5}
    valid(counts, packing.plan(counts, cap), cap)


def test_exact_complements_are_found():
    # Gaps that a single, a pair and a triple fill.
    for counts, bins in (({7: 5, 3: 5}, 5), ({6: 4, 3: 4, 1: 4}, 4), ({5: 3, 2: 6, 1: 3}, 3)):
        p = packing.plan(counts, 10)
        assert sum(m for _, m in p) == bins and all(sum(x) == 10 for x, _ in p)


def least_bins(pieces, capacity):
    """The optimum, by trying every bin for every piece."""
    best = [len(pieces)]

    def put(i, gaps):
        if len(gaps) >= best[0] and i < len(pieces) or len(gaps) > best[0]:
            return
        if i == len(pieces):
            best[0] = len(gaps)
            return
        for g in sorted(set(gaps)):
            if g >= pieces[i]:
                rest = list(gaps)
                rest.remove(g)
                put(i + 1, [*rest, g - pieces[i]])
        put(i + 1, [*gaps, capacity - pieces[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_small_cases_against_the_optimum(seed):
    g = random.Random(seed)
    pieces = sorted((g.randrange(1, 13) for _ in range(g.randrange(1, 10))), reverse=True)
    got = packing.plan(Counter(pieces), 12)
    valid(Counter(pieces), got, 12)
    assert sum(m for _, m in got) <= least_bins(pieces, 12) + 1


def test_sums_are_indexed():
    cnt = np.zeros(41, np.int64)
    cnt[[3, 7, 11, 20]] = (2, 1, 1, 1)
    s = packing.Sums(cnt)
    have = [3, 7, 11, 20]
    pairs = {a + b for a in have for b in have if a + b <= 40}
    assert set(np.flatnonzero(s.two).tolist()) == pairs and set(np.flatnonzero(s.three).tolist()) == {a + b for a in have for b in pairs if a + b <= 40}
    assert s.pair(14, ()) == (11, 3) and s.pair(14, (11,)) is None and s.triple(17, ()) == (11, 3, 3) and s.triple(17, (3,)) is None


def test_no_worse_than_best_fit_decreasing():
    g = random.Random(9)
    counts = Counter(min(200, int(g.lognormvariate(3.5, 0.8)) + 1) for _ in range(3000))
    gaps, bins = [], 0
    for n in sorted(counts.elements(), reverse=True):
        fit = [i for i, x in enumerate(gaps) if x >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(200 - n)
            bins += 1
    assert sum(m for _, m in packing.plan(counts, 200)) <= bins


def test_places_of_all_pieces(spark, odd, nothing):
    docs = spark.createDataFrame([(i, "w " * random.Random(i).randrange(0, 300)) for i in range(400)] + [(500, "w " * 1000), (501, None), (502, ""), (None, "a b c"), (503, "x y"), (503, "x y")], "doc_id bigint, text string")
    rows = packing.pack(docs.repartition(4), capacity=128).collect()
    assert sorted(map(tuple, packing.pack(docs, capacity=128).drop("bin_id", "slot", "bin_offset").collect()), key=str) == sorted(map(tuple, packing.pack(docs, capacity=128, share=3).drop("bin_id", "slot", "bin_offset").collect()), key=str)
    few = packing.pack(docs, capacity=128, share=3)
    assert few.select("bin_id", "slot").distinct().count() == few.count() == len(rows)
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.slot))
        pieces[r.doc_id].append((r.piece_start, r.n_tokens))
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for i, (o, n, slot) in enumerate(sorted(b)):
            assert (o, slot) == (at, i)
            at += n
        assert at <= 128
    want = {i: len(t.split()) for i, t in docs.collect() if t and t.split()}
    assert set(pieces) == set(want)
    assert sum(n for _, n in pieces[500]) == 1000 and sorted(pieces[500])[1][0] == 128
    assert len(pieces[503]) == 2 and len(bins) <= 1.02 * sum(r.n_tokens for r in rows) / 128 + 1
    assert packing.pack(odd).count() > 0 and packing.pack(nothing).count() == 0
