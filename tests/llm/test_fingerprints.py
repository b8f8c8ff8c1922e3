import math
from collections import Counter

import numpy as np
import pyarrow as pa

from quirespark.llm import fingerprints as fp
from quirespark.llm.common import utf8


def entropy(w: bytes) -> int:
    n = sum(int(fp._F[c]) for c in Counter(w).values())
    return min(1000, max(0, 1000 * ((6 * 64 << 20) - n) // (6 * 64 << 20)))


def windows(raw: bytes):
    return [entropy(raw[i : i + 64]) for i in range(max(0, len(raw) - 63))]


def by_hand(raw: bytes, rank):
    """Positions of features: the leftmost lowest rank of every run of 64 windows scores."""
    r = [int(rank[e]) for e in windows(raw)]
    score = Counter()
    for i in range(len(r) - 63):
        p = min(range(i, i + 64), key=lambda j: (r[j], j))
        if r[p] < fp.BINS:
            score[p] += 1
    seen, out = set(), []
    for p in sorted(score):
        if score[p] >= fp.POPULAR and raw[p : p + 64] not in seen:
            seen.add(raw[p : p + 64])
            out.append(p)
    return out


def test_entropy_of_every_window():
    texts = ["a" * 200, "abc" * 70, "The quick brown fox jumps over the lazy dog. " * 9, "short", ""]
    buf, off = utf8(pa.array(texts))
    e, count = fp.entropies(buf, off)
    for i, t in enumerate(texts):
        w = windows(t.encode())
        assert count[i] == len(w) and e[off[i] : off[i] + len(w)].tolist() == w
    assert abs(entropy(bytes(range(64))) - 1000) <= 1 and math.isclose(entropy(b"ab" * 32), 1000 / 6, abs_tol=1)


def test_features_and_digests_by_hand(prose):
    texts = [prose(n, n) for n in (5, 40, 200, 900)] + ["", "x" * 500]
    buf, off = utf8(pa.array(texts))
    rank = fp.ranks_of(np.bincount([e for t in texts for e in windows(t.encode())], minlength=fp.BINS))
    h, at = fp.features(buf, off, rank)
    for i, t in enumerate(texts):
        want = by_hand(t.encode(), rank)
        assert at[i + 1] - at[i] == len(want)
        d = fp.digest(h[at[i] : at[i + 1]])
        assert len(d) == -(-len(want) // fp.PER_FILTER)
        if len(d):
            assert fp.similarity(d, d) == 100


def test_search_finds_copies_both_ways(spark, prose):
    rows = [(i, prose(400, i)) for i in range(30)]
    rows += [(100 + i, prose(400, i)) for i in range(5)] + [(200 + i, prose(400, i) + " " + prose(40, 900 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in fp.fingerprint(df, every=1).collect()}
    for i in range(5):
        assert (got[100 + i].match_id, got[100 + i].match_score, got[100 + i].class_id) == (i, 100, i)
        assert (got[i].match_id, got[i].match_score) == (100 + i, 100)
        assert got[200 + i].match_id == i and got[200 + i].match_score > 50 and got[200 + i].n_links == 1
    assert all(got[i].match_id is None and got[i].n_links == 0 for i in range(5, 30))
    some = {r.doc_id: r for r in fp.fingerprint(df).collect()}
    assert all(some[i] == got[i] if i % 20 == 0 else (some[i].digest, some[i].match_id, some[i].n_links) == (got[i].digest, None, None) for i in got)


def test_odd_rows(odd, odd_rows, nothing):
    rows = fp.fingerprint(odd, every=1).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[1].n_features == by[2].n_features == by[4].n_features == 0 and by[2].digest == b"" and by[2].match_id is None
    assert (by[6].match_id, by[6].match_score) == (5, 100)
    assert fp.fingerprint(nothing).count() == 0


def test_search_equals_all_pairs(spark, prose, monkeypatch):
    """Every row against every other that shares half of the smaller's features: exact copies both ways, near copies of a later document, an id with two texts, a hot passage, documents that are mostly it."""
    part = [prose(300, 50 + i) for i in range(3)]
    texts = [(0, " ".join(part))] + [(10 + i, p) for i, p in enumerate(part)] + [(20 + i, p + " " + prose(30, 70 + i)) for i, p in enumerate(part)]
    texts += [(30 + i, prose(300, 50)) for i in range(3)] + [(40, prose(300, 90)), (40, prose(300, 91)), (41, prose(300, 90)), (42, prose(300, 91)), (None, prose(300, 90))]
    texts += [(100 + i, prose(120, 200 + i) + " " + prose(150, 199) + " " + prose(120, 300 + i)) for i in range(12)]
    texts += [(200 + i, prose(400, 400 + i)) for i in range(5)] + [(300, ""), (301, None)]
    texts += [(400 + i, prose(300, 199) + " " + prose(20 + 40 * i, 600 + i)) for i in range(9)]
    buf, off = utf8(pa.array([t for _, t in texts]))
    rank = fp.ranks_of(np.bincount([e for _, t in texts for e in windows((t or "").encode())], minlength=fp.BINS))
    h, at = fp.features(buf, off, rank)
    held = [h[at[i] : at[i + 1]] for i in range(len(texts))]
    made = [fp.digest(x) for x in held]
    far = 1 << 62
    want = []
    for i, (k, _) in enumerate(texts):
        linked = [j for j in range(len(texts)) if len(held[i]) and len(held[j]) and len(set(held[i].tolist()) & set(held[j].tolist())) >= (min(len(held[i]), len(held[j])) + 1) // 2]
        found = [(-fp.similarity(made[i], made[j]), far if texts[j][0] is None else texts[j][0]) for j in linked if texts[j][0] != k]
        s, m = min((x for x in found if x[0] < 0), default=(None, None)) if k is not None else (None, None)
        others = len({held[j].tobytes() for j in linked} - {held[i].tobytes()})
        want.append((-1 if k is None else k, len(held[i]), None if m == far else m, None if s is None else -s, None if k is None else others))
    for block, hot in ((fp._BLOCK, fp._HOT), (3, fp._HOT), (3, 2), (1024, 1)):
        monkeypatch.setattr(fp, "_BLOCK", block)
        monkeypatch.setattr(fp, "_HOT", hot)
        got = fp.fingerprint(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4), every=1).collect()
        key = lambda x: tuple(-9 if v is None else v for v in x)
        assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_features, r.match_id, r.match_score, r.n_links) for r in got), key=key) == sorted(want, key=key)
