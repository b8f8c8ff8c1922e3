import random

import pytest

from quirespark.llm import suffixes


def by_hand(rows, length):
    """(id, window) that occurs elsewhere, and its first occurrence, over distinct rows with ids."""
    seen = {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        w = t.split()
        for p in range(len(w) - length + 1):
            seen.setdefault(tuple(w[p : p + length]), []).append((i, p))
    return {place: min(places) for places in seen.values() if len(places) > 1 for place in places}


def corpus(prose, seed=0, n=60):
    g = random.Random(seed)
    shared = [prose(m, 900 + i) for i, m in enumerate((50, 51, 64, 49, 120, 300, 30))]
    rows = []
    for i in range(n):
        parts = [prose(g.randrange(1, 90), 2000 + i)]
        for _ in range(g.randrange(3)):
            parts += [g.choice(shared), prose(g.randrange(0, 60), g.randrange(10**6))]
        rows.append((i, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("length", [50, 31])
def test_windows_equal_brute_force(spark, prose, length):
    import numpy as np

    rows = corpus(prose) + [(100, "again and " * 100), (101, prose(400, 7)), (101, prose(400, 7))]
    got = {}
    for r in suffixes.repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), length).collect():
        for p, k, q in zip(np.frombuffer(r["at"], "<i4").tolist(), np.frombuffer(r.first_k, "<i8").tolist(), np.frombuffer(r.first_at, "<i4").tolist()):
            got[r.wk, p] = (k, q)
    assert got == by_hand(rows, length)


def test_dedup_takes_later_occurrences_and_nothing_else(spark, prose):
    rows = corpus(prose, 3) + [(200, " ".join(f"w{i % 60}" for i in range(500)))]
    out = {r.doc_id: r.text for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = {}
    for (i, p), (j, q) in by_hand(rows, 50).items():
        if (i, p) != (j, q):
            gone.setdefault(i, set()).update(range(max(p, q + 50) if i == j else p, p + 50))
    assert gone
    for i, t in rows:
        assert out[i].split() == [w for n, w in enumerate(t.split()) if n not in gone.get(i, ())]
        if i not in gone:
            assert out[i] == t


def test_without_keeps_the_rest_byte_for_byte():
    text = "  a b\tc\n\nd é f   g  "
    assert suffixes.without(text, []) == text
    assert suffixes.without(text, [(1, 3)]) == "  a\n\nd é f   g  " or suffixes.without(text, [(1, 3)]).split() == "a d é f   g".split()
    assert suffixes.without(text, [(0, 8)]).split() == []


def test_odd_rows(odd, odd_rows, nothing):
    out = suffixes.dedup(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""]
    assert by[5][0] == by[5][1] == odd_rows[4][1]  # equal rows don't repeat each other
    assert not by[6][0].split()  # but another id does
    assert by[4] == ["one"]
    assert suffixes.repeated_passages(nothing).count() == 0 and suffixes.dedup(nothing).count() == 0
    found = suffixes.repeated_passages(odd).collect()
    assert all(r.end_word - r.start_word >= 50 for r in found)
