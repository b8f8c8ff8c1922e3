import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import bpe, simple8b, token_counts
from quirespark.llm.common import utf8


def reference():
    import public_tokenizers as P
    import tiktoken

    v = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return reference()


TRICKY = ["", "a", "I'm you're he'll 'tis 's", "  two  spaces\n\n\nlines \t tab", "x" * 3000, "naïve Ünï 漢字 \U0001f600", "1234 5,678.90", "don't 'S can''t", "  　 a b", "'''s  's", "\n a\r\n b", "áe 'll've", "ſ's", "he'l l'le"]


def ids_of(texts):
    ids, off = bpe.vocabulary().encode(*utf8(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


def test_bpe_equals_the_public_encoder(encoder, docs):
    texts = TRICKY + [r.text for r in docs.select("text").collect()]
    for t, got in zip(texts, ids_of(texts)):
        assert got == encoder.encode_ordinary(t), t[:80]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'stredlv \n\t.,19é漢  ́AB")), max_size=40), max_size=4))
def test_bpe_equals_the_public_encoder_on_any_text(texts):
    e = _cached()
    assert ids_of(texts) == [e.encode_ordinary(t) for t in texts]


_made = []


def _cached():
    if not _made:
        _made.append(reference())
    return _made[0]


def test_forced_boundaries_are_inside_no_token():
    v = bpe.vocabulary()
    for t in random.Random(0).sample(list(v.ranks), 3000):
        assert not any(v.cut[a * 256 + b] for a, b in zip(t, t[1:]))


def test_bpe_odd_rows(spark, odd, odd_rows, nothing):
    rows = bpe.encode(odd)
    assert rows.count() == len(odd_rows) and rows.where("round_trip").count() == len(odd_rows)
    back = sorted(r.text for r in bpe.decode(rows).collect())
    assert back == sorted(r[1] or "" for r in odd_rows)
    assert bpe.encode(nothing).count() == 0 and bpe.decode(bpe.encode(nothing)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [1, None]), (3, [99_999_999]), (4, []), (5, [-1])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(bad).collect()} == {1: None, 2: None, 3: None, 4: "", 5: None}


# -- token counts


def best(raw: bytes, model) -> tuple[int, int]:
    """(score, tokens) of the best segmentation, from all its splits."""
    got = [(0, 0)]
    for d in range(1, len(raw) + 1):
        got.append(max((got[j][0] + token_counts.piece_score(model.ranks[raw[j:d]]), got[j][1] - 1) for j in range(d) if raw[j:d] in model.ranks))
    return got[-1][0], -got[-1][1]


def test_counts_equal_plain_dynamic_programming(spark, odd, odd_rows, nothing, docs):
    v = bpe.vocabulary()
    known = {}
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(i, t) for i, t, *_ in odd_rows if t is None or len(t) < 5000]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_pretokens, r.n_tokens, round(r.score, 4)) for r in token_counts.token_counts(frame).collect())
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        buf = np.frombuffer(raw, np.uint8)
        at = bpe.pretoken_starts(buf, np.array([0, len(buf)])).tolist()
        parts = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        for p in parts:
            if p not in known:
                known[p] = best(p, v)
        want.append((i is None, i or 0, len(parts), sum(known[p][1] for p in parts), round(sum(known[p][0] for p in parts) / 10_000, 4)))
    assert got == sorted(want)
    assert token_counts.token_counts(odd).count() == len(odd_rows) and token_counts.token_counts(nothing).count() == 0


# -- Simple-8b


def round_trip(rows):
    off = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
    values = np.array([x for r in rows for x in r], np.int64)
    word, doc_at, block_at, boff = simple8b.pack(values, off)
    return simple8b.unpack(word, doc_at, np.diff(off), block_at, boff).tolist(), values.tolist(), word


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 60_000), st.integers(0, 2**60 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=700), max_size=4))
def test_simple8b_round_trip(rows):
    back, want, _ = round_trip(rows)
    assert back == want


def test_simple8b_words_are_as_specified():
    """Selector in four bits, then ids from the low end; a reader written from the definition."""
    g = random.Random(3)
    ids = [g.randrange(1 << g.randrange(1, 64)) for _ in range(900)]
    _, _, word = round_trip([ids])
    out, i, words = [], 0, word.tolist()
    while i < len(words):
        s = words[i] & 15
        room = min(int(simple8b.COUNT[s]), 256 - len(out) % 256, len(ids) - len(out))
        if s == 0:
            out.append(words[i + 1])
            i += 2
            continue
        b = int(simple8b.BITS[s])
        out += [(words[i] >> (4 + j * b)) & ((1 << b) - 1) for j in range(room)]
        i += 1
    assert out == ids
    assert len(round_trip([[5] * 256])[2]) == -(-256 // 20) and len(round_trip([[0] * 240])[2]) == 2


def test_simple8b_odd_rows(spark, odd, odd_rows, nothing):
    rows = simple8b.encode_text(odd)
    assert rows.where("round_trip").count() == len(odd_rows)
    a = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in bpe.encode(odd).collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in simple8b.decode_ids(rows).collect()) == a
    t = spark.createDataFrame([(1, None), (2, []), (3, [1, None]), (4, [-1, 2**62, 0]), (4, [-1, 2**62, 0])], "doc_id bigint, ids array<bigint>")
    got = sorted((r.doc_id, r.ids) for r in simple8b.decode_ids(simple8b.encode_ids(t)).where("doc_id <> 3").collect())
    assert got == [(1, []), (2, []), (4, [-1, 2**62, 0]), (4, [-1, 2**62, 0])]
    assert simple8b.encode_ids(t).where("doc_id = 3 and words is null and n_ids is null").count() == 1
    assert simple8b.decode_ids(simple8b.encode_ids(t)).where("doc_id = 3 and ids is null").count() == 1
    assert simple8b.encode_text(nothing).count() == 0 and simple8b.decode_ids(simple8b.encode_text(nothing)).count() == 0
