"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

The distinct pre-tokens of a chunk are put in a trie (sorted, so that a node is where a
word leaves its predecessor). Going down one level at a time, every node gets the best
score of a segmentation that ends there, from its ancestors' scores and the pieces that
lead from them; a prefix that many pre-tokens share is scored once. What stands at a
pre-token's last node is its count; a document's count is the sum over its pre-tokens.

A piece's score is the logarithm of a Zipf estimate from its rank in the vocabulary,
-log(rank + 2), in whole ten-thousandths so that sums are exact; of equal scores the
segmentation of fewer tokens counts. No tokenizer is trained.

Defined results: null and empty texts have 0 tokens; every byte is a piece, so every
text has a count; equal rows give equal rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, pretoken_starts, vocabulary
from .common import BYTE_CODE, Spans, U, chunks, record, span_hashes, strings, utf8

ONE = 1 << 20  # a value is score * ONE - tokens
LONG = 64  # pre-tokens of more bytes are scored one by one
CHUNK = 8 << 20


def piece_score(rank: int) -> int:
    return -round(10_000 * math.log(rank + 2))


class Unigram:
    def __init__(self, path: str = VOCABULARY):
        ranks = vocabulary(path).ranks
        self.value = {t: piece_score(r) * ONE - 1 for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.by_len = {}
        by: dict[int, list[bytes]] = {}
        for t in ranks:
            by.setdefault(len(t), []).append(t)
        for k in sorted(by):
            buf = np.frombuffer(b"".join(by[k]), np.uint8)
            s = np.arange(0, len(buf), k)
            h = span_hashes(BYTE_CODE[buf], s, s + k)
            o = np.argsort(h)
            self.by_len[k] = h[o], np.array([self.value[t] for t in by[k]], np.int64)[o]

    def one(self, raw: bytes) -> int:
        """Value of a single pre-token."""
        best = [0]
        get = self.value.get
        for d in range(1, len(raw) + 1):
            best.append(max(best[j] + v for j in range(max(0, d - self.longest), d) if (v := get(raw[j:d])) is not None))
        return best[-1]

    def values(self, words: pa.Array) -> np.ndarray:
        """Values of distinct pre-tokens."""
        out = np.zeros(len(words), np.int64)
        buf, off = utf8(words)
        lens = np.diff(off)
        for i in np.flatnonzero(lens > LONG):
            out[i] = self.one(buf[off[i] : off[i + 1]].tobytes())
        order = pc.sort_indices(words).to_numpy()
        order = order[lens[order] <= LONG]
        n = len(order)
        if not n:
            return out
        start, size = off[:-1][order], lens[order]
        spans = Spans(BYTE_CODE[buf])
        same = np.ones(n, bool)
        same[0] = False
        node = [np.zeros(n, np.int32)]
        value = [np.zeros(1, np.int64)]
        act = np.arange(n)
        for d in range(1, int(size.max()) + 1):
            act = act[size[act] >= d]
            ch = buf[start[act] + d - 1]
            s = same[act]
            s[1:] &= (act[1:] == act[:-1] + 1) & (ch[1:] == ch[:-1])
            s[:1] = False
            same[act] = s
            at = np.zeros(n, np.int32)
            at[act] = np.cumsum(~s) - 1
            rep = act[~s]
            best = np.full(len(rep), np.iinfo(np.int64).min // 2)
            for k, (keys, vals) in self.by_len.items():
                if k > d:
                    break
                h = spans(start[rep] + d - k, start[rep] + d)
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[i] == h)
                best[hit] = np.maximum(best[hit], value[d - k][node[d - k][rep[hit]]] + vals[i[hit]])
            node.append(at)
            value.append(best)
            done = act[size[act] == d]
            out[order[done]] = best[at[done]]
        return out


@functools.lru_cache(2)
def unigram(path: str = VOCABULARY) -> Unigram:
    return Unigram(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (natural logarithm, summed over pre-tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = unigram(path)
        for rb in chunks(batches, most=CHUNK):
            buf, off = utf8(rb.column(1))
            starts = pretoken_starts(buf, off)
            coded = strings(buf, np.r_[starts, len(buf)], pa.binary()).dictionary_encode()
            v = model.values(coded.dictionary)
            count = -v % ONE
            score = (v + count) // ONE
            code = coded.indices.to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, off)
            total = [np.r_[0, np.cumsum(x[code])][at] for x in (count, score)]
            yield record(schema, rb.column(0), np.diff(at), np.diff(total[0]), np.diff(total[1]) / 10_000)

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, score double")
