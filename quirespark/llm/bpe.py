"""Byte-level BPE with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be joined,
so a text may be cut there beyond doubt. Together with the pre-tokeniser's cuts these
boundaries are found for a whole chunk of documents by array operations. Each distinct
fragment of a chunk is encoded once: those that are tokens are looked up, the merges of
all others run side by side as array operations. Documents are concatenations of
fragments' ids.

Defined results: null or empty text has an empty list of ids; bytes decode to what
they were, so decoding returns the text; ids are those of the reference encoders for
the same vocabulary and pattern.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, chunks, lists, ranges, record, span_hashes, strings, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 8 << 20  # bytes of text that are encoded at a time: the more, the fewer fragments occur twice
LONG = 64
_NONE = np.int64(1 << 40)
_L, _N, _S, _O = range(4)


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    out = np.full(0x110000, _O, np.int8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = _L
        elif k == "N":
            out[c] = _N
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = _S
    return out


def pretoken_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokeniser ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begins a piece."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of characters
    b = buf[lead].astype(np.int32)
    cp = b.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((b >= low) & (b < (0xE0, 0xF0, 0xF8)[size - 2]))
        v = b[at] & mask
        for j in range(1, size):
            v = (v << 6) | (buf[lead[at] + j] & 0x3F)
        cp[at] = v
    kind = _kinds()[cp]
    m = len(cp)
    edge = np.zeros(m + 1, bool)
    edge[np.searchsorted(lead, off)] = True  # document ends
    edge[m] = True
    head = edge[:-1].copy()
    prev = np.r_[np.int8(-1), kind[:-1]]
    start = head | (kind != prev)
    space = (kind == _S)
    last_space = space & np.r_[~space[1:], True]  # last of its run, or at the end of its document
    last_space |= space & edge[1:]
    joins = last_space & (cp == 32) & ~edge[1:]  # a space that the next piece takes with it
    at = np.flatnonzero(joins)
    start[at + 1] = False
    start[at] = True
    # A run of white space that ends in another character leaves that one as a piece of its own.
    single = np.flatnonzero(last_space & (cp != 32) & ~edge[1:])
    start[single] = True
    # Contractions: only where the apostrophe begins a piece.
    q = np.flatnonzero((cp == 39) & start)
    if len(q):
        for suffix in ("s", "t", "m", "d", "re", "ve", "ll"):
            k = len(suffix)
            f = q[q + k < m]
            for j, ch in enumerate(suffix, 1):
                f = f[(cp[f + j] == ord(ch)) & ~edge[f + j]]
            start[f + 1] = False
            rest = f + k + 1
            ok = rest < m
            start[rest[ok]] = True
            # a letter run that the suffix began goes on as a piece of its own; a space there still belongs to the next one
            if ok.any():
                r = rest[ok]
                sp = r[(kind[r] == _S)]
                start[sp] = True
    return lead[start]


class Bpe:
    """Vocabulary with its forced boundaries. Small enough to be made once per Python worker."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        inside = np.zeros(65536, bool)
        for t, r in self.ranks.items():
            self.token[r] = t
            x = np.frombuffer(t, np.uint8).astype(np.int32)
            inside[x[:-1] * 256 + x[1:]] = True
        self.cut = ~inside
        self.lens = np.array([len(t) for t in self.token], np.int64)
        self.at = np.r_[0, np.cumsum(self.lens)[:-1]]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        # Every way to join two tokens into one, and the hash of every token, for lookups of many at a time.
        pairs = {(self.ranks[t[:i]] << 32) | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        key = np.fromiter(pairs, np.int64, len(pairs))
        o = np.argsort(key)
        self.pair, self.joined = np.r_[key[o], 1 << 62], np.r_[np.fromiter(pairs.values(), np.int64, len(pairs))[o], _NONE]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        h = span_hashes(BYTE_CODE[self.bytes], self.at, self.at + self.lens)
        self.by_hash = np.argsort(h)
        self.hash = h[self.by_hash]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of tokens makes."""
        key = (a << 32) | b
        i = np.searchsorted(self.pair, key)
        return np.where(self.pair[i] == key, self.joined[i], _NONE)

    def whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ids of the fragments that are tokens, -1 for the others; found by hash, verified by byte."""
        h = span_hashes(BYTE_CODE[buf], off[:-1], off[1:])
        t = self.by_hash[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)]
        out = np.where(self.lens[t] == np.diff(off), t, -1)
        f = np.flatnonzero(out >= 0)
        n = self.lens[out[f]]
        same = self.bytes[ranges(self.at[out[f]], n)] == buf[ranges(off[f], n)]
        wrong = np.r_[0, np.cumsum(~same)][np.r_[0, np.cumsum(n)]]
        out[f[wrong[1:] > wrong[:-1]]] = -1
        return out

    def merge(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all fragments and each one's number of ids: the adjacent pair of least rank is joined until none is left.

        One round joins a pair of every fragment that has one left. Fragments of more than
        ``LONG`` bytes, whose number of rounds would hold up the others, go through a heap.
        """
        known, lens = self.whole(buf, off), np.diff(off)
        many = np.flatnonzero((known < 0) & (lens <= LONG))
        size = lens[many]
        tok = self.single[buf[ranges(off[many], size)]]
        frag = np.repeat(np.arange(len(many)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(known >= 0), known[known >= 0])]
        rank = np.full(len(tok), _NONE)
        inner = np.flatnonzero(frag[1:] == frag[:-1])
        rank[inner] = self.rank_of(tok[inner], tok[inner + 1])
        while len(tok):
            at = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
            count = np.diff(np.r_[at, len(frag)])
            least = np.minimum.reduceat(rank, at)
            live = np.repeat(least < _NONE, count)
            if not live.all():
                done.append((many[frag[~live]], tok[~live]))
                tok, frag, rank, least, count = tok[live], frag[live], rank[live], least[least < _NONE], count[least < _NONE]
                if not len(tok):
                    break
            i = np.flatnonzero(rank == np.repeat(least, count))
            i = i[np.r_[True, frag[i[1:]] != frag[i[:-1]]]]  # the leftmost of equals
            tok[i] = rank[i]
            stay = np.ones(len(tok), bool)
            stay[i + 1] = False
            place = (np.cumsum(stay) - 1)[i]
            tok, frag, rank = tok[stay], frag[stay], rank[stay]
            rank[place] = _NONE
            right = place[(place + 1 < len(tok)) & (frag[np.minimum(place + 1, len(tok) - 1)] == frag[place])]
            left = place[(place > 0) & (frag[place - 1] == frag[place])] - 1
            for x in (right, left):
                rank[x] = self.rank_of(tok[x], tok[x + 1])
        for f in np.flatnonzero((known < 0) & (lens > LONG)).tolist():
            ids = self._merge_long(buf[off[f] : off[f + 1]].tobytes())
            done.append((np.full(len(ids), f), np.array(ids, np.int64)))
        who = np.concatenate([x for x, _ in done])
        o = np.argsort(who, kind="stable")
        return np.concatenate([x for _, x in done])[o].astype(np.int32), np.bincount(who, minlength=len(lens))

    def _merge_long(self, raw: bytes) -> list[int]:
        """Ids of one fragment, with a heap of its pairs."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        n, get = len(parts), self.ranks.get
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b or not alive[i]:
                continue
            parts[i] = a + b
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ranks[p] for p, ok in zip(parts, alive) if ok]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all documents and each document's offset into them."""
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(off), np.int64)
        flag = np.zeros(len(buf), bool)
        flag[pretoken_starts(buf, off)] = True
        flag[1:] |= self.cut[buf[:-1].astype(np.int32) * 256 + buf[1:]]
        starts = np.flatnonzero(flag)
        coded = strings(buf, np.r_[starts, len(buf)], pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        flat, size = self.merge(*utf8(coded.dictionary))
        first = np.r_[0, np.cumsum(size)[:-1]]
        per = size[code]
        out = flat[ranges(first[code], per)]
        return out, np.r_[0, np.cumsum(per)][np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and their offsets."""
        n = self.lens[ids]
        return self.bytes[ranges(self.at[ids], n)], np.r_[0, np.cumsum(n)][off]


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


@functools.lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), and round_trip: whether decoding the ids gives back the text's bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches):
        bpe = vocabulary(path)
        for rb in chunks(batches, most=CHUNK):
            buf, off = utf8(rb.column(1))
            ids, at = bpe.encode(buf, off)
            back, boff = bpe.decode(ids, at)
            if len(back) == len(buf) and (boff == off).all():
                wrong = np.r_[0, np.cumsum(back != buf)]
                same = wrong[off[1:]] == wrong[off[:-1]]
            else:
                same = np.array([back[boff[i] : boff[i + 1]].tobytes() == buf[off[i] : off[i + 1]].tobytes() for i in range(rb.num_rows)])
            yield record(schema, rb.column(0), np.diff(at).astype(np.int32), lists(ids, at, pa.int32()), same)

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens int, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """doc_id, text (null where the bytes are no UTF-8 or an id is unknown)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = vocabulary(path)
        for rb in batches:
            col = rb.column(1)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(n)]
            wrong = np.r_[0, np.cumsum((flat < 0) | (flat >= len(bpe.token)))][at]
            raw, off = bpe.decode(np.clip(flat, 0, len(bpe.token) - 1), at)
            whole = strings(raw, off, pa.large_binary())
            out = [None if bad else _text(x.as_py()) for x, bad in zip(whole, (wrong[1:] > wrong[:-1]) | ~np.asarray(col.is_valid()))]
            yield record(schema, rb.column(0), out)

    return tokens.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
