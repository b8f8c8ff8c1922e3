"""Quality classifier: ridge regression on random Fourier features of document statistics.

Training uses at most ``sample`` labelled rows, those of the least hashed ids (the bound
is the documented parameter; scoring covers every row). Statistics of a document come
from its byte histogram and its words, and from the log odds of words (by hash, without
punctuation at their ends) that at least ``SUPPORT`` training rows hold; a training row's
own odds leave that row out. Random Fourier features approximate a Gaussian
kernel over the standardised statistics. Every partition sums its part of the normal
equations, Spark adds the parts up, and one small system is solved for two targets:
quality and toxicity. A fifth of the training rows is held out of the fit; isotonic
regression on it turns raw scores into probabilities. A row is kept if it is probably
of quality and probably not toxic.

Defined results: null and empty texts count as text without words and are scored like
any other; labels that are null are not trained on; of repeated labels of an id the
larger counts; without any labelled row every document is kept with probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, U, chunks, cut, record, span_hashes, utf8, words

SAMPLE = 20_000
FEATURES = 512
RIDGE = 1e-2
SUPPORT = 2
PRIOR_ROWS = 2  # rows of the average label that a word's count begins with
TRAIN_PARTITIONS = 16  # of the sample, whose size is bounded; each sends one part of the normal equations
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = [ord(c) for c in "#$%&*|<>=+/\\{}[]^~_@`"]
_STOP = [ord(c) for c in ".!?"]
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?\"'()"]] = True


def bare_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words in lower case, without up to three marks behind and one before."""
    if not len(starts):
        return np.empty(0, U)
    for _ in range(3):
        ends = ends - (_PUNCTUATION[buf[ends - 1]] & (ends - starts > 1))
    starts = starts + (_PUNCTUATION[buf[starts]] & (ends - starts > 1))
    return span_hashes(BYTE_CODE[_LOWER[buf]], starts, ends)


def statistics(buf: np.ndarray, off: np.ndarray, known: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Statistics of each document, [documents, numbers]; ``known`` are sorted hashes, ``odds`` has a row for each and one of zeros behind."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    hist = np.bincount(doc * 256 + buf, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1)
    p = hist / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    starts, ends, first = words(buf, off)
    nw = np.diff(first)
    some = np.maximum(nw, 1)
    wdoc = np.repeat(np.arange(n), nw)
    wlen = (ends - starts).astype(np.float64)
    per = lambda x: np.bincount(wdoc, x, minlength=n)
    mean = per(wlen) / some
    h = bare_hashes(buf, starts, ends)
    entry = np.searchsorted(known, h)
    if len(known):
        entry[known[np.minimum(entry, len(known) - 1)] != h] = len(known)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    key = np.sort((wdoc.astype(U) << U(40)) | (h >> U(24)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    kdoc = (key[at] >> U(40)).astype(np.int64)
    run = np.diff(np.r_[at, len(key)]).astype(np.float64)
    distinct = np.bincount(kdoc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, kdoc, run)
    symbol = np.zeros(256, bool)
    symbol[_SYMBOL] = True
    lastsym = symbol[buf[ends - 1]].astype(float) if len(ends) else np.empty(0)
    cols = [
        np.log1p(size), np.log1p(nw), entropy, mean, np.sqrt(np.maximum(per(wlen**2) / some - mean**2, 0)),
        distinct / some, np.log1p(distinct), top / some, per(again) / some, per(lastsym) / some, per(wlen <= 2) / some,
        p[:, 97:123].sum(1), p[:, 65:91].sum(1), p[:, 48:58].sum(1), p[:, _SYMBOL].sum(1), p[:, _STOP].sum(1), p[:, [44, 59, 58]].sum(1),
        p[:, 10], p[:, 32], p[:, 128:].sum(1), hist[:, _STOP].sum(1) / some, hist[:, 10] / some,
    ]
    for t in range(odds.shape[1]):
        o = odds[entry, t]
        strong = np.maximum(o - 1.5, 0)
        most = np.zeros(n)
        np.maximum.at(most, wdoc, strong)
        cols += [np.log1p(per(strong)), most]
    return np.stack(cols, 1)


@dataclass
class Model:
    known: np.ndarray
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: list  # per target: (scores, probabilities) of the isotonic fit

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((stats - self.mean) / self.scale, -6, 6) @ self.weights + self.phase) * np.sqrt(2 / self.weights.shape[1])
        return np.c_[z, np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.beta

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([np.interp(raw[:, t], *self.steps[t]) for t in range(raw.shape[1])], 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising step curve, (score, mean label)."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, y in zip(score[o].tolist(), label[o].tolist()):
        blocks.append([y, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, _, hi = blocks.pop()
            blocks[-1][0] += y1
            blocks[-1][1] += n1
            blocks[-1][3] = hi
    x = [v for b in blocks for v in (b[2], b[3])]
    return np.array(x), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


def _sum(df: DataFrame, key: str, cols: list[str]) -> list:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols]).collect()


_COUNTS = pa.schema([("w", pa.int64()), *((f"a{i}", pa.int64()) for i in range(4))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model | None:
    """The fitted model, or None when no row is labelled. Text moves only for the sample."""
    lab = (
        labels.select(F.col(id_col).try_cast("bigint").alias("lid"), F.col(quality_col).cast("double").alias("q"), F.col(toxic_col).cast("double").alias("t"))
        .where("lid is not null and q is not null and t is not null").groupBy("lid").agg(F.max("q").alias("q"), F.max("t").alias("t"))
        .orderBy(F.xxhash64("lid"), "lid").limit(sample)
    )
    rows = cut(docs.select(F.col(id_col).try_cast("bigint").alias("lid"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(lab), "lid").repartition(TRAIN_PARTITIONS, "lid").select("text", "q", "t", (F.pmod(F.xxhash64("lid"), F.lit(5)) == 0).alias("held")))

    def count(batches):
        totals = np.zeros(4, np.int64)
        for rb in chunks(batches):
            held = np.array(rb.column(3).to_pylist(), bool)
            buf, off = utf8(rb.column(0))
            s, e, first = words(buf, off)
            h, doc = bare_hashes(buf, s, e), np.repeat(np.arange(rb.num_rows), np.diff(first))
            o = np.lexsort((doc, h))
            h, doc = h[o], doc[o]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, bool)
            h, doc = h[new], doc[new]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            q, t = (rb.column(i).to_numpy() > 0 for i in (1, 2))
            cols = []
            for i, m in enumerate((q, ~q, t, ~t)):
                m = m & ~held
                totals[i] += m.sum()
                cols.append(np.add.reduceat(m[doc].astype(np.int64), at) if len(at) else at)
            yield record(_COUNTS, h[at].view(np.int64), *cols)
        yield record(_COUNTS, pa.nulls(1, pa.int64()), *totals[:, None])

    # Words of the sample that enough rows hold: bounded by the sample.
    cells = rows.mapInArrow(count, "w bigint, a0 bigint, a1 bigint, a2 bigint, a3 bigint").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "a2", "a3")]).where(f"w is null or a0 + a1 >= {SUPPORT}").toArrow()
    w = cells.column("w")
    tally = np.stack([cells.column(f"a{i}").to_numpy().astype(float) for i in range(4)], 1)
    total = np.asarray(w.is_null())
    tot = tally[total].sum(0)
    if tot[:2].sum() == 0:
        return None
    known = w.drop_null().to_numpy().astype(np.int64).view(U)
    order = np.argsort(known)
    known, tally = known[order], tally[~total][order]
    # Words of poor and of toxic rows: over all rows, and without a row that has the label, or has not.
    odds, without_one, without_other = (np.zeros((len(known) + 1, 2), np.float32) for _ in range(3))
    for j, (x, y) in enumerate(((1, 0), (2, 3))):
        share = (tot[x] + 0.5) / (tot[x] + tot[y] + 1)
        for table, less_x, less_y in ((odds, 0, 0), (without_one, 1, 0), (without_other, 0, 1)):
            a, c = np.maximum(tally[:, x] - less_x, 0), np.maximum(tally[:, y] - less_y, 0)
            table[:-1, j] = np.log((a + PRIOR_ROWS * share) / (c + PRIOR_ROWS * (1 - share))) - np.log(share / (1 - share))

    def stats(batches):
        for rb in chunks(batches):
            buf, off = utf8(rb.column(0))
            y, held = np.stack([rb.column(1).to_numpy(), rb.column(2).to_numpy()], 1), np.array(rb.column(3).to_pylist(), bool)
            x, one, other = (statistics(buf, off, known, t) for t in (odds, without_one, without_other))
            for j, has in enumerate((y[:, 0] <= 0, y[:, 1] > 0)):
                at = slice(2 * j - 4, 2 * j - 2 or None)
                x[~held, at] = np.where(has[:, None], one[:, at], other[:, at])[~held]
            yield x, y, held

    def moments(batches):
        for x, _, held in stats(batches):
            x = x[~held]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], float(len(x)))), pa.array(x.sum(0)), pa.array((x**2).sum(0))], ["i", "n", "s", "s2"])

    m = sorted(_sum(rows.mapInArrow(moments, "i bigint, n double, s double, s2 double"), "i", ["n", "s", "s2"]))
    n, s, s2 = (np.array([r[c] for r in m]) for c in ("n", "s", "s2"))
    mean = s / n
    scale = np.sqrt(np.maximum(s2 / n - mean**2, 1e-9)) + 1e-6
    rng = np.random.default_rng(seed)
    d = len(mean)
    weights = rng.standard_normal((d, features)) / np.sqrt(d) * 1.5
    model = Model(known, odds, mean, scale, weights, rng.uniform(0, 2 * np.pi, features), np.zeros((features + 1, 2)), [])

    def normal(batches):
        k = features + 1
        a = np.zeros((k, k + 2))
        for x, y, held in stats(batches):
            z = model.fourier(x[~held])
            a += z.T @ np.c_[z, y[~held]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 2))), pa.array(a.reshape(-1))], ["i", "v"])

    a = np.array([r.v for r in sorted(_sum(rows.mapInArrow(normal, "i bigint, v double"), "i", ["v"]))]).reshape(features + 1, features + 3)
    model.beta = np.linalg.solve(a[:, :-2] + ridge * n[0] / features * np.eye(features + 1), a[:, -2:])

    def held_scores(batches):
        for x, y, held in stats(batches):
            r = model.raw(x[held])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (r[:, 0], r[:, 1], y[held, 0], y[held, 1])], ["q", "t", "yq", "yt"])

    h = np.array(rows.mapInArrow(held_scores, "q double, t double, yq double, yt double").collect()).reshape(-1, 4)  # a fifth of the sample at most
    model.steps = [isotonic(h[:, j], h[:, 2 + j]) if len(h) else (np.array([0.0, 1.0]), np.array([0.0, 1.0])) for j in (0, 1)]
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("quality_score", pa.float64()), ("quality_probability", pa.float64()), ("toxic_probability", pa.float64()), ("keep", pa.bool_())])


def judge(model: Model | None, col: pa.Array, least: float, most_toxic: float) -> tuple[np.ndarray, ...]:
    if model is None:
        one = np.ones(len(col))
        return one, one, one * 0, one > 0
    raw = model.raw(statistics(*utf8(col), model.known, model.odds))
    p = model.probability(raw)
    return raw[:, 0], p[:, 0], p[:, 1], (p[:, 0] >= least) & (p[:, 1] <= most_toxic)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, quality_score, quality_probability, toxic_probability, keep, one row per row."""

    def run(batches):
        for rb in chunks(batches):
            yield record(_OUT, rb.column(0), *judge(model, rb.column(1), least, most_toxic))

    return docs.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, quality_score double, quality_probability double, toxic_probability double, keep boolean")


def keep(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """The rows that the classifier keeps, with all their columns."""

    def run(batches):
        for rb in chunks(batches, text_col):
            yield rb.filter(pa.array(judge(model, rb.column(rb.schema.get_field_index(text_col)), least, most_toxic)[3]))

    return docs.mapInArrow(run, docs.schema)
