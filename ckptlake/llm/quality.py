"""Document quality by Bradley-Terry pairwise ranking.

Each text becomes a dense vector of surface statistics (how bytes of each class
are mixed, how often a word repeats the one before it, how many words differ).
From pairs of a preferred and a less good text, ``P(a over b) = sigmoid(w.(x_a -
x_b))`` is fitted by Newton's method on the logistic loss of the feature
differences. ``w.x`` ranks texts; a monotone logistic map, fitted on the same
sample, turns ranks into scores from 0 to 1; texts may be kept by a quantile of
the score.

Only the fit uses a bounded sample of labelled rows; scoring reads every whole
text once, without a shuffle. Labels, language, source and id are no features.

Defined cases: null counts as empty text; an empty text gets the score of the
zero statistics; repeated rows score alike; null labels are left out, and of
several labels of one id the lower counts; with one kind of label only, all scores are its share; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ckptlake.llm import _text

#: Classes of bytes: lower, upper, digit, blank, line end, each ASCII mark, two halves above ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 4, 5
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 6, 7
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_MARKS] = 8 + np.arange(len(_MARKS))
_N = 8 + len(_MARKS)
_GROUP = np.where(_CLASS < 8, _CLASS, 8).astype(np.uint8)
FEATURES = 2 * _N + 81 + 8


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vectors of the rows of a slice."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(rows), sizes)
    counts = np.bincount(of * _N + _CLASS[buf], minlength=rows * _N).reshape(rows, _N)
    group = _GROUP[buf].astype(np.int64)
    same = of[1:] == of[:-1]
    pairs = np.bincount((of[1:] * 81 + group[:-1] * 9 + group[1:])[same], minlength=rows * 81).reshape(rows, 81)
    words = _text.Words(buf, offsets)
    h, of_word, n = words.hashes(), words.row_ids(), np.maximum(words.counts, 1)
    again = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    repeat = np.bincount(of_word[1:][again], minlength=rows)
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][new], minlength=rows)
    length = np.bincount(of_word, words.ends - words.starts, rows)
    parts = counts / np.maximum(sizes, 1)[:, None]
    own = np.stack(
        [np.log1p(sizes), np.log1p(words.counts), repeat / n, np.log(repeat / n + 0.003), distinct / n, length / n / 10, np.log1p(n / np.maximum(distinct, 1)), np.log1p(n) * (distinct / n)], axis=1
    )
    return np.concatenate([parts, np.log(parts + 1e-3), pairs / np.maximum(sizes, 1)[:, None], own], axis=1)


@dataclass
class PairModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) * self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.rank(x) + self.shift, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, l2: float = 1.0, seed: int = 7) -> PairModel:
    """x: vectors; y: 1 for the preferred. Each pair sets a preferred row against another, all rows as evenly as can be."""
    centre, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    share = (len(good) + 0.5) / (len(y) + 1)
    if not len(good) or not len(bad):
        return PairModel(centre, scale, np.zeros(x.shape[1]), 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    z = np.clip((x - centre) * scale, -8, 8)
    a = good[np.concatenate([rng.permutation(len(good)) for _ in range(-(-pairs // len(good)))])[:pairs]]
    b = bad[np.concatenate([rng.permutation(len(bad)) for _ in range(-(-pairs // len(bad)))])[:pairs]]
    w = np.zeros(x.shape[1])
    d = z[a] - z[b]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) + l2 * w
        hess = (d * (p * (1 - p) + 1e-6)[:, None]).T @ d + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
    s = z @ w
    unit = max(s.std(), 1e-9)
    slope, shift = 1.0, float(np.log(share / (1 - share)))
    for _ in range(60):  # Newton, with each label's error kept bounded
        p = 1 / (1 + np.exp(-np.clip(slope * s / unit + shift, -30, 30)))
        r, q = p - (y * (len(good) + 1) / (len(good) + 2) + (1 - y) / (len(bad) + 2)), p * (1 - p) + 1e-6
        g = np.array([(r * s / unit).sum(), r.sum()])
        h = np.array([[(q * (s / unit) ** 2).sum(), (q * s / unit).sum()], [(q * s / unit).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope - move[0], shift - move[1]
    return PairModel(centre, scale, w, float(max(slope, 0) / unit), float(shift))


def _vectors(batches):
    for batch in batches:
        for at, to, buf, offsets in _text.slices(batch.column("text")):
            x = features(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(at, to - at), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **more) -> PairModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality); sample_rows bounds the sample: the labelled rows whose id has the least hash."""
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = _text.select(docs).join(F.broadcast(rows), "doc_id")
    got = picked.select("y", "text").mapInArrow(_vectors, "y int, x array<double>").toArrow()
    if not got.num_rows:
        return PairModel(np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0)
    x = np.array(got.column("x").to_pylist())
    return fit_pairs(x, got.column("y").to_numpy().astype(int), **more)


def score(docs: DataFrame, model: PairModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, score) of every row."""

    def run(batches):
        for batch in batches:
            x = [features(buf, offsets) for _, _, buf, offsets in _text.slices(batch.column("text"))]
            _text.release()
            x = np.concatenate(x) if x else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.rank(x)), pa.array(model.score(x))], ["doc_id", "rank", "score"])

    return _text.select(docs, id_col, text_col).mapInArrow(run, "doc_id long, rank double, score double")


def keep_above(scored: DataFrame, share: float, error: float = 1e-3) -> DataFrame:
    """The scored rows at or above the quantile that leaves out ``share`` of them; an empty table stays empty."""
    cut = scored.approxQuantile("score", [share], error)
    return scored.where(F.col("score") >= F.lit(cut[0])) if cut else scored
