"""Severity of toxic language by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(cut_k - w.x)`` with one weight vector ``w`` shared by
all ordered cuts. ``x`` marks which words of a selected sparse vocabulary occur
in the text (hashed words, letters and digits, A-Z folded), so a long text isn't
graded worse for being long. The expected severity is ``sum_k P(grade > k)``.

Only the fit uses a bounded sample of labelled rows (``sample_rows``); scoring
reads every whole text in one pass without a shuffle.

Defined cases: null or empty text has no words and gets the severity of the
bare cuts (below every sensible threshold); repeated rows are scored alike;
labels that are null are left out of the fit; of several labels of one id the
gravest grade counts; without labelled toxic rows the model has no words and
grades everything 0; other columns of the input are
ignored, or, in :func:`reject`, passed through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ckptlake.llm import _text


@dataclass
class OrdinalModel:
    """hashes: sorted hashes of the words with weights; cuts: ascending."""

    hashes: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    history: list[float] = field(default_factory=list)

    def latent(self, words: _text.Words) -> np.ndarray:
        """w.x of each row."""
        out = np.zeros(words.rows)
        if not len(self.hashes) or not len(words.starts):
            return out
        rows, which = match(words, self.hashes)
        np.add.at(out, rows, self.weights[which])
        return out

    def exceed(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - latent[:, None], -50, 50)))


def match(words: _text.Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in the vocabulary) of the words that are in it."""
    h = words.hashes()
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == h)
    pairs = np.unique(words.row_ids()[hit] * np.int64(len(vocabulary)) + at[hit])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _row_words(batches):
    for batch in batches:
        for at, to, buf, offsets in _text.slices(batch.column("text")):
            words = _text.Words(buf, offsets, _text.NOT_ALNUM)
            h = words.hashes().view(np.int64)
            sets = [np.unique(h[a:b]) for a, b in zip(words.row_offsets[:-1], words.row_offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").slice(at, to - at), pa.array(sets, pa.list_(pa.int64()))], ["y", "words"]
            )


def grades(labels: DataFrame) -> Column:
    """The grade of a labelled row, from its labels alone: as it is where they have several grades; else 0 not toxic, 1 toxic, 2 toxic in a text of low quality, where quality is labelled."""
    toxic = F.col("toxic").cast("int")
    return F.when((toxic == 1) & (F.col("quality").cast("int") == 0), 2).otherwise(toxic) if "quality" in labels.columns else toxic


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, vocabulary: int = 1024, share: float = 0.02, l2: float = 1e-5, steps: int = 400) -> OrdinalModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic, and quality if there).

    sample_rows: bound of the sample that is learnt from: the labelled ids of
    least hash. A cut is learnt for each grade that the sample has (see
    :func:`grades`). share: a word must occur in that part of the toxic rows.
    """
    own = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grades(labels).alias("y"))
    rows = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = _text.select(docs).join(F.broadcast(rows), "doc_id")
    got = picked.select("y", "text").mapInArrow(_row_words, "y int, words array<long>").toArrow()
    y = got.column("y").to_numpy().astype(int)
    lists = got.column("words").combine_chunks()
    lists = lists if not isinstance(lists, pa.ChunkedArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat = lists.flatten().to_numpy().view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, int)
    return _fit(y, flat, of, vocabulary, share, l2, steps)


def _fit(y: np.ndarray, flat: np.ndarray, of: np.ndarray, vocabulary: int, share: float, l2: float, steps: int) -> OrdinalModel:
    bad = y > 0
    if not bad.any() or bad.all():
        prior = (bad.sum() + 0.5) / (len(y) + 2)
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.log((1 - prior) / prior) + np.arange(max(1.0, float(y.max(initial=1)))))
    names, inverse = np.unique(flat, return_inverse=True)
    on = np.bincount(inverse, bad[of], len(names))
    off = np.bincount(inverse, ~bad[of], len(names))
    odds = np.log((on + 0.5) / (bad.sum() + 1)) - np.log((off + 0.5) / ((~bad).sum() + 1))
    rate, total = bad.mean(), on + off  # how far the counts are from those of a word that says nothing (likelihood ratio)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(on > 0, on * np.log(on / (total * rate)), 0) + np.where(off > 0, off * np.log(off / (total * (1 - rate))), 0))
    able = np.flatnonzero((on >= max(3, share * bad.sum())) & (ratio > 15) & (odds > 1))
    chosen = np.sort(able[np.argsort(-ratio[able], kind="stable")][:vocabulary])
    if not len(chosen):
        return _fit(np.zeros_like(y), flat, of, vocabulary, share, l2, steps)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[inverse] >= 0
    rows, cols = of[keep], place[inverse[keep]]
    top = int(y.max())
    w = np.zeros(len(chosen))
    cuts = np.array([np.log(((y <= k).sum() + 0.5) / ((y > k).sum() + 0.5)) for k in range(top)])
    gaps = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    m, v, history = np.zeros(len(w) + top), np.zeros(len(w) + top), []
    for step in range(1, steps + 1):
        cuts = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        s = np.bincount(rows, w[cols], len(y))
        upper = np.concatenate([cuts, [np.inf]])[y] - s
        lower = np.concatenate([[-np.inf], cuts])[y] - s
        hi, lo = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        hi, lo = np.where(y == top, 1, hi), np.where(y == 0, 0, lo)
        p = np.maximum(hi - lo, 1e-9)
        history.append(float(-np.log(p).mean()))
        g_hi, g_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (g_hi - g_lo) / len(y)  # of the loss by s
        g_cut = np.array([((y == k + 1) * g_lo).sum() - ((y == k) * g_hi).sum() for k in range(top)]) / len(y)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, g_s[rows], len(w)) + l2 * w, [tail[0]], tail[1:] * np.exp(gaps[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, gaps = w - move[: len(w)], gaps - move[len(w) :]
    cuts = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
    return OrdinalModel(names[chosen], w, cuts, history)


def _scorer(model: OrdinalModel):
    def run(batches):
        for batch in batches:
            parts = [model.exceed(model.latent(_text.Words(buf, offsets, _text.NOT_ALNUM))) for _, _, buf, offsets in _text.slices(batch.column("text"))]
            _text.release()
            p = np.concatenate(parts) if parts else np.zeros((0, len(model.cuts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0])], ["doc_id", "severity", "grade", "p_toxic"]
            )

    return run


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic) of every row: expected grade, last grade more likely reached than not, P(grade > 0)."""
    return _text.select(docs, id_col, text_col).mapInArrow(_scorer(model), "doc_id long, severity double, grade int, p_toxic double")


def reject(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose P(grade > 0) is below threshold."""
    schema = docs.schema
    _text.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            parts = [model.exceed(model.latent(_text.Words(buf, offsets, _text.NOT_ALNUM)))[:, 0] for _, _, buf, offsets in _text.slices(column)]
            _text.release()
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column | str = "doc_id", remainder: int = 0) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5; a null id is in no such fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 5 == remainder, F.lit(False))
