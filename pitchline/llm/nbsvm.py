"""Quality classifier: a linear support-vector machine over naive-Bayes-scaled n-gram indicators.

Indicators of n-grams (words, pairs of words, word shapes, pairs of shapes) are scaled by the log ratio of their
smoothed shares in the two classes; a hinge-loss linear model over them is fitted by dual coordinate descent
(Hsieh et al. 2008) and Platt-calibrated on a part of the sample that the fit doesn't see. One task fits on a
bounded sample of labelled rows. N-grams are known by 64-bit hashes, all of the sample's count, and a text's indicators
are divided by the root of the number that the model knows, in the fit as in the scores. The model, no larger than the
sample, is broadcast to the scoring tasks as sorted hashes and their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _powers, _BASE, as_strings, base_view, mix, release, text_chunks
from .labelled import fold, platt, training_sample

#: Most labelled rows that the fit sees.
SAMPLE_ROWS = 6000
#: Bits of an n-gram's hash.
BITS = 64

#: Classes of bytes in word shapes: lower-case and non-ASCII letters, capitals and digits; others stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shape_hashes(w: Words) -> np.ndarray:
    """Hash of each word's shape: its byte classes with runs of a class as one, so 'the.***' is 'a.*'."""
    kinds = _CLASS[w.buf]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[w.lo] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    short = kinds[keep].astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(short) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(short * up[: len(short)], dtype=np.uint64)])
    return mix((total[place[w.hi]] - total[place[w.lo]]) * down[place[w.lo]] + _BASE)


def indicators(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """For each text the distinct n-grams' hashes of so many bits, sorted (as signed numbers)."""
    w = Words(texts)
    shape = shape_hashes(w)
    one, two = np.uint64(1), np.uint64(2)
    pair = lambda h, salt: mix(h[:-1] * _BASE + mix(h[1:] + salt))
    same = np.where(w.hash[1:] == w.hash[:-1], one, two)
    cut_ = np.uint64(64 - bits)
    singles = np.stack([mix(w.hash + one), shape]) >> cut_
    pairs = np.stack([pair(w.hash, one), pair(shape, two) ^ same]) >> cut_ if len(w.hash) > 1 else np.zeros((2, 0), np.uint64)
    return [np.unique(np.concatenate([singles[:, a:b].ravel(), pairs[:, a : max(b - 1, a)].ravel()]).view(np.int64)) for a, b in zip(w.first[:-1], w.first[1:])]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_strings(batch["text"])
        for a, b in text_chunks(texts):
            rows = indicators(texts.slice(a, b - a))
            yield pa.record_batch([batch["doc_id"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "label", "features"])


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int) -> np.ndarray:
    """log of the smoothed share in class 1 over that in class 0, of each of 2 ** bits indicators; 0 for those in no row."""
    size = 1 << bits
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c] or [np.zeros(0, np.int64)]), minlength=size) for c in (0, 1)]
    share = [(c + 1.0) / (n + 2.0) for c, n in zip(counts, ((labels == 0).sum(), (labels == 1).sum()))]
    return np.where(counts[0] + counts[1] > 0, np.log(share[1] / share[0]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 0.1, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM; classes weigh alike, whatever their sizes."""
    sign = np.where(labels > 0, 1.0, -1.0)
    share = np.maximum([(labels <= 0).mean(), (labels > 0).mean()], 1e-9)
    upper = cost * 0.5 / share[(labels > 0).astype(int)]
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return weights, bias


def scaled(used: np.ndarray) -> float:
    """What a text's indicators are multiplied by: used are those that the model knows."""
    return 1 / np.sqrt(max(len(used), 1))


@dataclass(frozen=True)
class Model:
    """Sorted hashes of the n-grams that tell the classes apart, their weights, bias, and the calibration's slope and intercept."""

    known: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """The hinge-loss model's decision values of texts by their indicators."""
        out = np.full(len(rows), self.bias)
        if not len(self.known) or not rows:
            return out
        every = np.concatenate(rows)
        at = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
        hit = self.known[at] == every
        ends = np.cumsum([0, *map(len, rows)])
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            used = at[a:b][hit[a:b]]
            out[i] += self.weights[used].sum() * scaled(used)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.intercept, -500, 500)))


def trained(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The linear model of rows of hashes and labels 0 and 1, not calibrated."""
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]))
    places = [np.searchsorted(every, r) for r in rows]
    ratio = log_count_ratios(places, labels, max(len(every) - 1, 1).bit_length())[: len(every)]
    used = [p[ratio[p] != 0] for p in places]
    weights, bias = dual_coordinate_descent(used, [ratio[u] * scaled(u) for u in used], labels, len(every))
    kept = ratio != 0
    return Model(every[kept], (weights * ratio)[kept], bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The calibrated model of all rows; slope and intercept are those of a model of three quarters, on the last quarter."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    rest = np.arange(len(rows)) % 4 == 3
    if len(set(labels[~rest].tolist())) < 2:
        rest[:] = False
    own, check = np.flatnonzero(~rest), np.flatnonzero(rest if rest.any() else ~rest)
    slope, intercept = platt(trained([rows[i] for i in own], labels[own]).margins([rows[i] for i in check]), labels[check])
    return replace(trained(rows, labels), slope=max(slope, 0.0), intercept=intercept)


def _fitted(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values("doc_id")
    m = fit([np.asarray(f, np.int64) for f in sample["features"]], sample["label"].to_numpy())
    return pd.DataFrame({"known": [m.known.tobytes()], "weights": [m.weights.astype(np.float32).tobytes()], "rest": [[m.bias, m.slope, m.intercept]]})


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold; without any the model is undecided.

    The model comes to the driver as arrays of bytes, 12 for each n-gram of the bounded sample.
    """
    texts = training_sample(docs, labels, label, folds, held, rows)
    sample = texts.select("doc_id", "text", "label").mapInArrow(_featured, "doc_id long, label int, features array<long>")
    found = sample.groupBy(F.lit("fit")).applyInPandas(_fitted, "known binary, weights binary, rest array<double>").collect()
    release(texts)
    if not found:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(found[0]["known"], np.int64), np.frombuffer(found[0]["weights"], np.float32), *found[0]["rest"])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; texts without known n-grams get the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch["text"])
            for a, b in text_chunks(texts):
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(shared.value.scores(indicators(texts.slice(a, b - a))))], ["doc_id", "score"])

    return base_view(docs).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted.

    Needs doc_id and text of docs, doc_id and quality of labels; other columns are never read. A null text
    counts as empty, a null id as not held out. Rows that repeat get equal scores; an empty table gives an
    empty result; without labels of both classes every score is the smoothed share of class 1 (0.5 if there
    are none).
    """
    scored = score_quality(docs, train_quality(docs, labels, folds=folds, held=held, rows=rows))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
