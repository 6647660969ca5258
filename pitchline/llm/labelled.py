"""Labelled rows for the two scorers: folds, bounded training samples, score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_view, cut

#: Most bytes of text that a training sample holds.
SAMPLE_BYTES = 32 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most `rows` labelled documents outside fold `held`, and most_bytes of text: doc_id, text, label (0 or 1).

    Which ones is decided by a hash of the id, so reruns agree; in that order documents are taken, whole, if they still
    fit into the bytes; one that doesn't is left out, and those after it may be taken. Rows without a label are left out; where an id has several labels the larger
    share decides, where it has several texts the first by code point. Ids and labels of the sample alone are
    broadcast, and `rows` bounds them. The sample lies in a file that `release` deletes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = base_view(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = cut(texts, "labelled")
    # At most `rows` ids and sizes reach the driver.
    left, within = most_bytes, []
    for row in sample.select("doc_id", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["bytes"] <= left:
            left -= row["bytes"]
            within.append((row["doc_id"],))
    within = docs.sparkSession.createDataFrame(within, "doc_id long")
    out = sample.join(F.broadcast(within), "doc_id").select("doc_id", "text", "label")
    out.cut_path = sample.cut_path
    return out


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by damped Newton on Platt's smoothed targets."""
    high, low = (labels > 0).sum(), (labels <= 0).sum()
    aim = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([0.0, np.log((high + 1) / (low + 1))])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - aim * z).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - aim)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
