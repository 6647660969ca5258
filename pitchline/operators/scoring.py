"""Proper scores and reliability of three-way probabilities p_home, p_draw, p_away against the label."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import argmax, encode
from ..schema import PROBABILITIES

LEAST = 1e-15


def require_probabilities(df: DataFrame, columns: tuple[str, ...] = PROBABILITIES) -> DataFrame:
    """df, or ValueError if a probability column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df


def _p() -> list[Column]:
    return [F.col(c) for c in PROBABILITIES]


def true_class(label: Column) -> Column:
    return F.get(F.array(*_p()), label)


def log_loss_of(label: Column) -> Column:
    return -F.ln(F.least(F.greatest(true_class(label), F.lit(LEAST)), F.lit(1.0)))


def brier_of(label: Column) -> Column:
    return sum(((p - (label == i).cast("double")) * (p - (label == i).cast("double")) for i, p in enumerate(_p())), F.lit(0.0))


def hit_of(label: Column) -> Column:
    return F.when(F.col(PROBABILITIES[0]).isNotNull(), (argmax(*_p()) == label).cast("double"))


def score_columns() -> dict[str, Column]:
    """Aggregates log_loss, brier, accuracy and n_scored; rows without probabilities count in none of them."""
    label = encode(F.col("result"))
    scored = F.col(PROBABILITIES[0]).isNotNull() & label.isNotNull()
    return {"log_loss": F.avg(log_loss_of(label)), "brier": F.avg(brier_of(label)), "accuracy": F.avg(hit_of(label)), "n_scored": F.count_if(scored)}


def score_summary(df: DataFrame, *by: str) -> DataFrame:
    """Mean scores, over all rows or by group."""
    require_probabilities(df)
    return (df.groupBy(*by) if by else df).agg(*[c.alias(name) for name, c in score_columns().items()])


def macro_scores(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Plain mean over folds of each fold's scores."""
    return score_summary(df, fold).agg(*[F.avg(c).alias(c) for c in ("log_loss", "brier", "accuracy")])


def reliability_curve(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, low, high, n, mean_predicted, observed over all three classes' probabilities.

    Bins are equally wide and closed on the left, the last one on both sides; edges are those of linspace. Bins
    without rows have n 0 and no means.
    """
    edges = np.linspace(0.0, 1.0, n_bins + 1).tolist()
    label = encode(F.col("result"))
    each = F.inline(F.array(*[F.struct(p.alias("p"), (label == i).cast("double").alias("hit")) for i, p in enumerate(_p())]))
    flat = df.select(each).where("p is not null and hit is not null")
    placed = Bucketizer(splits=edges, inputCol="p", outputCol="bin").transform(flat)
    found = placed.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("observed"))
    bins = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n_bins)], "bin int, low double, high double")
    return bins.join(found, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_predicted", "observed")


def leaderboard(scores: DataFrame) -> DataFrame:
    """Scores (name, place, deployable, log_loss, ...) by log-loss, ties in order of declaration."""
    return scores.orderBy("log_loss", "place")


def select_best(scores: DataFrame) -> DataFrame:
    """The deployable candidate of least log-loss; ties go to the one declared first."""
    return leaderboard(scores.where("deployable")).limit(1)
