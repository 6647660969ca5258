"""Calibration on a hold-out of later days: one sigmoid or isotonic curve for each class, then normalised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import encode
from ..schema import PROBABILITIES
from .folds import before_and_in, calibration_splits, first_days
from .models import FittedTrees, MlModel, OutcomeModel
from .scoring import score_columns

METHODS = ("sigmoid", "isotonic")


@dataclass(frozen=True)
class Sigmoid:
    slope: float
    intercept: float

    def apply(self, margin: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * margin + F.lit(self.intercept))))


@dataclass(frozen=True)
class Calibrated:
    """A fitted model with a curve for each class over its margins."""

    base: MlModel | FittedTrees
    method: str
    curves: tuple[Sigmoid | Model, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.base.margins(df)
        for k, curve in enumerate(self.curves):
            if isinstance(curve, Sigmoid):
                out = out.withColumn(f"__q{k}", curve.apply(F.col(f"margin_{k}")))
            else:
                out = curve.transform(out.withColumn("__f", F.col(f"margin_{k}"))).withColumn(f"__q{k}", F.col("prediction")).drop("__f", "prediction")
        total = F.col("__q0") + F.col("__q1") + F.col("__q2")
        even = F.lit(1.0 / 3)
        return out.withColumns({p: F.when(total > 0, F.col(f"__q{k}") / total).otherwise(even) for k, p in enumerate(PROBABILITIES)}).drop(*[c for k in range(3) for c in (f"__q{k}", f"margin_{k}")])


def _sigmoid(rows: DataFrame, k: int) -> Sigmoid:
    """Platt's fit: targets are drawn in from 0 and 1, so each row counts once as either class with weights that sum to 1."""
    high, low = rows.agg(F.count_if(F.col("label") == k), F.count_if(F.col("label") != k)).first()
    aim = F.when(F.col("label") == k, F.lit((high + 1.0) / (high + 2.0))).otherwise(F.lit(1.0 / (low + 2.0)))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), aim.alias("w")), F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - aim).alias("w"))))
    data = VectorAssembler(inputCols=[f"margin_{k}"], outputCol="m").transform(rows.select(f"margin_{k}", both.alias("e")).select(f"margin_{k}", "e.y", "e.w"))
    fitted = LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", regParam=0.0, maxIter=200, tol=1e-9).fit(data)
    return Sigmoid(float(fitted.coefficients[0]), float(fitted.intercept))


def _isotonic(rows: DataFrame, k: int) -> Model:
    data = rows.select(F.col(f"margin_{k}").alias("__f"), (F.col("label") == k).cast("double").alias("y"))
    return IsotonicRegression(featuresCol="__f", labelCol="y").fit(data)


def fit_curves(base: MlModel, hold_out: DataFrame, method: str) -> Calibrated:
    """Curves of a method over margins on the hold-out; the base model stays as it is."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    rows = base.margins(hold_out).select("margin_0", "margin_1", "margin_2", encode(F.col("result")).alias("label")).where("label is not null").persist()
    try:
        curves = tuple((_sigmoid if method == "sigmoid" else _isotonic)(rows, k) for k in range(3))
    finally:
        rows.unpersist()
    return Calibrated(base, method, curves)


def select_method(base: MlModel, hold_out: DataFrame) -> str:
    """The method of least log-loss on the last days of the hold-out, fitted on its days before; sigmoid on ties or if it's too small."""
    n = calibration_splits(hold_out)
    if n is None:
        return METHODS[0]
    early, late = before_and_in(hold_out, first_days(hold_out, n), n + 1)
    loss = {m: fit_curves(base, early, m).transform(late).agg(score_columns()["log_loss"]).first()[0] for m in METHODS}
    return min(METHODS, key=lambda m: (loss[m] is None, loss[m]))


def calibrate(model: OutcomeModel, table: DataFrame, method: str = "auto", n_splits: int | None = None) -> Calibrated | None:
    """Fit the model on all but the last fold's test days and its curves on those; None if the table is too small."""
    n = n_splits or calibration_splits(table)
    if n is None:
        return None
    earlier, hold_out = before_and_in(table, first_days(table, n), n + 1)
    base = model.fit(earlier)
    return fit_curves(base, hold_out, select_method(base, hold_out) if method == "auto" else method)
