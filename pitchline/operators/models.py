"""Outcome models over feature tables: fit(table) gives a fitted model whose transform(df) adds p_home, p_draw, p_away."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.odds import implied
from ..functions.outcomes import encode
from ..schema import FEATURE_COLUMNS, PROBABILITIES
from . import goals, trees
from .selection import order_statistics


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


class OutcomeModel(Protocol):
    """Anything that can be fitted to a feature table."""

    name: str

    def fit(self, table: DataFrame) -> Fitted: ...


# --- the market itself ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ImpliedOdds:
    """Probabilities implied by the odds; nothing to fit, and never a candidate to ship."""

    name: str = "baseline"

    def fit(self, table: DataFrame) -> ImpliedOdds:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(PROBABILITIES, implied())))


# --- preparation of features -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """Medians for missing values, then mean and population deviation of the filled columns."""

    columns: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]

    def filled(self, k: int) -> Column:
        return F.coalesce(F.col(self.columns[k]).cast("double"), F.lit(self.median[k]))

    def scaled(self, df: DataFrame, prefix: str = "x_") -> DataFrame:
        return df.withColumns({prefix + c: (self.filled(k) - F.lit(self.mean[k])) / F.lit(self.deviation[k] or 1.0) for k, c in enumerate(self.columns)})


def feature_medians(table: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """One row: exact median of each column, 0 where it is all null."""
    return table.sparkSession.createDataFrame([_medians(table, columns)], ", ".join(f"`{c}` double" for c in columns))


def _medians(table: DataFrame, columns: tuple[str, ...]) -> tuple[float, ...]:
    found = order_statistics(table, {c: [0.5] for c in columns})
    return tuple(0.0 if found[c][0] is None else found[c][0] for c in columns)


def feature_scaling(table: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """feature, median, mean, deviation: of the columns once their nulls are filled with the median."""
    s = fit_scaling(table, columns)
    return table.sparkSession.createDataFrame(list(zip(s.columns, s.median, s.mean, s.deviation)), "feature string, median double, mean double, deviation double")


def fit_scaling(table: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> Scaling:
    """Counts for the medians, then one aggregation of one row; a fixed number of counts a column reaches the driver."""
    median = _medians(table, columns)
    bare = Scaling(tuple(columns), median, (), ())
    row = table.agg(*[F.avg(bare.filled(k)).alias(f"m{k}") for k in range(len(columns))], *[F.stddev_pop(bare.filled(k)).alias(f"s{k}") for k in range(len(columns))]).first()
    values = [float(v or 0.0) for v in row]
    return Scaling(tuple(columns), median, tuple(values[: len(columns)]), tuple(values[len(columns) :]))


# --- logistic ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MlModel:
    """A fitted Spark ML model over scaled features; `margins` are what calibration starts from."""

    scaling: Scaling
    models: tuple[Model, ...]
    features: tuple[str, ...]

    def _assembled(self, df: DataFrame) -> DataFrame:
        scaled = self.scaling.scaled(df)
        return VectorAssembler(inputCols=[f"x_{c}" for c in self.features], outputCol="__x").transform(scaled).drop(*[f"x_{c}" for c in self.features])

    def margins(self, df: DataFrame) -> DataFrame:
        """df with margin_0 to margin_2: the decision values of the multinomial model."""
        out = self.models[0].transform(self._assembled(df))
        raw = vector_to_array("rawPrediction")
        return out.withColumns({f"margin_{k}": F.get(raw, F.lit(k)) for k in range(3)}).drop("__x", "rawPrediction", "probability", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.margins(df)
        raw = [F.exp(F.col(f"margin_{k}") - F.greatest("margin_0", "margin_1", "margin_2")) for k in range(3)]
        total = raw[0] + raw[1] + raw[2]
        return out.withColumns({p: r / total for p, r in zip(PROBABILITIES, raw)}).drop("margin_0", "margin_1", "margin_2")


def _labelled(table: DataFrame) -> DataFrame:
    return table.withColumn("__label", encode(F.col("result")).cast("double")).where("__label is not null")


@dataclass(frozen=True)
class Logistic:
    """Multinomial logistic regression over standardised features with an L2 penalty of one over the rows."""

    name: str = "logistic"
    features: tuple[str, ...] = FEATURE_COLUMNS
    iterations: int = 1000

    def fit(self, table: DataFrame) -> MlModel:
        rows = _labelled(table)
        scaling = fit_scaling(rows, self.features)
        n, top = rows.agg(F.count(F.lit(1)), F.max("__label")).first()
        shell = MlModel(scaling, (), self.features)
        # A row of weight almost 0 for each class fixes their number at three when a class is missing.
        data = shell._assembled(rows).select("__x", "__label", F.lit(1.0).alias("__w"))
        if top is not None and top < 2:
            data = data.unionByName(data.limit(1).select("__x", F.lit(2.0).alias("__label"), F.lit(1e-9).alias("__w")))
        learner = LogisticRegression(featuresCol="__x", labelCol="__label", weightCol="__w", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1.0 / max(n, 1), maxIter=self.iterations, tol=1e-8)
        return MlModel(scaling, (learner.fit(data),), self.features)


@dataclass(frozen=True)
class FittedTrees:
    """Boosted trees; calibration starts from their probabilities."""

    forest: trees.Forest
    features: tuple[str, ...]

    def margins(self, df: DataFrame) -> DataFrame:
        return trees.predicted(df, self.forest, self.features, ("margin_0", "margin_1", "margin_2"))

    def transform(self, df: DataFrame) -> DataFrame:
        return trees.predicted(df, self.forest, self.features, PROBABILITIES)


@dataclass(frozen=True)
class BoostedTrees:
    """Multiclass boosted trees with the softmax loss, fitted on all labelled rows; missing values are routed by the splits themselves."""

    name: str = "boosted_trees"
    features: tuple[str, ...] = FEATURE_COLUMNS
    rounds: int = 200
    depth: int = 3
    rate: float = 0.1

    def fit(self, table: DataFrame) -> FittedTrees:
        return FittedTrees(trees.train(_labelled(table), self.features, self.rounds, self.depth, self.rate), self.features)


@dataclass(frozen=True)
class FittedGoals:
    strengths: DataFrame
    max_goals: int

    def transform(self, df: DataFrame) -> DataFrame:
        return goals.predict_goals(df, self.strengths, self.max_goals)


@dataclass(frozen=True)
class Goals:
    """The goals model of each league."""

    name: str = "goals"
    half_life_days: int | None = SETTINGS.dc_half_life_days
    max_goals: int = SETTINGS.dc_max_goals

    def fit(self, table: DataFrame) -> FittedGoals:
        # A row for each team: small enough to keep on the driver, and then no prediction fits again.
        found = goals.fit_goals(table, self.half_life_days)
        return FittedGoals(table.sparkSession.createDataFrame(found.toPandas(), found.schema), self.max_goals)


# --- saving -------------------------------------------------------------------------------------------------------


def save_model(model: MlModel | FittedTrees | FittedGoals, path: str, spark: SparkSession) -> None:
    """Write a fitted model as Spark ML models, Parquet or JSON, with its scaling and features beside it."""
    if isinstance(model, FittedGoals):
        model.strengths.write.mode("overwrite").parquet(f"{path}/strengths")
        head = {"kind": "goals", "max_goals": model.max_goals}
    elif isinstance(model, FittedTrees):
        head = {"kind": "trees", "features": list(model.features), "forest": model.forest.as_dict()}
    else:
        PipelineModel(stages=list(model.models)).write().overwrite().save(f"{path}/models")
        s = model.scaling
        head = {"kind": "ml", "features": list(model.features), "columns": list(s.columns), "median": list(s.median), "mean": list(s.mean), "deviation": list(s.deviation)}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load_model(path: str, spark: SparkSession) -> MlModel | FittedTrees | FittedGoals:
    head = json.loads(spark.read.text(f"{path}/head").first()["value"])
    if head["kind"] == "goals":
        return FittedGoals(spark.read.parquet(f"{path}/strengths"), head["max_goals"])
    if head["kind"] == "trees":
        return FittedTrees(trees.Forest.from_dict(head["forest"]), tuple(head["features"]))
    stages = PipelineModel.load(f"{path}/models").stages
    return MlModel(Scaling(*[tuple(head[k]) for k in ("columns", "median", "mean", "deviation")]), tuple(stages), tuple(head["features"]))


