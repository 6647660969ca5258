"""Forward-chaining folds: train on earlier days, test on the next block of days; a day is never split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..sources.shared import materialised


def fold_groups(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """date, fold_group 1 to n_splits + 1: distinct days in near-equal blocks, longer ones first.

    Only the distinct days, a calendar's worth however many the matches, go through the single window.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    return df.select("date").distinct().select("date", F.ntile(n_splits + 1).over(Window.orderBy("date")).alias("fold_group"))


def require_days(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """df, or ValueError if it has too few distinct days for the folds."""
    days = df.select("date").distinct().limit(n_splits + 1).count()
    if days < n_splits + 1:
        raise ValueError(f"{n_splits} folds need {n_splits + 1} distinct days; there are {days}")
    return df


def with_groups(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """df with its fold_group; fold k trains on groups up to k and tests on group k + 1."""
    return df.join(F.broadcast(fold_groups(df, n_splits)), "date")


def first_days(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> dict[int, dt.date]:
    """The first day of each fold_group that has one."""
    return {r["fold_group"]: r["day"] for r in fold_groups(df, n_splits).where("date is not null").groupBy("fold_group").agg(F.min("date").alias("day")).collect()}


def before_and_in(df: DataFrame, days: dict[int, dt.date], group: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups before this one and its own, by the first days: filters, so that no pass over either joins the days again."""
    day, after = days.get(group, dt.date.max), days.get(group + 1, dt.date.max)
    return df.where(F.col("date") < F.lit(day)), df.where((F.col("date") >= F.lit(day)) & (F.col("date") < F.lit(after)))


def train_test(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """Rows of df once for each fold they take part in: fold, part ('train' or 'test')."""
    folds = F.explode(F.sequence(F.lit(1), F.lit(n_splits)))
    out = with_groups(df, n_splits).withColumn("fold", folds).where(F.col("fold_group") <= F.col("fold") + 1)
    return out.withColumn("part", F.when(F.col("fold_group") == F.col("fold") + 1, "test").otherwise("train"))


def fold_sizes(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """fold, n_train, n_test: from counts by group, so rows aren't repeated for each fold."""
    by = with_groups(df, n_splits).groupBy("fold_group").agg(F.count(F.lit(1)).alias("n"))
    fold = by.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).where(F.col("fold_group") <= F.col("fold") + 1)
    test = F.col("fold_group") == F.col("fold") + 1
    return fold.groupBy("fold").agg(F.sum(F.when(~test, F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("n_test"))


def fold_overlap(df: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """Days that a fold both trains and tests on, of which there are none."""
    split = train_test(df.select("date").distinct(), n_splits)
    return split.where("part = 'train'").select("fold", "date").intersect(split.where("part = 'test'").select("fold", "date"))


def calibration_splits(df: DataFrame, most: int = SETTINGS.cv_splits) -> int | None:
    """Number of folds that a hold-out calibration of df can use, or None.

    At most `most`, the distinct days less 1, and the rarest class's rows; all training parts and the last test
    part must hold every class, and at least two folds are needed.
    """
    row = guard(df, most).first()
    return row["n_splits"] if row["usable"] else None


def guard(df: DataFrame, most: int = SETTINGS.cv_splits) -> DataFrame:
    """One row: distinct_dates, rarest, n_splits, usable; see calibration_splits."""
    # A calendar's worth of rows, however many the matches: df, which may be a long derivation, is passed over once.
    daily = materialised(df.groupBy("date").agg(*[F.count_if(F.col("result") == c).alias(c) for c in ("H", "D", "A")]), "days")
    sizes = daily.agg(F.count("date").alias("distinct_dates"), F.least(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("H", "D", "A")]).alias("rarest"))
    row = sizes.select("distinct_dates", "rarest", F.least(F.lit(most).cast("long"), F.col("distinct_dates") - 1, F.col("rarest")).alias("n_splits"))
    n = int(row.first()["n_splits"])
    if n < 2:
        return row.withColumn("usable", F.lit(False))
    groups = with_groups(daily, n).groupBy("fold_group").agg(*[F.sum(c).alias(c) for c in ("H", "D", "A")])
    # The first training part is group 1 and all others contain it.
    holds = groups.where(F.col("fold_group").isin(1, n + 1)).agg(F.min(F.least("H", "D", "A")).alias("least"))
    return row.crossJoin(F.broadcast(holds)).select("distinct_dates", "rarest", "n_splits", F.coalesce(F.col("least") > 0, F.lit(False)).alias("usable"))
