"""Operators on the master table: deduplication, validation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasons import season_of
from ..schema import KEY

#: The days and the sources that a match can have.
FIRST_DAY, LAST_DAY = "1990-01-01", "2100-01-01"
SOURCES = ("football-data", "openfootball")


def keep_first(df: DataFrame, order: list[str | Column], key: tuple[str, ...] = KEY) -> DataFrame:
    """Of the rows of each key the first in order, which must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def reject_reason() -> Column:
    """Name of the first rule that a row of matches breaks, null if none; tests run on possibly null columns."""
    said = F.lit(None).cast("string")
    expected = F.when(F.col("ft_home_goals") > F.col("ft_away_goals"), "H").when(F.col("ft_home_goals") < F.col("ft_away_goals"), "A").otherwise("D")
    rules = [(f"empty_{c}", F.coalesce(F.length(c), F.lit(0)) == 0) for c in ("home", "away", "league")]
    rules += [("date", F.col("date").isNull() | (F.col("date") < F.lit(FIRST_DAY).cast("date")) | (F.col("date") > F.lit(LAST_DAY).cast("date")))]
    rules += [("goals", F.coalesce(F.least("ft_home_goals", "ft_away_goals") < 0, F.lit(False)) | F.col("ft_home_goals").isNull() | F.col("ft_away_goals").isNull())]
    rules += [("result_value", ~F.coalesce(F.col("result").isin("H", "D", "A"), F.lit(False)))]
    rules += [("odds", F.coalesce(F.least("odds_home", "odds_draw", "odds_away") <= 1.0, F.lit(False)))]
    rules += [("source", ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))), ("same_team", F.col("home") == F.col("away")), ("score", F.col("result") != expected)]
    for name, broken in reversed(rules):
        said = F.when(broken, F.lit(name)).otherwise(said)
    return said


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that don't with a column reason)."""
    judged = df.withColumn("reason", reject_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, first_date, last_date, leagues."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("league").alias("leagues"))


def season_by_league(df: DataFrame, leagues: list[str]) -> DataFrame:
    """Matches of each season by league, 0 where there are none; leagues are named so that no pass has to find them."""
    return df.groupBy(season_of(F.col("date")).alias("season")).pivot("league", leagues).agg(F.count(F.lit(1))).na.fill(0, leagues)


def outcome_share(df: DataFrame) -> DataFrame:
    """Share of each result, to three places."""
    by = counts(df, "result")
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("result", F.round(F.col("n").cast("double") / F.col("total"), 3).alias("share"))


def teams(df: DataFrame) -> DataFrame:
    """Distinct (league, team), trimmed and not empty."""
    named = df.select("league", F.explode(F.array(F.trim("home"), F.trim("away"))).alias("team"))
    return named.where("team is not null and team != ''").distinct()


def team_registry(df: DataFrame) -> DataFrame:
    """Per league the sorted names of its teams."""
    return teams(df).groupBy("league").agg(F.sort_array(F.collect_list("team")).alias("teams"))


def first_out_of_order(df: DataFrame, order: str) -> DataFrame:
    """Rows whose date is before that of the row ahead of it by `order`, within each league; none if all is in order."""
    w = Window.partitionBy("league").orderBy(order)
    return df.withColumn("ahead", F.lag("date").over(w)).where("date < ahead")
