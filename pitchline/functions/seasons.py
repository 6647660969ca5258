"""Seasons: they begin in July and are named by two two-digit years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def season_code(start_year: Column) -> Column:
    """2023 -> '2324'."""
    two = lambda year: F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0")
    return F.concat(two(start_year), two(start_year + 1))


def start_year(date: Column) -> Column:
    return F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)


def season_of(date: Column) -> Column:
    return season_code(start_year(date))


def recent_seasons(spark: SparkSession, n: int, today: str | None = None) -> DataFrame:
    """The last n start years up to today, the most recent last: columns start_year, season."""
    day = F.lit(today).cast("date") if today else F.current_date()
    years = spark.range(1).select(F.explode(F.sequence(start_year(day) - (n - 1), start_year(day))).alias("start_year"))
    return years.select("start_year", season_code(F.col("start_year")).alias("season"))


def recent_seasons_of(days: DataFrame, n: int) -> DataFrame:
    """The last n start years up to the latest `date` of days: start_year, season; nothing without a date."""
    last = days.agg(F.max("date").alias("day")).where("day is not null")
    years = last.select(F.explode(F.sequence(start_year(F.col("day")) - (n - 1), start_year(F.col("day")))).alias("start_year"))
    return years.select("start_year", season_code(F.col("start_year")).alias("season"))


def file_name(division: Column, year: Column) -> Column:
    return F.concat(division, F.lit("_"), season_code(year), F.lit(".csv"))


def file_url(base: str, division: Column, year: Column) -> Column:
    """Address of one season's file below a base address."""
    return F.concat(F.lit(base), season_code(year), F.lit("/"), division, F.lit(".csv"))
