"""Matches derived from the order tables: a supplier's nation hosts a customer's nation of the same region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matches import keep_first
from ..schema import MATCHES
from .shared import materialised

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All derived rows before deduplication, with the columns that order them."""
    t = {n: table(spark, folder, n) for n in ("lineitem", "orders", "supplier", "customer", "nation", "region")}
    nation = lambda side: t["nation"].select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(side), F.col("n_regionkey").alias(f"{side}_region"))
    # Guests meet the orders and not their lines, and nations, of a few rows, come last: lines are dealt by supplier and by order only.
    orders = t["orders"].select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date")).join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t["lineitem"].select(*_ORDER).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    played = lines.join(orders.select("o_orderkey", "date", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    played = played.join(nation("home"), F.col("s_nationkey") == F.col("home_key")).join(nation("away"), F.col("c_nationkey") == F.col("away_key"))
    played = played.where("home_region = away_region and home != away").join(t["region"], F.col("home_region") == F.col("r_regionkey"))
    goals = played.select(F.col("r_name").alias("league"), "date", "home", "away", F.pmod("l_partkey", F.lit(4)).cast("long").alias("ft_home_goals"), F.pmod("l_suppkey", F.lit(3)).cast("long").alias("ft_away_goals"), *_ORDER)
    return goals.withColumn("result", F.when(F.col("ft_home_goals") > F.col("ft_away_goals"), "H").when(F.col("ft_home_goals") < F.col("ft_away_goals"), "A").otherwise("D"))


def with_odds(df: DataFrame) -> DataFrame:
    """df with odds made from date and names; some are missing, some an unusable 1.0."""
    number = lambda c: F.substring(c, 8, 20).cast("int")
    k = F.year("date") * 7 + F.month("date") * 31 + F.day("date") * 3 + F.length("home") * 5 + number("home") * 13 + number("away") * 19
    price = lambda base, most: (F.lit(base) + F.lit(10) * (F.col("__k") % most)).cast("double") / F.lit(100.0)
    missing = F.col("__k") % 11 == 0
    out = df.withColumn("__k", k).withColumns({"odds_home": F.when(~missing, price(120, 29)), "odds_draw": F.when(~missing, price(240, 13)), "odds_away": F.when(F.col("__k") % 17 == 0, F.lit(1.0)).otherwise(price(130, 37))})
    return out.drop("__k")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """The master table: the first row of each (league, date, home, away), with odds."""
    # Lines that agree in these have the same goals, so what else orders them needn't be carried; SQL has nulls last.
    first = keep_first(raw_matches(spark, folder), [F.asc_nulls_last(c) for c in _ORDER[:4]])
    return with_odds(first).withColumn("source", F.lit("football-data")).select(*MATCHES.fieldNames())


def stored_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The master table written once, for queries that read it several times."""
    return materialised(matches(spark, folder), "matches")
