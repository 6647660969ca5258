"""Point-in-time building blocks: what was known before a day began.

Rows of one day never see each other. Instead of a frame over single matches, records are first summed by key
and day, which Spark combines before the shuffle; a running sum over a key's days, without the day itself, is
then small whatever the number of matches, and it joins back on (key, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.outcomes import points


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows for a match, one for each team: league, date, team, venue, points, gf, ga, and the match's order."""
    side = lambda venue, team, gf, ga: F.struct(F.lit(venue).alias("venue"), F.col(team).alias("team"), points(F.col("result"), venue).alias("points"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.array(side("home", "home", "ft_home_goals", "ft_away_goals"), side("away", "away", "ft_away_goals", "ft_home_goals"))
    return matches.select("league", "date", F.struct("home", "away").alias("match"), F.inline(both))


def before_day(rows: DataFrame, key: list[str], sums: dict[str, Column], last_day: bool = False) -> DataFrame:
    """For each key and day the sums over the key's strictly earlier days; with last_day also the latest of them.

    Sums are 0 before the first day.
    """
    daily = rows.groupBy(*key, "date").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums]
    if last_day:
        out.append(F.max("date").over(earlier).alias("last_date"))
    return daily.select(*key, "date", *out)


def joined(matches: DataFrame, found: DataFrame, on: dict[str, str], prefix: str) -> DataFrame:
    """Left join of `found` by the columns on = {column of matches: column of found}; its others get the prefix."""
    there = found.select(*[F.col(f).alias(f"__{f}") for f in on.values()], *[F.col(c).alias(prefix + c) for c in found.columns if c not in on.values()])
    condition = [F.col(m) == F.col(f"__{f}") for m, f in on.items()]
    return matches.join(there, condition, "left").drop(*[f"__{f}" for f in on.values()])


def mean(total: Column, n: Column) -> Column:
    """total / n as a double, null where n is 0 or missing."""
    return F.when(n > 0, total.cast("double") / n)


def count(n: Column) -> Column:
    return F.coalesce(n, F.lit(0)).cast("double")
