"""Elo ratings: a fold over each league's matches in order, with ratings as of the start of each day.

A match moves two ratings, so a league's matches are one sequence by definition. The fold streams over sorted
partitions, batch by batch; a task keeps the ratings of its leagues' teams and nothing else in memory, however
many matches there are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.outcomes import elo_score
from ..schema import FAMILIES, KEY
from .accumulators import Played, accumulated_features

#: The home side's score by result.
SCORES = {"H": 1.0, "D": 0.5, "A": 0.0}


class Ratings:
    """Ratings of one league's teams; what was known before the current day is kept aside until the day ends."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.now: dict[str, float] = {}
        self.morning: dict[str, float] = {}
        self.day = None

    def before(self, team: str) -> float:
        """Rating before the current day."""
        return self.morning.get(team, self.now.get(team, self.s.elo_base))

    def play(self, day, home: str, away: str, score: float) -> tuple[float, float]:
        """Ratings of both sides before the day; then the match moves them."""
        if day != self.day:
            self.day, self.morning = day, {}
        known = self.before(home), self.before(away)
        h, a = self.now.get(home, self.s.elo_base), self.now.get(away, self.s.elo_base)
        for team, rating in ((home, h), (away, a)):
            self.morning.setdefault(team, rating)
        change = self.s.elo_k * (score - 1 / (1 + 10 ** (-(h + self.s.elo_home_advantage - a) / 400)))
        self.now[home] = h + change
        self.now[away] = self.now.get(away, self.s.elo_base) - change
        return known


def _ordered(matches: DataFrame, *more: str) -> DataFrame:
    """League by league in order of play; a league's rows lie in one partition."""
    rows = matches.select(*(more or KEY), elo_score(F.col("result")).alias("__score"))
    return rows.repartition("league").sortWithinPartitions(*KEY)


class Elo:
    """The ratings as an accumulator: either side's, and the difference with the home advantage added."""

    feature_names = FAMILIES["elo"]

    def __init__(self, settings: Settings = SETTINGS):
        self.ratings = Ratings(settings)

    def pre_match(self, home: str, away: str, league: str, date: dt.date, /) -> dict[str, float]:
        base, now = self.ratings.s.elo_base, self.ratings.now
        h, a = now.get(home, base), now.get(away, base)
        return dict(zip(self.feature_names, (h, a, h + self.ratings.s.elo_home_advantage - a)))

    def update(self, match: Played, /) -> None:
        self.ratings.play(match.date, match.home, match.away, SCORES.get(match.result))


def elo_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """Either side's rating before the day, and the difference with the home advantage added.

    A team without a match so far has the base rating. The fold carries all columns along, so nothing is joined back;
    the history are the matches themselves.
    """
    return accumulated_features(matches, Elo, Elo.feature_names, settings)


def elo_ratings(matches: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Every team's rating after all of the matches: league, team, rating, matches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Ratings] = {}
        played: dict[tuple[str, str], int] = {}
        for batch in batches:
            for league, day, h, a, score in zip(*(batch[c] for c in (*KEY, "__score"))):
                found.setdefault(league, Ratings(settings)).play(day, h, a, score)
                for team in (h, a):
                    played[league, team] = played.get((league, team), 0) + 1
        rows = [(league, team, rating, played[league, team]) for league, r in found.items() for team, rating in r.now.items()]
        yield pd.DataFrame(rows, columns=["league", "team", "rating", "matches"])

    return _ordered(matches).mapInPandas(fold, "league string, team string, rating double, matches long")


def elo_as_of(fixtures: DataFrame, history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """fixtures with the ratings after the whole history; unknown teams have the base rating."""
    state = elo_ratings(history, settings)
    out = fixtures
    for side in ("home", "away"):
        own = state.select(F.col("league").alias("__league"), F.col("team").alias("__team"), F.col("rating").alias("__rating"))
        out = out.join(own, (F.col("league") == F.col("__league")) & (F.col(side) == F.col("__team")), "left")
        out = out.withColumn(f"elo_{side}", F.coalesce("__rating", F.lit(settings.elo_base))).drop("__league", "__team", "__rating")
    return out.withColumn("elo_diff", F.col("elo_home") + F.lit(settings.elo_home_advantage) - F.col("elo_away"))


def zero_sum(ratings: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Per league the sum of what ratings have moved from the base: 0 up to rounding."""
    return ratings.groupBy("league").agg(F.round(F.sum(F.col("rating") - F.lit(settings.elo_base)), 6).alias("moved"))


def rank_by_rating(ratings: DataFrame) -> DataFrame:
    """ratings with each team's rank in its league, ties in order of name."""
    w = Window.partitionBy("league").orderBy(F.col("rating").desc(), "team")
    return ratings.withColumn("rank", F.row_number().over(w))
