"""Streaming counterparts of the point-in-time features: results arrive as a stream, days are blocks.

A table of standings is kept as event-time state: sums by team and day, closed by the watermark. The rating fold
keeps one state for each league; matches of a day wait until the watermark has passed it, so that every match of a
day sees the ratings of the morning, whatever the order in which they came.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS, Settings
from ..functions.outcomes import elo_score
from ..functions.seasons import start_year
from ..operators.accumulators import Maker, Played
from ..operators.ratings import Ratings
from ..operators.windows import team_rows

RATED = "league string, date date, home string, away string, elo_home double, elo_away double"
_STATE = "day date, teams array<string>, ratings array<double>, waiting array<struct<date:date,home:string,away:string,score:double>>"


def daily_records(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """league, team, day, played, points, gf, ga: a window of one day for each team, final once the watermark passes."""
    rows = team_rows(stream).withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    by = rows.groupBy("league", "team", F.window("ts", "1 day").alias("w"))
    sums = by.agg(F.count(F.lit(1)).alias("played"), F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    return sums.select("league", "team", F.col("w.start").cast("date").alias("day"), "played", "points", "gf", "ga")


def rated_matches(stream: DataFrame, late: str = "2 days", settings: Settings = SETTINGS) -> DataFrame:
    """Ratings before the day of every match of the stream, emitted when the watermark has passed the day.

    Matches that come later than `late` after a newer day are dropped, as the watermark says. The state of a
    league is its teams' ratings and the matches of days still open.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, teams, values, waiting = state.get if state.exists else (None, [], [], [])
        waiting = [tuple(w) for w in waiting]
        for batch in batches:
            waiting += list(zip(batch["date"], batch["home"], batch["away"], batch["score"]))
        mark = state.getCurrentWatermarkMs()
        ratings = Ratings(settings)
        ratings.now = dict(zip(teams, values))
        closed = sorted(w for w in waiting if pd.Timestamp(w[0]).value // 10**6 < mark)
        out = [(key[0], d, h, a, *ratings.play(d, h, a, s)) for d, h, a, s in closed]
        left = sorted(w for w in waiting if pd.Timestamp(w[0]).value // 10**6 >= mark)
        state.update((closed[-1][0] if closed else day, list(ratings.now), list(ratings.now.values()), left))
        if left:
            state.setTimeoutTimestamp(max(mark + 1, pd.Timestamp(left[0][0]).value // 10**6 + 1))
        yield pd.DataFrame(out, columns=["league", "date", "home", "away", "elo_home", "elo_away"])

    rows = stream.select("league", "date", "home", "away", elo_score(F.col("result")).alias("score"), F.col("date").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("league").applyInPandasWithState(fold, RATED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_MATCH = "league string, date date, home string, away string, ft_home_goals long, ft_away_goals long, result string"


def _ms(day: dt.date) -> int:
    return pd.Timestamp(day).value // 10**6


def accumulated_matches(stream: DataFrame, make: Maker, names: tuple[str, ...], late: str = "2 days", settings: Settings = SETTINGS, by_season: bool = False) -> DataFrame:
    """Matches of the stream with any accumulator's columns, emitted when the watermark has passed their day.

    State is a league's accumulator and the matches of days still open, so all matches of a day are asked before any is
    taken in, whatever the order in which they came. With by_season every season has an accumulator of its own, and its
    state goes once the watermark has passed the season's end, so state doesn't grow with the years. Rows later than
    `late` after a newer day are dropped, as the watermark says.
    """
    fields = [c.split()[0] for c in _MATCH.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, waiting = state.get if state.exists else (None, [])
        made = cloudpickle.loads(made) if made else make(settings)
        rows = [Played(*w) for w in waiting]
        for batch in batches:
            rows += [Played(*r) for r in zip(*(batch[c].tolist() for c in fields))]
        rows.sort(key=lambda m: (m.date, m.league, m.home, m.away))
        mark, out = state.getCurrentWatermarkMs(), []
        for _, day in groupby([m for m in rows if _ms(m.date) < mark], key=lambda m: m.date):
            played = list(day)
            asked = [made.pre_match(m.home, m.away, m.league, m.date) for m in played]
            out += [(m.league, m.date, m.home, m.away, *(a[n] for n in names)) for m, a in zip(played, asked)]
            for m in played:
                made.update(m)
        left = [m for m in rows if _ms(m.date) >= mark]
        end = _ms(dt.date(int(key[1]) + 1, 7, 1)) if by_season else None
        if end is not None and mark > end and not left:
            if state.exists:
                state.remove()
        else:
            state.update((cloudpickle.dumps(made), [tuple(getattr(m, c) for c in fields) for m in left]))
            due = _ms(left[0].date) if left else end
            if due is not None:
                state.setTimeoutTimestamp(max(mark, due) + 1)
        yield pd.DataFrame(out, columns=["league", "date", "home", "away", *names])

    rows = stream.select(*fields, start_year(F.col("date")).alias("__year"), F.col("date").cast("timestamp").alias("__ts")).withWatermark("__ts", late)
    groups = rows.groupBy("league", "__year") if by_season else rows.groupBy("league")
    schema = ", ".join(["league string, date date, home string, away string", *[f"`{n}` double" for n in names]])
    return groups.applyInPandasWithState(fold, schema, f"made binary, waiting array<struct<{', '.join(c.replace(' ', ':') for c in _MATCH.split(', '))}>>", "append", GroupStateTimeout.EventTimeTimeout)
