"""Features as accumulators: objects that say what is known before a match, and then take the match in.

A user writes a class with `pre_match` and `update` and gets a family of the feature table out of it. Matches stream
through it in order of play, day by day: all matches of a day are asked before any of them is taken in, so a feature
knows strictly earlier days only. State is kept by scope, by default a league: a task holds one accumulator and one day's
matches at a time, never a league's history. For fixtures the history streams through the same object first, and then
every fixture is asked, so training and serving can't differ.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SETTINGS, Settings
from ..schema import GOALS, KEY


@dataclass(frozen=True, slots=True)
class Played:
    """A match with its result."""

    league: str
    date: dt.date
    home: str
    away: str
    ft_home_goals: int
    ft_away_goals: int
    result: str


class Accumulator(Protocol):
    """State that grows by matches, and feature values from it."""

    feature_names: tuple[str, ...]

    def pre_match(self, home: str, away: str, league: str, date: dt.date, /) -> dict[str, float | None]:
        """Values of all features for a match of that day, from the matches taken in so far."""
        ...

    def update(self, match: Played, /) -> None:
        """Take a match in."""
        ...


#: Makes a new accumulator for a scope; it is called on executors.
Maker = Callable[[Settings], Accumulator]
_PLAYED = (*KEY, *GOALS, "result")


class _Scope:
    """One scope's accumulator, and the matches of the day that isn't over."""

    def __init__(self, made: Accumulator, names: tuple[str, ...]):
        self.made, self.names = made, names
        self.day: dt.date | None = None
        self.waiting: list[Played] = []

    def close(self) -> None:
        for match in self.waiting:
            self.made.update(match)
        self.waiting = []

    def ask(self, league: str, date: dt.date, home: str, away: str) -> list[float | None]:
        if date != self.day:
            self.close()
            self.day = date
        found = self.made.pre_match(home, away, league, date)
        if set(found) != set(self.names):
            raise ValueError(f"pre_match gives {sorted(found)}, not {sorted(self.names)}")
        return [None if found[n] is None or math.isnan(found[n]) else float(found[n]) for n in self.names]


def _with_columns(schema: T.StructType, names: tuple[str, ...]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[list]:
    return [batch[batch.schema.get_field_index(n)].to_pylist() for n in names]


def accumulated_features(matches: DataFrame, make: Maker, names: tuple[str, ...], settings: Settings = SETTINGS, scope: tuple[str, ...] = ("league",)) -> DataFrame:
    """matches with the accumulator's columns; all other columns are carried along, so nothing is joined back.

    Matches of a scope are taken in by (date, league, home, away). Rows that repeat are matches of their own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[list[float | None]] = []
            for key, row in zip(zip(*_columns(batch, scope)), map(Played, *_columns(batch, _PLAYED))):
                if state is None or key != now:
                    now, state = key, _Scope(make(settings), names)
                found.append(state.ask(row.league, row.date, row.home, row.away))
                state.waiting.append(row)
            values = zip(*found) if found else [[] for _ in names]
            yield pa.record_batch([*batch.columns, *[pa.array(list(v), pa.float64()) for v in values]], [*batch.schema.names, *names])

    order = dict.fromkeys((*scope, "date", "league", "home", "away"))
    return matches.repartition(*scope).sortWithinPartitions(*order).mapInArrow(fold, _with_columns(matches.schema, names))


def accumulated_as_of(fixtures: DataFrame, history: DataFrame, make: Maker, names: tuple[str, ...], settings: Settings = SETTINGS, scope: tuple[str, ...] = ("league",)) -> DataFrame:
    """fixtures with the accumulator's columns after the whole history, which has been cut at the cutoff already.

    History and fixtures of a scope come to one task in one sorted stream, the fixtures last; fixtures are never taken in.
    """
    own = fixtures.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[list[float | None]] = []
            asked: list[int] = []
            for i, (key, fixture, row) in enumerate(zip(zip(*_columns(batch, scope)), _columns(batch, ("__fixture",))[0], map(Played, *_columns(batch, tuple(f"__{c}" if c not in KEY else c for c in _PLAYED))))):
                if state is None or key != now:
                    now, state = key, _Scope(make(settings), names)
                if fixture:
                    state.close()
                    # The day stands still: what was played is in, and no fixture counts.
                    state.day = row.date
                    found.append(state.ask(row.league, row.date, row.home, row.away))
                    asked.append(i)
                else:
                    if row.date != state.day:
                        state.close()
                        state.day = row.date
                    state.waiting.append(row)
            rows = batch.take(pa.array(asked, pa.int64()))
            values = zip(*found) if found else [[] for _ in names]
            yield pa.record_batch([*[rows[rows.schema.get_field_index(c)] for c in own], *[pa.array(list(v), pa.float64()) for v in values]], [*own, *names])

    past = history.select(*KEY, *[F.col(c).alias(f"__{c}") for c in (*GOALS, "result")]).withColumn("__fixture", F.lit(False))
    both = past.unionByName(fixtures.withColumn("__fixture", F.lit(True)), allowMissingColumns=True)
    order = dict.fromkeys((*scope, "__fixture", "date", "league", "home", "away"))
    return both.repartition(*scope).sortWithinPartitions(*order).mapInArrow(fold, _with_columns(fixtures.schema, names))
