"""Outcomes: labels, points, the likeliest class and its wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES

#: The lead below which a match is too close to call, and the wording of summaries.
CLOSE_LEAD = 0.10
_PHRASES = ("a home win", "a draw", "an away win")
_CLOSE = ("Too close to call — no clear favourite (top outcome only ", "%).")
_CLEAR = ("Model favours ", " at ", "%.")


def encode(result: Column) -> Column:
    """H, D, A -> 0, 1, 2; anything else is null."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), result), F.lit(0)).cast("int") - 1


def decode(label: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), label)


def points(result: Column, side: str) -> Column:
    """League points of the home or the away side: 3 for a win, 1 for a draw."""
    won = {"home": "H", "away": "A"}[side]
    return F.when(result == won, 3).when(result == "D", 1).when(result.isNotNull(), 0).cast("long")


def elo_score(result: Column) -> Column:
    """The home side's result as 1, 0.5 or 0."""
    return F.when(result == "H", F.lit(1.0)).when(result == "D", F.lit(0.5)).when(result == "A", F.lit(0.0))


def argmax(*values: Column) -> Column:
    """Place of the largest value, from 0; ties go to the first."""
    row = F.array(*values)
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def verbal_summary(home: Column, draw: Column, away: Column) -> Column:
    """One line on the likeliest outcome, or that it is too close to call; percentages round half to even."""
    row = F.array(home, draw, away)
    ranked = F.sort_array(row, asc=False)
    top = F.get(ranked, F.lit(0))
    percent = F.bround(top * F.lit(100.0)).cast("int").cast("string")
    phrase = F.get(F.array(*[F.lit(p) for p in _PHRASES]), argmax(home, draw, away))
    close = F.concat(F.lit(_CLOSE[0]), percent, F.lit(_CLOSE[1]))
    return F.when(top - F.get(ranked, F.lit(1)) < CLOSE_LEAD, close).otherwise(F.concat(F.lit(_CLEAR[0]), phrase, F.lit(_CLEAR[1]), percent, F.lit(_CLEAR[2])))
