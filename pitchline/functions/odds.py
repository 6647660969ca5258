"""Prices and what they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ODDS


def inverse_sum(odds: tuple[str, ...] = ODDS) -> Column:
    return sum((F.lit(1.0) / F.col(c) for c in odds[1:]), F.lit(1.0) / F.col(odds[0]))


def implied(odds: tuple[str, ...] = ODDS) -> list[Column]:
    """Probabilities that the odds imply, without the bookmaker's margin; null if any is missing."""
    return [F.lit(1.0) / F.col(c) / inverse_sum(odds) for c in odds]


def usable(odds: tuple[str, ...] = ODDS) -> Column:
    """All three odds are there and above 1."""
    each = [F.coalesce((F.col(c) > 1.0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False)) for c in odds]
    return each[0] & each[1] & each[2]


def overround(odds: tuple[str, ...] = ODDS) -> Column:
    return inverse_sum(odds) - F.lit(1.0)


def expected_value(p: Column, odds: Column) -> Column:
    """Profit that a stake of 1 has in expectation."""
    return p * odds - F.lit(1.0)


def require_usable(df: DataFrame, odds: tuple[str, ...] = ODDS) -> DataFrame:
    """df itself if every row has usable odds, else ValueError."""
    bad = df.where(~usable(odds)).limit(1).count()
    if bad:
        raise ValueError("odds must be finite and greater than 1")
    return df


def implied_strict(df: DataFrame) -> DataFrame:
    """df with p_home, p_draw, p_away implied by its odds; unusable odds raise."""
    return require_usable(df).withColumns(dict(zip(("p_home", "p_draw", "p_away"), implied())))
