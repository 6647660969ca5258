"""The feature table of played matches, and the same features for fixtures as of a cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..schema import GOALS, KEY, ODDS
from .families import ALL_FAMILIES, BY_SIDE, Family, side_features


def feature_table(matches: DataFrame, families: tuple[Family, ...] = ALL_FAMILIES, settings: Settings = SETTINGS) -> DataFrame:
    """Matches with every family's columns, which know strictly earlier days only; 40 columns with all families."""
    together = [family for family in ALL_FAMILIES if family.name in BY_SIDE]
    fused = all(family in families for family in together)
    rest = [family for family in families if not (fused and family in together)]
    # Every state comes from matches itself; ratings, which pass all columns through their fold, go first.
    out = reduce(lambda df, family: family.features(df, settings, matches), sorted(rest, key=lambda family: family.name != "elo"), matches)
    out = side_features(out, settings, matches) if fused else out
    return out.select(*KEY, *[c for family in families for c in family.columns], *ODDS, *GOALS, "result")


def fixture_features(matches: DataFrame, fixtures: DataFrame, cutoff: str | Column, families: tuple[Family, ...] = ALL_FAMILIES, settings: Settings = SETTINGS) -> DataFrame:
    """Features of fixtures (league, date, home, away) from all matches before the cutoff.

    A fixture's date decides its season and its days of rest; it doesn't bound the history. Fixtures never
    count as matches.
    """
    day = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    history = matches.where(F.col("date") < day)
    out = reduce(lambda df, family: family.as_of(df, history, settings), families, fixtures.select(*KEY))
    return out.select(*KEY, *[c for family in families for c in family.columns])


def unknown_teams(fixtures: DataFrame, registry: DataFrame) -> DataFrame:
    """(league, team) of fixtures that the registry (league, team) doesn't list."""
    named = fixtures.select("league", F.explode(F.array("home", "away")).alias("team")).distinct()
    return named.join(registry, ["league", "team"], "left_anti")


def require_known(fixtures: DataFrame, registry: DataFrame) -> DataFrame:
    """fixtures, or ValueError naming leagues and teams that the registry lacks (the first 20)."""
    odd = unknown_teams(fixtures, registry).orderBy("league", "team").limit(20).collect()
    if odd:
        raise ValueError("unknown: " + ", ".join(f"{r['team']} ({r['league']})" for r in odd))
    return fixtures
