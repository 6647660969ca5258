"""Families of features, each as of strictly before a match's day, and as of a cutoff for fixtures.

Every family is a pair of functions: `*_features(matches, settings, history)` gives the rows of matches with the
family's columns, which it derives from the history (by default the matches themselves, perhaps before other families'
columns were added),
`*_as_of(fixtures, history)` the rows of fixtures (league, date, home, away) with them, where the history has been
cut already and a fixture's own date only decides its season. All are plain joins and windows but the ratings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.outcomes import points
from ..functions.seasons import season_of
from ..schema import FAMILIES
from .accumulators import Maker, accumulated_as_of, accumulated_features
from .ratings import elo_as_of, elo_features
from .windows import before_day, count, joined, mean, team_rows


def _record_columns(out: DataFrame, family: str, side: str) -> DataFrame:
    """Means and count from the columns <side>_points, _gf, _ga, _n."""
    n = F.col(f"{side}_n")
    named = {f"{family}_{side}_{name}": mean(F.col(f"{side}_{total}"), n) for name, total in (("ppg", "points"), ("gf", "gf"), ("ga", "ga"))}
    return out.withColumns(named | {f"{family}_{side}_n": count(n)}).drop(*[f"{side}_{c}" for c in ("points", "gf", "ga", "n")])


def _record_sums() -> dict[str, Column]:
    return {"points": F.col("points"), "gf": F.col("gf"), "ga": F.col("ga"), "n": F.lit(1)}


# --- form: the last few matches, at any venue ---------------------------------------------------------------


def _latest(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """The last `most` rows of each key by (date, match), in order, as an array `recent` of (points, gf, ga)."""
    w = Window.partitionBy(*key).orderBy(F.col("date").desc(), F.col("match").desc())
    last = rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "points", "gf", "ga")))
    return last.groupBy(*key).agg(ordered.alias("recent"))


def _form_columns(out: DataFrame, side: str) -> DataFrame:
    recent = F.col(f"{side}_recent")
    total = lambda field: F.aggregate(F.transform(recent, lambda e: e[field]), F.lit(0).cast("long"), lambda a, x: a + x)
    return _record_columns(out.withColumns({f"{side}_{f}": total(f) for f in ("points", "gf", "ga")} | {f"{side}_n": F.size(recent)}), "form", side).drop(f"{side}_recent")


def _form_state(rows: DataFrame, settings: Settings) -> DataFrame:
    """league, team, date, recent: each team's last few matches before every day that it plays.

    A day keeps its last rows only, so a window over days holds all that can count: as many earlier days as
    matches are wanted.
    """
    most = settings.rolling_window_n
    days = _latest(rows, ["league", "team", "date"], most)
    earlier = Window.partitionBy("league", "team").orderBy("date").rowsBetween(-most, -1)
    recent = F.flatten(F.collect_list("recent").over(earlier))
    tail = F.slice(recent, F.greatest(F.size(recent) - most, F.lit(0)) + 1, F.lit(most))
    return days.select("league", "team", "date", tail.alias("recent"))


def _with_sides(matches: DataFrame, home: DataFrame, away: DataFrame) -> DataFrame:
    """matches with the columns of either side's state (league, team, date, ...) as home_... and away_..."""
    out = joined(matches, home, {"league": "league", "home": "team", "date": "date"}, "home_")
    return joined(out, away, {"league": "league", "away": "team", "date": "date"}, "away_")


def form_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """Means of points and goals over each side's last few matches of strictly earlier days."""
    state = _form_state(team_rows(history or matches), settings)
    return _form_columns(_form_columns(_with_sides(matches, state, state), "home"), "away")


def form_as_of(fixtures: DataFrame, history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    state = _latest(team_rows(history), ["league", "team"], settings.rolling_window_n)
    out = fixtures
    for side in ("home", "away"):
        missing = F.coalesce(f"{side}_recent", F.array().cast("array<struct<at:int,points:bigint,gf:bigint,ga:bigint>>"))
        out = _form_columns(joined(out, state, {"league": "league", side: "team"}, f"{side}_").withColumn(f"{side}_recent", missing), side)
    return out


# --- head to head: earlier meetings of a pair, whoever was at home --------------------------------------------


def _meetings(matches: DataFrame) -> DataFrame:
    """Matches by unordered pair: low and high name, with goals and wins of either."""
    low_home = F.col("home") <= F.col("away")
    pick = lambda a, b: F.when(low_home, a).otherwise(b)
    won = lambda side: (F.col("result") == side).cast("long")
    return matches.select("league", "date", F.least("home", "away").alias("low"), F.greatest("home", "away").alias("high"), pick(won("H"), won("A")).alias("low_wins"), pick(won("A"), won("H")).alias("high_wins"), won("D").alias("drawn"), pick(F.col("ft_home_goals"), F.col("ft_away_goals")).alias("low_goals"), pick(F.col("ft_away_goals"), F.col("ft_home_goals")).alias("high_goals"))


_TALLY = ("low_wins", "high_wins", "drawn", "low_goals", "high_goals")


def _h2h_columns(out: DataFrame) -> DataFrame:
    low_home = F.col("home") <= F.col("away")
    pick = lambda a, b: F.when(low_home, F.col(f"h_{a}")).otherwise(F.col(f"h_{b}"))
    n = F.col("h_n")
    columns = (count(n), count(pick("low_wins", "high_wins")), count(F.col("h_drawn")), count(pick("high_wins", "low_wins")), mean(pick("low_goals", "high_goals"), n), mean(pick("high_goals", "low_goals"), n))
    return out.withColumns(dict(zip(FAMILIES["h2h"], columns))).drop("__low", "__high", "h_n", *[f"h_{c}" for c in _TALLY])


def _paired(df: DataFrame) -> DataFrame:
    return df.withColumns({"__low": F.least("home", "away"), "__high": F.greatest("home", "away")})


def h2h_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """Matches, wins, draws and mean goals of earlier meetings, seen from today's home side."""
    state = before_day(_meetings(history or matches), ["league", "low", "high"], {c: F.col(c) for c in _TALLY} | {"n": F.lit(1)})
    state = state.withColumnsRenamed({"low": "p_low", "high": "p_high"})
    return _h2h_columns(joined(_paired(matches), state, {"league": "league", "__low": "p_low", "__high": "p_high", "date": "date"}, "h_"))


def h2h_as_of(fixtures: DataFrame, history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    state = _meetings(history).groupBy("league", F.col("low").alias("p_low"), F.col("high").alias("p_high")).agg(*[F.sum(c).alias(c) for c in _TALLY], F.count(F.lit(1)).alias("n"))
    return _h2h_columns(joined(_paired(fixtures), state, {"league": "league", "__low": "p_low", "__high": "p_high"}, "h_"))


# --- strength: this season's record at the venue ---------------------------------------------------------------


def _at_venue(matches: DataFrame, side: str) -> DataFrame:
    gf, ga = ("ft_home_goals", "ft_away_goals") if side == "home" else ("ft_away_goals", "ft_home_goals")
    return matches.select("league", "date", F.col(side).alias("team"), season_of(F.col("date")).alias("season"), points(F.col("result"), side).alias("points"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))


def _strength_state(matches: DataFrame, side: str) -> DataFrame:
    return before_day(_at_venue(matches, side), ["league", "team", "season"], _record_sums()).drop("season")


def strength_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """The home side's home record and the away side's away record in the season so far."""
    out = _with_sides(matches, _strength_state(history or matches, "home"), _strength_state(history or matches, "away"))
    return _record_columns(_record_columns(out, "strength", "home"), "strength", "away")


def strength_as_of(fixtures: DataFrame, history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    out = fixtures.withColumn("__season_now", season_of(F.col("date")))
    for side in ("home", "away"):
        state = _at_venue(history, side).groupBy("league", "team", "season").agg(*[F.sum(c).alias(name) for name, c in _record_sums().items()])
        out = _record_columns(joined(out, state, {"league": "league", side: "team", "__season_now": "season"}, f"{side}_"), "strength", side)
    return out.drop("__season_now")


# --- season: matchday, progress and rest ------------------------------------------------------------------------


def _season_columns(out: DataFrame, settings: Settings) -> DataFrame:
    matchday = {side: F.coalesce(f"{side}_played", F.lit(0)) + 1 for side in ("home", "away")}
    rest = {side: F.datediff("date", f"{side}_last_date").cast("double") for side in ("home", "away")}
    fraction = F.least(F.lit(1.0), F.greatest(matchday["home"], matchday["away"]).cast("double") / F.lit(float(settings.season_matchdays)))
    columns = (matchday["home"].cast("double"), matchday["away"].cast("double"), fraction, rest["home"], rest["away"])
    return out.withColumns(dict(zip(FAMILIES["season"], columns))).drop(*[f"{s}_{c}" for s in ("home", "away") for c in ("played", "last_date")])


def _season_state(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("season", season_of(F.col("date")))
    return before_day(rows, ["league", "team", "season"], {"played": F.lit(1)}, last_day=True).drop("season")


def season_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """Matchday of either side, season's progress, and days since either side's last match this season."""
    state = _season_state(team_rows(history or matches))
    return _season_columns(_with_sides(matches, state, state), settings)


def side_features(matches: DataFrame, settings: Settings = SETTINGS, history: DataFrame | None = None) -> DataFrame:
    """Form, strength and season at once: states are put together by team and day first, so matches are joined once a side."""
    history = history or matches
    key, rows = ["league", "team", "date"], team_rows(history)
    both = _form_state(rows, settings).join(_season_state(rows), key)
    out = _with_sides(matches, *[both.join(_strength_state(history, side), key, "left") for side in ("home", "away")])
    for side in ("home", "away"):
        # The record's n is the strength's; form counts its own.
        out = _record_columns(out, "strength", side)
        out = _form_columns(out, side)
    return _season_columns(out, settings)


def season_as_of(fixtures: DataFrame, history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    rows = team_rows(history).withColumn("season", season_of(F.col("date")))
    state = rows.groupBy("league", "team", "season").agg(F.count(F.lit(1)).alias("played"), F.max("date").alias("last_date"))
    out = fixtures.withColumn("__season_now", season_of(F.col("date")))
    for side in ("home", "away"):
        out = joined(out, state, {"league": "league", side: "team", "__season_now": "season"}, f"{side}_")
    return _season_columns(out, settings).drop("__season_now")


@dataclass(frozen=True)
class Family:
    """What a family of features consists of; users may add their own to the feature table."""

    name: str
    columns: tuple[str, ...]
    features: Callable[..., DataFrame]
    as_of: Callable[..., DataFrame]


def accumulated(name: str, columns: tuple[str, ...], make: Maker, scope: tuple[str, ...] = ("league",)) -> Family:
    """A family whose columns an accumulator gives: make(settings) is a new one for each scope."""
    return Family(
        name,
        columns,
        lambda matches, settings=SETTINGS, history=None: accumulated_features(matches, make, columns, settings, scope),
        lambda fixtures, history, settings=SETTINGS: accumulated_as_of(fixtures, history, make, columns, settings, scope),
    )


ALL_FAMILIES = (
    Family("elo", FAMILIES["elo"], elo_features, elo_as_of),
    Family("form", FAMILIES["form"], form_features, form_as_of),
    Family("h2h", FAMILIES["h2h"], h2h_features, h2h_as_of),
    Family("strength", FAMILIES["strength"], strength_features, strength_as_of),
    Family("season", FAMILIES["season"], season_features, season_as_of),
)
#: Families that side_features makes together.
BY_SIDE = ("form", "strength", "season")
