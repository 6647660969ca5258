"""Column names and types of the two tables that the package passes around."""

from __future__ import annotations

from pyspark.sql import types as T

#: Outcomes in their order (a label is a place in it) and column names of the master table.
CLASSES = ("H", "D", "A")
KEY = ("league", "date", "home", "away")
ODDS = ("odds_home", "odds_draw", "odds_away")
GOALS = ("ft_home_goals", "ft_away_goals")
PROBABILITIES = ("p_home", "p_draw", "p_away")

MATCHES = T.StructType(
    [
        T.StructField("league", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("home", T.StringType()),
        T.StructField("away", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in GOALS],
        T.StructField("result", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ODDS],
        T.StructField("source", T.StringType()),
    ]
)

_RECORD = ("ppg", "gf", "ga", "n")
#: Families of features and their columns, in table order.
FAMILIES = {
    "elo": ("elo_home", "elo_away", "elo_diff"),
    "form": tuple(f"form_{side}_{c}" for side in ("home", "away") for c in _RECORD),
    "h2h": ("h2h_matches", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_home_goals_avg", "h2h_away_goals_avg"),
    "strength": tuple(f"strength_{side}_{c}" for side in ("home", "away") for c in _RECORD),
    "season": ("season_home_matchday", "season_away_matchday", "season_fraction", "days_since_last_match_home", "days_since_last_match_away"),
}
FEATURE_COLUMNS = tuple(c for columns in FAMILIES.values() for c in columns)
TABLE_COLUMNS = KEY + FEATURE_COLUMNS + ODDS + GOALS + ("result",)


def check_features(stored: list[str]) -> None:
    """Raise if a stored model was fitted on other features, or in another order, than this package makes."""
    if list(stored) != list(FEATURE_COLUMNS):
        odd = sorted(set(stored) ^ set(FEATURE_COLUMNS))
        raise RuntimeError(f"features of the stored model differ from those made here: {odd or 'order'}")
