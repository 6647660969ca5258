"""Point-in-time features: worked examples, no leakage, and equality of the two ways to get them."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitchline.config import SETTINGS, Settings
from pitchline.operators.families import Family, form_features, h2h_features, season_features, strength_features
from pitchline.operators.features import feature_table, fixture_features
from pitchline.operators.ratings import elo_features, elo_ratings, zero_sum
from pitchline.schema import FEATURE_COLUMNS, KEY, MATCHES, TABLE_COLUMNS


def day(n: int) -> dt.date:
    return dt.date(2022, 8, 6) + dt.timedelta(days=n)


def match(date, home, away, hg, ag, league="L"):
    return (league, date, home, away, hg, ag, "H" if hg > ag else "A" if hg < ag else "D", 2.0, 3.3, 3.8, "football-data")


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCHES)


def values(df, date, home, away):
    return df.where((F.col("date") == F.lit(date)) & (F.col("home") == home) & (F.col("away") == away)).first()


@pytest.fixture(scope="module")
def season(spark):
    """Five teams in two leagues, some days with several matches of one team."""
    rng = random.Random(3)
    rows = {}
    for n in range(160):
        league = rng.choice(("L", "M"))
        home, away = rng.sample(["a", "b", "c", "d", "e"], 2)
        date = day(rng.randrange(0, 420, 7))
        rows.setdefault((league, date, home, away), match(date, home, away, rng.randrange(4), rng.randrange(4), league))
    return list(rows.values())


def test_elo(spark):
    plain = Settings(elo_home_advantage=0.0)
    m = frame(spark, [match(day(0), "a", "b", 1, 0), match(day(7), "b", "a", 0, 0)])
    rated = elo_features(m, plain)
    first, second = values(rated, day(0), "a", "b"), values(rated, day(7), "b", "a")
    assert (first["elo_home"], first["elo_away"]) == (1500, 1500)
    assert (second["elo_home"], second["elo_away"]) == (1490, 1510)
    assert values(elo_features(m), day(0), "a", "b")["elo_diff"] == 65


def test_elo_is_zero_sum_and_days_are_blocks(spark, season):
    assert all(r["moved"] == 0 for r in zero_sum(elo_ratings(frame(spark, season))).collect())
    m = frame(spark, [match(day(0), "a", "b", 1, 0), match(day(0), "a", "c", 1, 0), match(day(0), "c", "b", 3, 0)])
    assert {(r["elo_home"], r["elo_away"]) for r in elo_features(m).collect()} == {(1500.0, 1500.0)}


def test_form(spark):
    m = [match(day(0), "a", "b", 2, 0), match(day(7), "c", "a", 3, 1), match(day(14), "a", "d", 0, 0)]
    row = values(form_features(frame(spark, m)), day(14), "a", "d")
    assert [row[f"form_home_{c}"] for c in ("n", "ppg", "gf", "ga")] == [2, 1.5, 1.5, 1.5]
    assert row["form_away_n"] == 0 and row["form_away_ppg"] is None
    two = values(form_features(frame(spark, [match(day(-7), "a", "b", 0, 5), match(day(0), "a", "b", 0, 0), match(day(7), "c", "a", 0, 1), match(day(14), "a", "d", 0, 0)]), Settings(rolling_window_n=2)), day(14), "a", "d")
    assert [two[f"form_home_{c}"] for c in ("ppg", "gf", "ga")] == [2.0, 0.5, 0.0]


def test_head_to_head(spark):
    m = [match(day(0), "a", "b", 2, 1), match(day(7), "b", "a", 0, 0), match(day(14), "a", "b", 0, 3)]
    row = values(h2h_features(frame(spark, m)), day(14), "a", "b")
    assert [row[c] for c in ("h2h_matches", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_home_goals_avg", "h2h_away_goals_avg")] == [2, 1, 1, 0, 1.0, 0.5]


def test_strength_counts_the_venue_and_the_season_only(spark):
    m = [match(dt.date(2022, 5, 1), "a", "b", 5, 0), match(day(0), "b", "a", 5, 0), match(day(7), "a", "b", 1, 1), match(day(14), "a", "c", 0, 0)]
    row = values(strength_features(frame(spark, m)), day(14), "a", "c")
    assert [row[f"strength_home_{c}"] for c in ("n", "ppg", "gf", "ga")] == [1, 1.0, 1.0, 1.0] and row["strength_away_n"] == 0


def test_season(spark):
    m = [match(dt.date(2022, 5, 1), "a", "b", 1, 0), match(dt.date(2022, 8, 6), "a", "b", 1, 0), match(dt.date(2022, 9, 10), "b", "a", 1, 0)]
    out = season_features(frame(spark, m))
    first, later = values(out, dt.date(2022, 8, 6), "a", "b"), values(out, dt.date(2022, 9, 10), "b", "a")
    assert (first["season_home_matchday"], first["season_fraction"], first["days_since_last_match_home"]) == (1, 1 / 38, None)
    assert (later["season_home_matchday"], later["days_since_last_match_away"]) == (2, 35)


def collected(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_table_has_its_columns_and_later_matches_change_nothing(spark, season):
    early = [r for r in season if r[1] < day(210)]
    table = feature_table(frame(spark, season))
    assert tuple(table.columns) == TABLE_COLUMNS and table.count() == len(season)
    assert collected(table.where(F.col("date") < F.lit(day(210)))) == collected(feature_table(frame(spark, early)))


def test_order_and_partitions_change_nothing(spark, season):
    shuffled = season[:]
    random.Random(1).shuffle(shuffled)
    assert collected(feature_table(frame(spark, season))) == collected(feature_table(frame(spark, shuffled).repartition(7)))


def test_fixtures_as_of_their_own_day_equal_the_table(spark, season):
    m = frame(spark, season)
    date = sorted({r[1] for r in season})[40]
    rows = feature_table(m).where(F.col("date") == F.lit(date)).select(*KEY, *FEATURE_COLUMNS)
    fixtures = m.where(F.col("date") == F.lit(date)).select(*KEY)
    assert rows.count() > 0 and collected(rows) == collected(fixture_features(m, fixtures, date.isoformat()))


def test_far_fixture_keeps_form_but_starts_a_season(spark, season):
    fixtures = spark.createDataFrame([("L", day(900), "a", "nobody")], "league string, date date, home string, away string")
    row = fixture_features(frame(spark, season), fixtures, day(800).isoformat()).first()
    assert row["form_home_n"] == 5 and row["strength_home_n"] == 0 and row["season_home_matchday"] == 1
    assert row["elo_away"] == SETTINGS.elo_base and row["form_away_n"] == 0


def test_own_family(spark, season):
    """A family of the user's own: the number of goals ever seen is not known, that of the day before is."""
    mine = Family("mine", ("answer",), lambda m, s, _: m.withColumn("answer", F.lit(42.0)), lambda f, h, s: f.withColumn("answer", F.lit(42.0)))
    assert feature_table(frame(spark, season), (mine,)).select("answer").distinct().first()[0] == 42.0


def test_empty(spark):
    assert feature_table(frame(spark, [])).count() == 0


def test_settings_from_env():
    found = Settings.from_env({"PITCHLINE_ELO_K": "32", "PITCHLINE_DC_HALF_LIFE_DAYS": "90", "PITCHLINE_CV_SPLITS": "3"})
    assert (found.elo_k, found.dc_half_life_days, found.cv_splits, found.elo_base) == (32.0, 90, 3, 1500.0)
