"""A user's accumulator as a family: against plain loops, without leaks, and the same for fixtures as for matches."""

from __future__ import annotations

import datetime as dt
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pitchline.config import SETTINGS
from pitchline.operators.accumulators import Played, accumulated_as_of, accumulated_features
from pitchline.operators.families import ALL_FAMILIES, accumulated
from pitchline.operators.features import feature_table, fixture_features
from pitchline.operators.ratings import Elo, elo_as_of
from pitchline.schema import KEY, MATCHES


# Executors can't import this file; its classes travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Streaks:
    """Matches since either side last lost, and the largest win of the league so far: neither is a sum over days."""

    feature_names = ("streak_home", "streak_away", "record")

    def __init__(self, settings=None):
        self.streak, self.record = {}, None

    def pre_match(self, home, away, league, date, /):
        return {"record": self.record, "streak_home": self.streak.get(home, 0), "streak_away": self.streak.get(away, float("nan"))}

    def update(self, match, /):
        lost = {"H": match.away, "A": match.home}.get(match.result)
        for team in (match.home, match.away):
            self.streak[team] = 0 if team == lost else self.streak.get(team, 0) + 1
        gap = abs(match.ft_home_goals - match.ft_away_goals)
        self.record = gap if self.record is None else max(gap, self.record)


STREAKS = accumulated("streaks", Streaks.feature_names, Streaks)


def rows(seed=5, n=220):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        league = rng.choice(("L", "M", "N"))
        home, away = rng.sample("abcdef", 2)
        date = dt.date(2022, 8, 6) + dt.timedelta(days=rng.randrange(0, 300, 5))
        hg, ag = rng.randrange(5), rng.randrange(5)
        out[league, date, home, away] = (league, date, home, away, hg, ag, "H" if hg > ag else "A" if hg < ag else "D", 2.0, 3.3, None, "x")
    return list(out.values())


def brute(played, league, date, home, away):
    """Streaks from all matches of the league before the day, by a new pass over them."""
    made = Streaks()
    for r in sorted(r for r in played if r[0] == league and r[1] < date):
        made.update(Played(*r[:7]))
    v = made.pre_match(home, away, league, date)
    return tuple(None if v[n] is None or v[n] != v[n] else float(v[n]) for n in Streaks.feature_names)


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (5, 3)])
def test_columns_against_a_new_pass_for_each_match(spark, parts, batch):
    played = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = accumulated_features(spark.createDataFrame(played, MATCHES).repartition(parts), Streaks, Streaks.feature_names).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(played)
    assert all(tuple(r[n] for n in Streaks.feature_names) == brute(played, *(r[k] for k in KEY)) for r in found)
    assert any(r["record"] is None for r in found) and any(r["streak_home"] > 2 for r in found)


def test_fixtures_get_what_a_match_of_the_cutoff_day_would(spark):
    played = rows(8)
    m = spark.createDataFrame(played, MATCHES)
    for cutoff in (dt.date(2022, 8, 6), dt.date(2022, 12, 4), dt.date(2024, 1, 1)):
        asked = [(le, cutoff + dt.timedelta(days=d), h, a) for le in ("L", "M", "new") for d in (0, 40) for h, a in (("a", "b"), ("f", "zz"))]
        fixtures = spark.createDataFrame(asked, "league string, date date, home string, away string").withColumn("__note", F.lit("kept"))
        out = STREAKS.as_of(fixtures, m.where(F.col("date") < F.lit(cutoff))).collect()
        assert len(out) == len(asked) and {r["__note"] for r in out} == {"kept"}
        assert all(tuple(r[n] for n in Streaks.feature_names) == brute([p for p in played if p[1] < cutoff], r["league"], dt.date(2030, 1, 1), r["home"], r["away"]) for r in out)


def test_family_joins_the_feature_table_and_the_fixtures(spark):
    m = spark.createDataFrame(rows(), MATCHES)
    families = (*ALL_FAMILIES, STREAKS)
    table = feature_table(m, families)
    assert set(Streaks.feature_names) <= set(table.columns) and table.count() == len(rows())
    cutoff = dt.date(2022, 11, 4)
    day = [r for r in rows() if r[1] >= cutoff]
    first = min(r[1] for r in day)
    fixtures = spark.createDataFrame([r[:4] for r in day if r[1] == first], "league string, date date, home string, away string")
    one = fixture_features(m, fixtures, str(first), families)
    two = table.where(F.col("date") == F.lit(first)).select(*one.columns)
    plain = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert plain(one) == plain(two)


def test_results_of_the_day_do_not_show(spark):
    played = rows()
    day = sorted(r[1] for r in played)[100]
    other = [(*r[:4], 9, 0, "H", *r[7:]) if r[1] == day else r for r in played]
    pick = lambda data: sorted(str(r) for r in accumulated_features(spark.createDataFrame(data, MATCHES), Streaks, Streaks.feature_names).where(F.col("date") <= F.lit(day)).select(*KEY, *Streaks.feature_names).collect())
    assert pick(played) == pick(other)


def test_elo_by_accumulator_is_elo_by_join(spark):
    m = spark.createDataFrame(rows(), MATCHES)
    fixtures = m.select(*KEY).distinct()
    pick = lambda df: sorted((*(r[k] for k in KEY), *(round(r[c], 6) for c in Elo.feature_names)) for r in df.collect())
    assert pick(accumulated_as_of(fixtures, m, Elo, Elo.feature_names)) == pick(elo_as_of(fixtures, m, SETTINGS))


def test_state_by_another_scope_and_empty_tables(spark):
    m = spark.createDataFrame(rows(), MATCHES)
    wide = accumulated_features(m.withColumn("all", F.lit(1)), Streaks, Streaks.feature_names, scope=("all",))
    assert wide.where("record is null").select("date").distinct().count() == 1
    assert accumulated_features(m.limit(0), Streaks, Streaks.feature_names).collect() == []
    assert STREAKS.as_of(m.select(*KEY).limit(0), m).collect() == []


def test_wrong_names_are_refused(spark):
    with pytest.raises(Exception, match="pre_match gives"):
        accumulated_features(spark.createDataFrame(rows(), MATCHES), Streaks, ("streak_home",)).collect()
