"""Streams replayed from files end where the batch operators do."""

from __future__ import annotations

import datetime as dt
import random
import shutil
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pitchline.functions.seasons import season_of
from pitchline.operators.accumulators import accumulated_features
from pitchline.operators.ratings import Elo, elo_features
from pitchline.operators.windows import team_rows
from pitchline.schema import MATCHES
from pitchline.streaming.late import accepted_stream, split_batch, split_late, split_rows
from pitchline.streaming.standings import accumulated_matches, daily_records, rated_matches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def season():
    rng, rows = random.Random(7), {}
    for n in range(60):
        home, away = rng.sample("abcde", 2)
        date = dt.date(2022, 8, 6) + dt.timedelta(days=rng.randrange(0, 60, 3))
        hg, ag = rng.randrange(4), rng.randrange(4)
        rows[date, home, away] = ("L", date, home, away, hg, ag, "H" if hg > ag else "A" if hg < ag else "D", 2.0, 3.0, 4.0, "football-data")
    return [rows[k] for k in sorted(rows)]


def feed(spark, folder, rows):
    """Matches as files in order of day; a last match far ahead moves the watermark past all others."""
    for k in range(0, len(rows), 12):
        spark.createDataFrame(rows[k : k + 12], MATCHES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for n in (1, 2):
        spark.createDataFrame([("Z", dt.date(2023, n, 1), "x", "y", 0, 0, "D", 2.0, 3.0, 4.0, "football-data")], MATCHES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(MATCHES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, folder, name):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return f"{folder}/{name}"


def test_ratings_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = season()
    folder = f"file://{tmp_path}"
    out = spark.read.parquet(run(rated_matches(feed(spark, folder, rows)), folder, "rated")).where("league = 'L'")
    want = elo_features(spark.createDataFrame(rows, MATCHES))
    pick = lambda df: sorted((r["date"], r["home"], r["away"], round(r["elo_home"], 6), round(r["elo_away"], 6)) for r in df.collect())
    assert pick(out) == pick(want)


def test_daily_records_of_a_stream(spark, tmp_path):
    rows = season()
    folder = f"file://{tmp_path}"
    out = spark.read.parquet(run(daily_records(feed(spark, folder, rows)), folder, "records")).where("league = 'L'")
    want = team_rows(spark.createDataFrame(rows, MATCHES)).groupBy("league", "team", F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("played"), F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


class Record:
    """Points of either side so far and the goals of the last meeting."""

    feature_names = ("points_home", "points_away", "last_goals")

    def __init__(self, settings=None):
        self.points, self.last = {}, {}

    def pre_match(self, home, away, league, date, /):
        return {"points_home": float(self.points.get(home, 0)), "points_away": float(self.points.get(away, 0)), "last_goals": self.last.get(frozenset((home, away)))}

    def update(self, match, /):
        for team, won in ((match.home, "H"), (match.away, "A")):
            self.points[team] = self.points.get(team, 0) + (3 if match.result == won else 1 if match.result == "D" else 0)
        self.last[frozenset((match.home, match.away))] = float(match.ft_home_goals + match.ft_away_goals)


def picked(df, names):
    return sorted(str((r["date"], r["home"], r["away"], *(None if r[n] is None or r[n] != r[n] else round(r[n], 6) for n in names))) for r in df.where("league = 'L'").collect())


@pytest.mark.parametrize("made", [Record, Elo])
def test_any_accumulator_streams_as_in_a_batch(spark, tmp_path, made):
    rows, folder = season(), f"file://{tmp_path}"
    random.Random(1).shuffle(rows)
    stream = accumulated_matches(feed(spark, folder, rows), made, made.feature_names, late="90 days")
    out = spark.read.parquet(run(stream, folder, "made"))
    assert picked(out, made.feature_names) == picked(accumulated_features(spark.createDataFrame(rows, MATCHES), made, made.feature_names), made.feature_names)


def test_seasons_reset_and_their_state_goes(spark, tmp_path):
    """Ten seasons: values are those of a batch with an accumulator a season, and old seasons leave no state."""
    folder, rows = f"file://{tmp_path}", []
    for year in range(10):
        rows += [(*r[:1], r[1].replace(year=r[1].year + year), *r[2:]) for r in season()[:24]]
    source = feed(spark, folder, rows)
    stream = accumulated_matches(source, Record, Record.feature_names, by_season=True)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination(300)
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(sizes) >= 20 and max(sizes) <= 4
    batch = accumulated_features(spark.createDataFrame(rows, MATCHES).withColumn("season", season_of(F.col("date"))), Record, Record.feature_names, scope=("league", "season"))
    # The last day is still open.
    want = batch.where(F.col("date") < F.lit(max(r[1] for r in rows)))
    assert picked(spark.read.parquet(f"{folder}/out"), Record.feature_names) == picked(want, Record.feature_names)


def test_late_rows_are_kept_with_their_reason(spark, tmp_path):
    place, rng = f"file://{tmp_path}/split", random.Random(3)
    rows = season()
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(days=rng.choice([0, 0, 0, 5, 20])))
    shuffled[7] = (*shuffled[7][:1], None, *shuffled[7][2:])
    files = [shuffled[k : k + 12] for k in range(0, len(shuffled), 12)]

    def send(part):
        for f in part:
            spark.createDataFrame(f, MATCHES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(MATCHES).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        assert split_late(stream, place).trigger(availableNow=True).start().awaitTermination(120)

    send(files[:3])
    send(files[3:])
    want, newest = [], None
    for f in files:
        kinds = ["no_date" if r[1] is None else "late" if newest and r[1] < newest - dt.timedelta(days=2) else "accepted" for r in f]
        want += [(r[1], r[2], r[3], k) for r, k in zip(f, kinds)]
        newest = max([d for d in [newest, *[r[1] for r in f]] if d])
    key = lambda r: (r[0] or dt.date.min, *r[1:])
    got = lambda: sorted(((r["date"], r["home"], r["away"], r["kind"]) for r in split_rows(spark, place).collect()), key=key)
    assert got() == sorted(want, key=key) and {k[3] for k in want} == {"accepted", "late", "no_date"}
    # A batch that is sent again, as after a lost driver, adds nothing, nor does one whose note was never written.
    split_batch(spark.createDataFrame(files[2], MATCHES), 2, place, 2)
    shutil.rmtree(tmp_path / "split/newest/4")
    split_batch(spark.createDataFrame(files[4], MATCHES), 4, place, 2)
    assert got() == sorted(want, key=key) and (tmp_path / "split/newest/4/_SUCCESS").exists()
    out = spark.read.parquet(run(accepted_stream(spark, place, MATCHES), f"file://{tmp_path}", "again"))
    assert out.count() == sum(k[3] == "accepted" for k in want)
