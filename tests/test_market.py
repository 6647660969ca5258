"""Scores, folds and the market by worked examples."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pitchline.functions.odds import implied_strict
from pitchline.functions.outcomes import argmax, decode, encode, verbal_summary
from pitchline.operators import folds, market, scoring

P = "p_home double, p_draw double, p_away double"


def scored(spark, rows):
    return spark.createDataFrame(rows, f"result string, {P}")


def test_implied(spark):
    odds = "odds_home double, odds_draw double, odds_away double"
    row = implied_strict(spark.createDataFrame([(2.0, 3.0, 3.0)], odds)).first()
    assert [round(row[c], 12) for c in ("p_home", "p_draw", "p_away")] == [round(x / 7, 12) for x in (3, 2, 2)]
    for bad in (1.0, None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            implied_strict(spark.createDataFrame([(bad, 3.0, 3.0)], odds))


def test_labels(spark):
    df = spark.createDataFrame([("H",), ("D",), ("A",), ("X",), (None,)], "r string").select(encode(F.col("r")).alias("y")).withColumn("r", decode(F.col("y")))
    assert [tuple(r) for r in df.collect()] == [(0, "H"), (1, "D"), (2, "A"), (None, None), (None, None)]


def test_scores(spark):
    row = scoring.score_summary(scored(spark, [("H", 0.7, 0.2, 0.1)])).first()
    assert round(row["brier"], 12) == 0.14 and row["accuracy"] == 1 and math.isclose(row["log_loss"], -math.log(0.7))
    sure = scoring.score_summary(scored(spark, [("A", 1.0, 0.0, 0.0), ("H", None, None, None)])).first()
    assert math.isclose(sure["log_loss"], -math.log(1e-15)) and sure["n_scored"] == 1
    with pytest.raises(ValueError):
        scoring.score_summary(spark.range(1))


def test_reliability(spark):
    rows = {r["bin"]: r for r in scoring.reliability_curve(scored(spark, [("H", 0.7, 0.2, 0.1), ("H", 0.7, 0.2, 0.1)]), 2).collect()}
    assert (rows[0]["n"], round(rows[0]["mean_predicted"], 9), rows[0]["observed"]) == (4, 0.15, 0)
    assert (rows[1]["n"], rows[1]["mean_predicted"], rows[1]["observed"]) == (2, 0.7, 1)


def test_reliability_edges(spark):
    rows = {r["bin"]: r["n"] for r in scoring.reliability_curve(scored(spark, [("H", 0.0, 0.3, 0.7), ("H", 0.6, 0.4, 1.0)])).collect()}
    assert rows == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 1}


def test_summary_wording(spark):
    rows = spark.createDataFrame([(0.625, 0.2, 0.175), (0.4, 0.35, 0.25), (0.2, 0.3, 0.5)], P)
    said = [r[0] for r in rows.select(verbal_summary(*[F.col(c) for c in ("p_home", "p_draw", "p_away")])).collect()]
    assert said == ["Model favours a home win at 62%.", "Too close to call — no clear favourite (top outcome only 40%).", "Model favours an away win at 50%."]


def bets(spark, rows):
    return spark.createDataFrame(rows, f"league string, date date, home string, away string, result string, {P}, odds_home double, odds_draw double, odds_away double")


def bet(n, result, p, odds):
    return ("L", dt.date(2020, 1, n), f"h{n}", f"a{n}", result, *p, *odds)


@pytest.fixture(scope="module")
def book(spark):
    return bets(spark, [bet(1, "H", (0.6, 0.2, 0.2), (2.0, 3.0, 3.0)), bet(2, "A", (0.6, 0.2, 0.2), (2.0, 3.0, 3.0)), bet(3, "D", (0.3, 0.5, 0.2), (2.0, 2.5, 3.0)), bet(4, "H", (0.3, 0.3, 0.4), (2.0, 2.0, 2.0))])


def test_ev(spark):
    row = market.with_ev(bets(spark, [bet(1, "H", (0.5, 0.3, 0.2), (2.2, 3.5, 5.5))])).first()
    assert [round(row[c], 9) for c in ("ev_home", "ev_draw", "ev_away")] == [0.1, 0.05, 0.1]
    assert [round(market.with_edge(bets(spark, [bet(1, "H", (0.5, 0.3, 0.2), (2.0, 3.0, 3.0))])).first()["edge_home"], 9)] == [round(0.5 - 3 / 7, 9)]


def test_backtest(book):
    row = market.backtest(book).first().asDict()
    assert row == {"n_matches": 4, "n_bets": 3, "n_wins": 2, "total_staked": 3.0, "total_return": 4.5, "pnl": 1.5, "roi": 0.5, "win_rate": 2 / 3}
    none = market.backtest(book, 9.0).first()
    assert (none["n_bets"], none["roi"], none["win_rate"]) == (0, 0.0, 0.0)
    assert market.backtest(book, stake=2.0).first()["pnl"] == 3.0


def test_ties_go_to_the_first(spark):
    tie = market.with_pick(bets(spark, [bet(1, "D", (0.2, 0.5, 0.5), (2.0, 3.0, 3.0))])).first()
    assert tie["pick"] == 1 and tie["won"]
    assert spark.range(1).select(argmax(F.lit(0.4), F.lit(0.4), F.lit(0.2))).first()[0] == 0


def test_pnl(book):
    assert [r["total"] for r in market.running_pnl(book).orderBy("date").collect()] == [1.0, 0.0, 1.5, 1.5]
    assert [r["total"] for r in market.cumulative_pnl(book).orderBy("date").collect()] == [1.0, 0.0, 1.5, 1.5]


def test_folds(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 1 + n), "HDA"[n % 3]) for n in range(12)], "date date, result string")
    tested = folds.train_test(days, 3).where("part = 'test'").orderBy("date").collect()
    assert [r["date"].day for r in tested] == list(range(4, 13)) and [r["fold"] for r in tested] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert [(r["n_train"], r["n_test"]) for r in folds.fold_sizes(days, 3).orderBy("fold").collect()] == [(3, 3), (6, 3), (9, 3)]
    assert folds.fold_overlap(days, 3).count() == 0
    with pytest.raises(ValueError):
        folds.fold_groups(days, 1)
    with pytest.raises(ValueError):
        folds.require_days(days, 12)


def test_guard(spark):
    rows = [(dt.date(2020, 1, 1 + n), "HDA"[n % 3]) for n in range(24)]
    df = lambda x: spark.createDataFrame(x, "date date, result string")
    assert folds.calibration_splits(df(rows)) == 5
    assert folds.calibration_splits(df(rows[:6])) == 2 or folds.calibration_splits(df(rows[:6])) is None
    assert folds.calibration_splits(df([(d, "H") for d, _ in rows])) is None
    assert folds.calibration_splits(df([(d, "H" if n < 12 else r) for n, (d, r) in enumerate(rows)])) is None


def test_guard_passes_over_its_rows_once(spark):
    """They may be a long derivation, which would take its shuffles with each pass."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(dt.date(2020, 1, 1 + n), "HDA"[n % 3]) for n in range(24)] + [(None, "H")], "date date, result string").mapInArrow(run, "date date, result string")
    assert folds.guard(rows).first().asDict() == {"distinct_dates": 24, "rarest": 8, "n_splits": 5, "usable": True}
    assert seen.value == 25


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in market.histogram(df, "x", 4).collect()} == {0: 1, 2: 1, 3: 1}


def test_best_is_the_deployable_one(spark):
    scores = spark.createDataFrame([("a", 0, False, 0.1), ("b", 1, True, 0.5), ("c", 2, True, 0.5)], "name string, place int, deployable boolean, log_loss double")
    assert scoring.select_best(scores).first()["name"] == "b"
    assert [r["name"] for r in scoring.leaderboard(scores).collect()] == ["a", "b", "c"]
