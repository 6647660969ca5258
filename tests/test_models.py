"""Outcome models: invariants of each, calibration, saving, and the contest between them."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.operators import bakeoff, calibration, folds, goals, models, trees
from pitchline.operators.features import feature_table
from pitchline.schema import KEY, MATCHES
from pitchline.sources.shared import materialised

P = ("p_home", "p_draw", "p_away")
STRENGTH = {"strong": 1.0, "middle": 0.2, "weak": -0.6, "fair": 0.0}


@pytest.fixture(scope="module")
def played(spark):
    """A league where the stronger side scores more, and home sides more still."""
    rng = np.random.default_rng(4)
    rows, date = [], dt.date(2020, 8, 1)
    teams = sorted(STRENGTH)
    for _ in range(9):
        for home in teams:
            for away in teams:
                if home != away:
                    hg, ag = int(rng.poisson(math.exp(0.3 + STRENGTH[home] - STRENGTH[away] * 0.5))), int(rng.poisson(math.exp(STRENGTH[away] - STRENGTH[home] * 0.5)))
                    rows.append(("L", date, home, away, hg, ag, "H" if hg > ag else "A" if hg < ag else "D", 2.0, 3.5, None if rng.random() < 0.1 else 4.0, "football-data"))
                    date += dt.timedelta(days=3)
    return spark.createDataFrame(rows, MATCHES)


@pytest.fixture(scope="module")
def table(played):
    return materialised(feature_table(played), "test-features")


def check(df, n):
    rows = df.collect()
    assert len(rows) == n
    for r in rows:
        assert abs(sum(r[p] for p in P) - 1) < 1e-9 and all(0 <= r[p] <= 1 for p in P)
    return rows


def test_goals_order_and_fallbacks(spark, played):
    fitted = goals.fit_goals(played)
    attack = {r["team"]: r["attack"] for r in fitted.collect()}
    assert attack["strong"] > attack["middle"] > attack["weak"] and abs(sum(attack.values())) < 1e-9
    fixtures = spark.createDataFrame([("L", "strong", "weak"), ("L", "weak", "strong"), ("L", "nobody", "weak"), ("other", "x", "y")], "league string, home string, away string")
    p = {(r["home"], r["away"]): r for r in check(goals.predict_goals(fixtures, fitted), 4)}
    assert p["strong", "weak"]["p_home"] > 0.6 > p["weak", "strong"]["p_home"] and p["strong", "weak"]["p_home"] > p["nobody", "weak"]["p_home"]


def test_goals_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    n = 60
    f = goals.Likelihood(rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n).astype(float), rng.random(n), 3)
    v = rng.normal(0, 0.2, 8)
    slope = f(v)[1]
    for k in range(8):
        e = np.zeros(8)
        e[k] = 1e-6
        assert abs((f(v + e)[0] - f(v - e)[0]) / 2e-6 - slope[k]) < 1e-4


def test_goals_worked_rates(spark):
    rates = spark.createDataFrame([(1.6, 1.1, -0.05)], "lam double, mu double, rho double")
    by = {r["side"]: r["p"] for r in goals.score_matrix(rates).groupBy(F.signum(F.col("home_goals") - F.col("away_goals")).cast("int").alias("side")).agg(F.sum("p").alias("p")).collect()}
    assert [round(by[s], 5) for s in (1, 0, -1)] == [0.48366, 0.26074, 0.2556]


def test_recency(spark):
    rows = spark.createDataFrame([("L", dt.date(2020, 1, 1)), ("L", dt.date(2020, 1, 11)), ("M", dt.date(2019, 1, 1))], "league string, date date")
    assert sorted(r["weight"] for r in goals.recency_weights(rows, 10).collect()) == [0.5, 1.0, 1.0]
    assert {r["weight"] for r in goals.recency_weights(rows, None).collect()} == {1.0}


def test_scaling_fills_and_never_divides_by_zero(spark):
    rows = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (None, None, 5.0)], "a double, b double, c double")
    s = models.fit_scaling(rows, ("a", "b", "c"))
    assert s.median == (2.0, 0.0, 5.0) and s.mean == (2.0, 0.0, 5.0) and s.deviation[2] == 0.0
    assert [r["x_c"] for r in s.scaled(rows).collect()] == [0.0] * 3


def test_logistic_is_sound_and_repeats(table):
    model = models.Logistic().fit(table)
    first, second = check(model.transform(table), 108), models.Logistic().fit(table).transform(table).collect()
    key = lambda rows: sorted((tuple(r[k] for k in KEY), round(r["p_home"], 6)) for r in rows)
    assert key(first) == key(second)


def test_logistic_gives_an_unseen_class_nothing(table):
    rows = check(models.Logistic().fit(table.where("result != 'A'")).transform(table), 108)
    assert max(r["p_away"] for r in rows) < 0.01


def test_trees(spark, table, tmp_path):
    model = models.BoostedTrees(rounds=20).fit(table)
    rows = check(model.transform(table), 108)
    models.save_model(model, f"file://{tmp_path}/trees", spark)
    again = models.load_model(f"file://{tmp_path}/trees", spark).transform(table.repartition(3)).collect()
    key = lambda rows: sorted((tuple(r[k] for k in KEY), r["p_home"]) for r in rows)
    assert key(rows) == key(again) == key(models.BoostedTrees(rounds=20).fit(table.repartition(5)).transform(table).collect())
    unseen = models.BoostedTrees(rounds=2).fit(table.where("result != 'A'")).transform(table).collect()
    assert {r["p_away"] for r in unseen} == {0.0}


@pytest.mark.parametrize("block, parts", [(1 << 16, 4), (150, 3), (40, 11)])
def test_trees_grown_by_spark_are_those_grown_in_memory(spark, monkeypatch, block, parts):
    """However many blocks and tasks the rows are in, past several keepings of scores, with nulls, ties and many values."""
    monkeypatch.setattr(trees, "BLOCK", block)
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.random(400), rng.integers(0, 5, 400), rng.normal(size=400).round(1), np.full(400, np.nan)])
    x[rng.random(x.shape) < 0.15] = np.nan
    label = np.where(np.nan_to_num(x[:, 0], nan=0.9) > 0.6, 2, rng.integers(0, 3, 400))
    names = ("a", "b", "c", "d")
    rows = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], int(y)) for r, y in zip(x, label)], "a double, b double, c double, d double, __label int").repartition(parts)
    forest = trees.train(rows, names, 23, 3, 0.2)
    want = trees.fit_forest(x, label, 23, 3, 0.2, edges=trees.feature_edges(rows, names))
    for k in ("feature", "value", "nulls_left", "leaf"):
        assert (getattr(forest, k) == getattr(want, k)).all(), k
    assert (forest.probabilities(x).argmax(1) == label).mean() > 0.6
    assert not [p for p in trees.feature_edges(rows, names) if len(p) >= trees.BINS]


def test_siblings_need_no_sums_of_their_own():
    """Of each split's two nodes one is summed up, the smaller one, and both come out as all rows give them."""
    rng = np.random.default_rng(3)
    bins = rng.integers(0, trees.BINS, (3, 500)).astype(np.uint8)
    block = trees.Block(bins, rng.integers(0, 2, 500), rng.normal(size=(500, 2)))
    splits = [[(0, 90, True)], [(2, 200, False)]]
    parents = block.sums([[], []], [[0], [0]])
    wanted = [[0], [1]]
    both = trees._both(parents, block.sums(splits, wanted), wanted)
    p = trees.softmax(block.raw)
    for k, (f, last, side) in enumerate(s[0] for s in splits):
        right = np.where(bins[f] == trees.BINS - 1, not side, bins[f] > last)
        for node in (0, 1):
            for d, v in enumerate((p[:, k] - (block.label == k), 2 * p[:, k] * (1 - p[:, k]))):
                want = [np.bincount(bins[c][right == node], np.rint(v * trees.FINE)[right == node], trees.BINS) for c in range(3)]
                assert (both[k, node, :, :, d] == want).all()


def test_fits_of_a_contest_run_side_by_side(spark, table):
    """Each of two folds' fits waits for the other."""
    from threading import Barrier

    both = Barrier(2, timeout=60)

    class Waits(models.ImpliedOdds):
        def fit(self, table):
            both.wait()
            return self

    found = bakeoff.fold_scores(bakeoff.Candidate(Waits()), table, 2)
    assert [f["fold"] for f in found] == [1, 2] and all(f["n_scored"] for f in found)


def test_folds_by_days_are_those_of_the_groups(spark, table):
    split, days = folds.with_groups(table, 4), folds.first_days(table, 4)
    keys = lambda df: sorted(tuple(r) for r in df.select(*KEY).collect())
    for group in range(1, 7):
        earlier, own = folds.before_and_in(table, days, group)
        assert keys(earlier) == keys(split.where(F.col("fold_group") < group)) and keys(own) == keys(split.where(F.col("fold_group") == group))


def test_trees_without_rows(spark):
    with pytest.raises(ValueError):
        trees.train(spark.createDataFrame([], "a double, __label int"), ("a",), 2, 2, 0.1)


def test_trees_delete_their_blocks(spark, table):
    from pathlib import Path

    from pitchline.sources.shared import shared_folder

    there = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("bins-*")}
    before = there()
    models.BoostedTrees(rounds=1).fit(table)
    assert there() == before


def test_first_tree_is_the_best_by_brute_force():
    """Depth 1: of all splits at a value, with nulls on either side, the one of the highest gain."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    label = np.where(np.nan_to_num(x[:, 1], nan=9) > 6, 2, rng.integers(0, 2, 300))
    forest = trees.fit_forest(x, label, 1, 1, 0.1)
    for k in range(3):
        g, h = 1 / 3 - (label == k), np.full(300, 2 / 3 * 2 / 3)
        score = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
        best = max((round(score(left) + score(~left), 9), f, v, side) for f in range(3) for v in range(12) for side in (False, True) for left in [np.where(np.isnan(x[:, f]), side, x[:, f] <= v)] if min(h[left].sum(), h[~left].sum()) >= 1)
        left = np.where(np.isnan(x[:, forest.feature[0, k, 0]]), forest.nulls_left[0, k, 0], x[:, forest.feature[0, k, 0]] <= forest.value[0, k, 0])
        assert abs(score(left) + score(~left) - best[0]) < 1e-6
        assert np.allclose(forest.leaf[0, k], [-0.1 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_trees_learn_what_nulls_mean():
    rng = np.random.default_rng(2)
    x = rng.random((900, 4))
    label = rng.integers(0, 2, 900)
    x[label == 1, 2] = np.nan
    p = trees.fit_forest(x, label, 30, 3, 0.3).probabilities(x)
    assert ((p[:, 1] > 0.5) == (label == 1)).all() and np.allclose(p.sum(1), 1) and (p[:, 2] == 0).all()


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_keeps_the_home_advantage(table, method):
    fitted = calibration.calibrate(models.Logistic(features=("elo_diff",)), table, method)
    rows = check(fitted.transform(table), 108)
    by = sorted(rows, key=lambda r: r["elo_diff"])
    mean = lambda part: sum(r["p_home"] for r in part) / len(part)
    assert mean(by[-30:]) > mean(by[:30])


def test_calibration_falls_back(table):
    assert calibration.calibrate(models.Logistic(), table.where("result = 'H'")) is None
    with pytest.raises(ValueError):
        calibration.fit_curves(models.Logistic(features=("elo_diff",)).fit(table), table, "magic")


def test_contest_saves_and_predicts(spark, played, table, tmp_path):
    few = (bakeoff.Candidate(models.ImpliedOdds(), deployable=False), bakeoff.Candidate(models.Goals()), bakeoff.Candidate(models.Logistic(features=("elo_diff",)), calibrated=True))
    winner = bakeoff.run(table, few, n_splits=2)
    assert winner.name in ("goals", "logistic") and set(winner.metadata["models"]) == {"baseline", "goals", "logistic"}
    path = f"file://{tmp_path}/model"
    bakeoff.save(winner, path, table)
    again = bakeoff.load(path, table)
    fixtures = spark.createDataFrame([("L", dt.date(2021, 8, 1), "strong", "weak"), ("L", dt.date(2021, 8, 1), "weak", "unseen")], "league string, date date, home string, away string")
    one, two = (sorted(check(bakeoff.predict_fixtures(played, fixtures, "2021-06-01", w), 2)) for w in (winner, again))
    assert one == two


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_models_are_saved_whole(spark, table, tmp_path, method):
    model = calibration.calibrate(models.Logistic(features=("elo_diff", "form_home_ppg")), table, method)
    from pitchline.schema import FEATURE_COLUMNS

    winner = bakeoff.Winner("logistic", model, method, {"feature_columns": list(FEATURE_COLUMNS), "selected_model": "logistic", "calibration_method": method})
    bakeoff.save(winner, f"file://{tmp_path}/m", table)
    again = bakeoff.load(f"file://{tmp_path}/m", table)
    pick = lambda w: sorted(round(r["p_home"], 9) for r in w.model.transform(table).collect())
    assert pick(winner) == pick(again)




def test_queries_fit_the_whole_models(spark, monkeypatch):
    """gbt_predict and bakeoff take the defaults: all rounds, all folds, all candidates."""
    from pitchline.plans import models as plans

    seen = []
    monkeypatch.setattr(plans, "_table", lambda *_: None)
    monkeypatch.setattr(plans, "_last_fold", lambda _: (None, None))
    monkeypatch.setattr(models.BoostedTrees, "fit", lambda self, _: seen.append(self.rounds) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        plans.gbt_predict(spark, "")
    monkeypatch.setattr(plans, "_table", lambda *_: spark.range(1))
    monkeypatch.setattr(bakeoff, "fold_scores", lambda c, _, n: seen.append((c.model.rounds if isinstance(c.model, models.BoostedTrees) else 200, n)) or [{"log_loss": 1.0, "brier": 1.0, "accuracy": 1.0}])
    monkeypatch.setattr(bakeoff, "require_days", lambda *_: None)
    plans.bakeoff(spark, "")
    assert set(seen) == {200, (200, 5)} and len(seen) == 1 + len(bakeoff.CANDIDATES)
