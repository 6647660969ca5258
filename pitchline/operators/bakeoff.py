"""Candidates compared under forward-chaining folds; the best deployable one is refitted on everything."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from importlib.metadata import version

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..schema import FEATURE_COLUMNS, check_features
from .calibration import Calibrated, calibrate
from .features import fixture_features
from .folds import before_and_in, first_days, require_days
from .models import BoostedTrees, Fitted, Goals, ImpliedOdds, Logistic, OutcomeModel, load_model, save_model
from .scoring import leaderboard, score_summary, select_best

#: Candidates and folds of each that are fitted side by side: a fit is a chain of small jobs, or one task, that leaves most cores idle.
CANDIDATES_ABREAST, FOLDS_ABREAST = 2, 4


@dataclass(frozen=True)
class Candidate:
    model: OutcomeModel
    deployable: bool = True
    calibrated: bool = False

    @property
    def name(self) -> str:
        return self.model.name


CANDIDATES = (Candidate(ImpliedOdds(), deployable=False), Candidate(Logistic(), calibrated=True), Candidate(BoostedTrees(), calibrated=True), Candidate(Goals()))


def fit_candidate(candidate: Candidate, table: DataFrame, method: str = "sigmoid") -> Fitted:
    """The candidate as it would ship: calibrated where it should be and the table allows it."""
    found = calibrate(candidate.model, table, method) if candidate.calibrated else None
    return found or candidate.model.fit(table)


def out_of_sample(candidate: Candidate, table: DataFrame, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """Rows of all test folds with probabilities of models that were fitted on earlier days: a column fold more."""
    days, parts = first_days(table, n_splits), []
    for fold in range(1, n_splits + 1):
        train, test = before_and_in(table, days, fold + 1)
        parts.append(fit_candidate(candidate, train).transform(test).withColumn("fold", F.lit(fold)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fold_score(candidate: Candidate, table: DataFrame, days: dict[int, dt.date], fold: int) -> dict:
    train, test = before_and_in(table, days, fold + 1)
    return {"fold": fold} | score_summary(fit_candidate(candidate, train).transform(test)).first().asDict()


def _abreast(table: DataFrame, most: int, run: Callable, rest: list[tuple]) -> list:
    """run(*arguments) for each of `rest`, at most so many at a time, in threads that keep the session's settings."""
    run = inheritable_thread_target(table.sparkSession)(run)
    with ThreadPoolExecutor(most) as pool:
        begun = [pool.submit(run, *arguments) for arguments in rest]
        try:
            return [found.result() for found in begun]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def fold_scores(candidate: Candidate, table: DataFrame, n_splits: int = SETTINGS.cv_splits) -> list[dict]:
    """Scores of each fold, one aggregation a fold: fold, log_loss, brier, accuracy, n_scored."""
    days = first_days(table, n_splits)
    # Long folds first.
    return _abreast(table, FOLDS_ABREAST, _fold_score, [(candidate, table, days, fold) for fold in range(n_splits, 0, -1)])[::-1]


def compare(table: DataFrame, candidates: tuple[Candidate, ...] = CANDIDATES, n_splits: int = SETTINGS.cv_splits) -> DataFrame:
    """name, place, deployable, log_loss, brier, accuracy: plain means over folds, best first.

    The table is passed over many times; it should be a written one.
    """
    require_days(table, n_splits)
    rows = []
    for place, (c, found) in enumerate(zip(candidates, _abreast(table, CANDIDATES_ABREAST, fold_scores, [(c, table, n_splits) for c in candidates]))):
        mean = {k: [f[k] for f in found if f[k] is not None] for k in ("log_loss", "brier", "accuracy")}
        rows.append((c.name, place, c.deployable, *[sum(v) / len(v) if v else None for v in mean.values()]))
    schema = "name string, place int, deployable boolean, log_loss double, brier double, accuracy double"
    return leaderboard(table.sparkSession.createDataFrame(rows, schema))


@dataclass(frozen=True)
class Winner:
    name: str
    model: Fitted
    method: str | None
    metadata: dict


def run(table: DataFrame, candidates: tuple[Candidate, ...] = CANDIDATES, n_splits: int = SETTINGS.cv_splits, data_version: dict | None = None) -> Winner:
    """Compare, choose by log-loss among the deployable, refit on the whole table with the method chosen on held-out days."""
    scores = compare(table, candidates, n_splits)
    best = select_best(scores).first()["name"]
    found = next(c for c in candidates if c.name == best)
    model = fit_candidate(found, table, "auto")
    method = model.method if isinstance(model, Calibrated) else None
    by_name = {r["name"]: {k: r[k] for k in ("log_loss", "brier", "accuracy", "deployable")} for r in scores.collect()}
    metadata = {"created_at": datetime.now(timezone.utc).isoformat(), "random_seed": SETTINGS.random_seed, "cv_splits": n_splits, "data_version": data_version, "selected_model": best, "calibration_method": method, "feature_columns": list(FEATURE_COLUMNS), "models": by_name, "library_versions": {p: version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}}
    return Winner(best, model, method, metadata)


def save(winner: Winner, path: str, table: DataFrame) -> None:
    """Write the winner's model and its metadata as JSON under path."""
    spark = table.sparkSession
    calibrated = isinstance(winner.model, Calibrated)
    base = winner.model.base if calibrated else winner.model
    save_model(base, f"{path}/base", spark)
    curves = []
    if calibrated:
        for k, curve in enumerate(winner.model.curves):
            if winner.method == "isotonic":
                curve.write().overwrite().save(f"{path}/curve{k}")
            curves.append([curve.slope, curve.intercept] if winner.method == "sigmoid" else None)
    spark.createDataFrame([(json.dumps(winner.metadata | {"curves": curves}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str, table: DataFrame) -> Winner:
    """The saved winner; raises if it was fitted on other features than this package makes."""
    from pyspark.ml.regression import IsotonicRegressionModel

    from .calibration import Sigmoid

    spark = table.sparkSession
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    check_features(metadata["feature_columns"])
    curves, method = metadata.pop("curves"), metadata["calibration_method"]
    model = load_model(f"{path}/base", spark)
    if curves:
        own = tuple(Sigmoid(*c) if method == "sigmoid" else IsotonicRegressionModel.load(f"{path}/curve{k}") for k, c in enumerate(curves))
        model = Calibrated(model, method, own)
    return Winner(metadata["selected_model"], model, method, metadata)


def predict_fixtures(matches: DataFrame, fixtures: DataFrame, cutoff: str, winner: Winner) -> DataFrame:
    """fixtures (league, date, home, away), any number, with probabilities as of the cutoff."""
    check_features(winner.metadata["feature_columns"])
    return winner.model.transform(fixture_features(matches, fixtures, cutoff)).select("league", "date", "home", "away", "p_home", "p_draw", "p_away")
