"""Queries on outcome models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bakeoff as contest
from ..operators import calibration, folds, goals, models
from ..operators.features import feature_table, fixture_features
from ..schema import FEATURE_COLUMNS, KEY
from ..sources.shared import materialised
from ..sources.warehouse import matches, stored_matches
from .base import CUTOFF, KEYS, Book, number, rounded, sql
from .features import ELO_CTES, FORM_CTES, H2H_CTES, SEASON_CTES, STRENGTH_CTES, fixtures_of

BOOK = Book()
_P = ("p_home", "p_draw", "p_away")
_ALL = (*ELO_CTES, *FORM_CTES, *H2H_CTES, *STRENGTH_CTES, *SEASON_CTES)
_TABLE = f"m JOIN elo USING ({KEYS}) JOIN form USING ({KEYS}) JOIN h2h USING ({KEYS}) JOIN strength USING ({KEYS}) JOIN season USING ({KEYS})"


@BOOK.add(sql("SELECT feature, round(median, 6) AS median FROM (SELECT " + ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0)::DOUBLE AS {c}" for c in FEATURE_COLUMNS) + f" FROM {_TABLE}) UNPIVOT (median FOR feature IN ({', '.join(FEATURE_COLUMNS)}))", *_ALL, recursive=True))
def feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = models.feature_medians(feature_table(stored_matches(spark, sf_dir)))
    return rounded(row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("median")) for c in FEATURE_COLUMNS]))))


@BOOK.add(
    sql(
        "SELECT feature, round(md, 6) AS median, round(mean, 4) AS mean, round(deviation, 4) AS deviation FROM (SELECT feature, any_value(md) AS md, avg(coalesce(x, md)) AS mean, stddev_pop(coalesce(x, md)) AS deviation FROM (SELECT feature, x, coalesce(quantile_cont(x, 0.5) OVER (PARTITION BY feature), 0)::DOUBLE AS md FROM (SELECT "
        + ", ".join(FEATURE_COLUMNS)
        + f" FROM {_TABLE}) UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(FEATURE_COLUMNS)}))) GROUP BY feature)",
        *_ALL,
        recursive=True,
    )
)
def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.feature_scaling(feature_table(stored_matches(spark, sf_dir)))
    return out.select("feature", F.round("median", 6).alias("median"), F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@BOOK.add(sql(f"SELECT {KEYS}, round(power(0.5::DOUBLE, date_diff('day', date, max(date) OVER (PARTITION BY league)) / 365.0::DOUBLE), 6) AS weight FROM m"))
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(goals.recency_weights(matches(spark, sf_dir), 365).select(*KEY, "weight"))


# --- goals model, with fixed strengths so that SQL can follow -------------------------------------------------------

_STRENGTHS_SQL = """st AS (SELECT league, team, (n % 5 - 2)::DOUBLE / 10 AS attack, (n % 3 - 1)::DOUBLE / 10 AS defense, length(league)::DOUBLE / 20 AS home_adv, -length(league)::DOUBLE / 100 AS rho
    FROM (SELECT DISTINCT league, home AS team, CAST(substr(home, 8) AS INT) AS n FROM m) WHERE n % 7 <> 0 AND league <> 'ASIA')"""
_PARAMS_SQL = "lp AS (SELECT league, any_value(home_adv) AS home_adv, any_value(rho) AS rho, avg(attack) AS avg_attack, avg(defense) AS avg_defense FROM st GROUP BY league), gp AS (SELECT avg(home_adv) AS home_adv, avg(rho) AS rho, avg(avg_attack) AS avg_attack, avg(avg_defense) AS avg_defense FROM lp)"
_RATES_SQL = """pairs AS (SELECT DISTINCT league, home, away FROM m),
rates AS (SELECT p.league, p.home, p.away, coalesce(lp.rho, gp.rho) AS rho,
       exp(coalesce(h.attack, lp.avg_attack, gp.avg_attack) + coalesce(a.defense, lp.avg_defense, gp.avg_defense) + coalesce(lp.home_adv, gp.home_adv)) AS lam,
       exp(coalesce(a.attack, lp.avg_attack, gp.avg_attack) + coalesce(h.defense, lp.avg_defense, gp.avg_defense)) AS mu
    FROM pairs p LEFT JOIN lp ON lp.league = p.league CROSS JOIN gp
    LEFT JOIN st h ON h.league = p.league AND h.team = p.home LEFT JOIN st a ON a.league = p.league AND a.team = p.away)"""
_GRID_SQL = """grid AS (SELECT r.*, i, j, greatest(0, exp(i * ln(lam) - lam - ln(factorial(i::INT)::DOUBLE)) * exp(j * ln(mu) - mu - ln(factorial(j::INT)::DOUBLE))
       * CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * rho WHEN i = 0 AND j = 1 THEN 1 + lam * rho WHEN i = 1 AND j = 0 THEN 1 + mu * rho WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END) AS p
    FROM rates r, range(11) x(i), range(11) y(j))"""


def _strengths(m: DataFrame) -> DataFrame:
    """Made-up strengths; teams whose number divides by 7 and one league are missing, so that fallbacks matter."""
    n = number("team")
    teams = m.select("league", F.col("home").alias("team")).distinct().where((n % 7 != 0) & (F.col("league") != "ASIA"))
    size = F.length("league").cast("double")
    return teams.select("league", "team", ((n % 5 - 2).cast("double") / F.lit(10.0)).alias("attack"), ((n % 3 - 1).cast("double") / F.lit(10.0)).alias("defense"), (size / F.lit(20.0)).alias("home_adv"), (-size / F.lit(100.0)).alias("rho"))


@BOOK.add(sql("SELECT league, home, away, round(lam, 6) AS lam, round(mu, 6) AS mu, round(rho, 6) AS rho FROM rates", _STRENGTHS_SQL, _PARAMS_SQL, _RATES_SQL))
def dc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return rounded(goals.with_strengths(m.select("league", "home", "away").distinct(), _strengths(m)))


@BOOK.add(sql("SELECT l.league, round(coalesce(lp.home_adv, gp.home_adv), 6) AS home_adv, round(coalesce(lp.rho, gp.rho), 6) AS rho, round(coalesce(lp.avg_attack, gp.avg_attack), 6) AS avg_attack, round(coalesce(lp.avg_defense, gp.avg_defense), 6) AS avg_defense FROM (SELECT DISTINCT league FROM m) l LEFT JOIN lp ON lp.league = l.league CROSS JOIN gp", _STRENGTHS_SQL, _PARAMS_SQL))
def dc_league_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    s = _strengths(m)
    names = ("home_adv", "rho", "avg_attack", "avg_defense")
    out = m.select("league").distinct().join(goals.league_params(s), "league", "left").crossJoin(F.broadcast(goals.global_params(s)))
    return rounded(out.select("league", *[F.coalesce(c, f"any_{c}").alias(c) for c in names]))


@BOOK.add(sql("SELECT league, home, away, round(sum(p) FILTER (WHERE i > j) / sum(p), 6) AS p_home, round(sum(p) FILTER (WHERE i = j) / sum(p), 6) AS p_draw, round(sum(p) FILTER (WHERE i < j) / sum(p), 6) AS p_away FROM grid GROUP BY ALL", _STRENGTHS_SQL, _PARAMS_SQL, _RATES_SQL, _GRID_SQL))
def dc_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return rounded(goals.predict_goals(m.select("league", "home", "away").distinct(), _strengths(m)))


@BOOK.add(sql("SELECT league, home, away, CAST(i AS INT) AS home_goals, CAST(j AS INT) AS away_goals, round(p, 6) AS p FROM grid", _STRENGTHS_SQL, _PARAMS_SQL, _RATES_SQL, _GRID_SQL))
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    rates = goals.with_strengths(m.select("league", "home", "away").distinct(), _strengths(m))
    return rounded(goals.score_matrix(rates).select("league", "home", "away", "home_goals", "away_goals", "p"))


@BOOK.add()
def dc_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(goals.fit_goals(matches(spark, sf_dir)), 4)


# --- fitted models: no SQL can follow ----------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, written once for the many passes of fitting."""
    return materialised(feature_table(stored_matches(spark, sf_dir)), "features")


def _last_fold(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = folds.with_groups(table)
    return split.where("fold_group < 6").drop("fold_group"), split.where("fold_group = 6").drop("fold_group")


@BOOK.add()
def logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fold's matches by a model of all earlier ones."""
    train, test = _last_fold(_table(spark, sf_dir))
    return models.Logistic().fit(train).transform(test).select(*KEY, "result", *_P)


@BOOK.add()
def gbt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _last_fold(_table(spark, sf_dir))
    return models.BoostedTrees().fit(train).transform(test).select(*KEY, "result", *_P)


@BOOK.add()
def calibrated_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _last_fold(_table(spark, sf_dir))
    return calibration.calibrate(models.Logistic(), train, "sigmoid").transform(test).select(*KEY, "result", *_P)


@BOOK.add()
def calibration_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calibration the last fold chooses on its own later days."""
    table = _table(spark, sf_dir)
    train, hold_out = _last_fold(table)
    method = calibration.select_method(models.Logistic().fit(train), hold_out)
    return hold_out.agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("rows"))


@BOOK.add()
def bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates under the forward-chaining folds of the settings."""
    return contest.compare(_table(spark, sf_dir))


@BOOK.add()
def predict_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures as of a cutoff by a calibrated model of what was played before it."""
    m = stored_matches(spark, sf_dir)
    table = materialised(feature_table(m.where(F.col("date") < F.lit(CUTOFF).cast("date"))), "features")
    model = contest.fit_candidate(contest.Candidate(models.Logistic(), calibrated=True), table)
    return model.transform(fixture_features(m, fixtures_of(m), CUTOFF)).select(*KEY, *_P)
