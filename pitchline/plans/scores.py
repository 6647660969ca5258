"""Queries on folds, scores and the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odds import implied, overround as margin, usable
from ..functions.outcomes import argmax, verbal_summary as wording
from ..operators import folds, market, scoring
from ..schema import KEY
from ..sources.warehouse import matches
from .base import FORECAST, KEYS, USABLE_SQL, Book, rounded, sql, with_forecast

BOOK = Book()
_P = ("p_home", "p_draw", "p_away")
_F = f"c AS (SELECT *, {FORECAST[0]}::DOUBLE AS p_home, {FORECAST[1]}::DOUBLE AS p_draw, {FORECAST[2]}::DOUBLE AS p_away FROM m WHERE odds_home > 1 AND odds_draw > 1 AND odds_away > 1)"
_EV = "ev AS (SELECT *, [p_home * odds_home - 1, p_draw * odds_draw - 1, p_away * odds_away - 1] AS e, list_position(['H', 'D', 'A'], result) AS y FROM c)"
_PICK = "pick AS (SELECT *, list_position(e, list_max(e)) AS k, list_max(e) AS best, [odds_home, odds_draw, odds_away][list_position(e, list_max(e))] AS price FROM ev)"
_SCORED = "s AS (SELECT *, list_position(['H', 'D', 'A'], result) AS y, [p_home, p_draw, p_away] AS p FROM u)"
_LOSS = "-ln(least(greatest(p[y], 1e-15), 1.0::DOUBLE))"
_BRIER = "power(p[1] - (y = 1)::INT, 2) + power(p[2] - (y = 2)::INT, 2) + power(p[3] - (y = 3)::INT, 2)"
_HIT = "(list_position(p, list_max(p)) = y)::INT"


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where(usable())


def _implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(spark, sf_dir).withColumns(dict(zip(_P, implied())))


def _constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_forecast(_usable(spark, sf_dir))


@BOOK.add(sql(f"SELECT {KEYS}, " + ", ".join(f"round((1 / odds_{c}) / (1 / odds_home + 1 / odds_draw + 1 / odds_away), 6) AS p_{c}" for c in ("home", "draw", "away")) + " FROM m"))
def implied_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matches(spark, sf_dir).select(*KEY, *[p.alias(c) for c, p in zip(_P, implied())]))


@BOOK.add(sql(f"SELECT {KEYS}, " + ", ".join(f"round({f}::DOUBLE - p_{c}, 6) AS edge_{c}" for c, f in zip(("home", "draw", "away"), FORECAST)) + " FROM u", USABLE_SQL))
def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.with_edge(_constant(spark, sf_dir)).select(*KEY, "edge_home", "edge_draw", "edge_away"))


@BOOK.add(sql(f"SELECT {KEYS}, round(e[1], 6) AS ev_home, round(e[2], 6) AS ev_draw, round(e[3], 6) AS ev_away FROM ev", _F, _EV))
def expected_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.with_ev(_constant(spark, sf_dir)).select(*KEY, "ev_home", "ev_draw", "ev_away"))


@BOOK.add(sql(f"SELECT {KEYS}, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pick FROM s", USABLE_SQL, _SCORED))
def argmax_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implied(spark, sf_dir).select(*KEY, argmax(*[F.col(c) for c in _P]).alias("pick"))


@BOOK.add(sql(f"SELECT {KEYS}, odds_home, odds_draw, odds_away FROM m WHERE odds_home > 1 AND odds_draw > 1 AND odds_away > 1"))
def usable_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(spark, sf_dir).select(*KEY, "odds_home", "odds_draw", "odds_away")


@BOOK.add(sql(f"SELECT {KEYS}, round_even(v - 1, 3) AS overround FROM u", USABLE_SQL))
def overround(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(spark, sf_dir).select(*KEY, F.bround(margin(), 3).alias("overround"))


@BOOK.add(sql(f"SELECT {KEYS}, round(CASE WHEN best > 0 THEN CASE WHEN k = y THEN price - 1 ELSE -1 END ELSE 0 END, 6) AS profit FROM pick", _F, _EV, _PICK))
def bet_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.with_pick(_constant(spark, sf_dir)).select(*KEY, market.profit().alias("profit")))


@BOOK.add(sql(f"""SELECT {KEYS}, CASE WHEN top - second < 0.1::DOUBLE THEN 'Too close to call — no clear favourite (top outcome only ' || pct || '%).'
    ELSE 'Model favours ' || ['a home win', 'a draw', 'an away win'][list_position(p, top)] || ' at ' || pct || '%.' END AS summary
    FROM (SELECT *, list_max(p) AS top, list_reverse_sort(p)[2] AS second, CAST(CAST(round_even(list_max(p) * 100, 0) AS INT) AS VARCHAR) AS pct FROM s)""", USABLE_SQL, _SCORED))
def verbal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implied(spark, sf_dir).select(*KEY, wording(*[F.col(c) for c in _P]).alias("summary"))


@BOOK.add(sql(f"SELECT {KEYS}, m.result, round(u.p_home, 6) AS p_home, round(u.p_draw, 6) AS p_draw, round(u.p_away, 6) AS p_away, m.odds_away FROM m JOIN u USING ({KEYS})", USABLE_SQL))
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, results and odds brought together by the natural key."""
    m = matches(spark, sf_dir)
    predictions = _implied(spark, sf_dir).select(*KEY, *_P)
    return rounded(m.join(predictions, list(KEY)).select(*KEY, "result", *_P, "odds_away"))


# --- scores -------------------------------------------------------------------------------------------------------------


@BOOK.add(sql(f"SELECT round(avg({_LOSS}), 6) AS log_loss FROM s", USABLE_SQL, _SCORED))
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score_summary(_implied(spark, sf_dir)).select("log_loss"))


@BOOK.add(sql(f"SELECT round(avg({_BRIER}), 6) AS brier FROM s", USABLE_SQL, _SCORED))
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score_summary(_implied(spark, sf_dir)).select("brier"))


@BOOK.add(sql(f"SELECT round(avg({_HIT}), 6) AS accuracy FROM s", USABLE_SQL, _SCORED))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score_summary(_implied(spark, sf_dir)).select("accuracy"))


_SUMMARY = f"round(avg({_LOSS}), 6) AS log_loss, round(avg({_BRIER}), 6) AS brier, round(avg({_HIT}), 6) AS accuracy, count(*) AS n_scored"


@BOOK.add(sql(f"SELECT {_SUMMARY} FROM s", USABLE_SQL, _SCORED))
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose odds are missing count in no score."""
    return rounded(scoring.score_summary(_implied(spark, sf_dir)))


@BOOK.add(sql(f"SELECT league, {_SUMMARY} FROM s GROUP BY league", USABLE_SQL, _SCORED))
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's own scores by league."""
    return rounded(scoring.score_summary(_implied(spark, sf_dir), "league"))


_EDGES = [i / 10 for i in range(11)]
_EDGES[3], _EDGES[6], _EDGES[7] = 0.30000000000000004, 0.6000000000000001, 0.7000000000000001


@BOOK.add(sql(f"""SELECT b AS bin, round(e[b + 1], 6) AS low, round(e[b + 2], 6) AS high, count(x) AS n, round(avg(x), 6) AS mean_predicted, round(avg(hit), 6) AS observed
    FROM (SELECT CAST(range AS INT) AS b, [{', '.join(f'{x!r}::DOUBLE' for x in _EDGES)}] AS e FROM range(10))
    LEFT JOIN (SELECT x, hit, CAST(least(9, len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in _EDGES)}], lambda v: v <= x)) - 1) AS INT) AS bx
               FROM (SELECT unnest(p) AS x, unnest([(y = 1)::INT, (y = 2)::INT, (y = 3)::INT]) AS hit FROM s)) ON bx = b GROUP BY ALL""", USABLE_SQL, _SCORED))
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.reliability_curve(_implied(spark, sf_dir)))


# --- market -----------------------------------------------------------------------------------------------------------


def _backtest_sql(threshold: str) -> str:
    win = f"best > {threshold} AND k = y"
    back = f"coalesce(sum(price) FILTER (WHERE {win}), 0)"
    n = f"count(*) FILTER (WHERE best > {threshold})"
    return f"count(*) AS n_matches, {n} AS n_bets, count(*) FILTER (WHERE {win}) AS n_wins, {n}::DOUBLE AS total_staked, round({back}, 6) AS total_return, round({back} - {n}, 6) AS pnl, round(CASE WHEN {n} > 0 THEN ({back} - {n}) / {n} ELSE 0 END, 6) AS roi, round(CASE WHEN {n} > 0 THEN count(*) FILTER (WHERE {win}) / {n} ELSE 0 END, 6) AS win_rate"


@BOOK.add(sql(f"SELECT {_backtest_sql('0')} FROM pick", _F, _EV, _PICK))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.backtest(_constant(spark, sf_dir)))


@BOOK.add(sql(f"SELECT threshold, {_backtest_sql('threshold')} FROM pick, (SELECT unnest([0::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS threshold) GROUP BY threshold", _F, _EV, _PICK))
def backtest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.backtest_sweep(_constant(spark, sf_dir)))


_PROFIT = "CASE WHEN best > 0 THEN CASE WHEN k = y THEN price - 1 ELSE -1 END ELSE 0 END"


@BOOK.add(sql(f"SELECT {KEYS}, round({_PROFIT}, 6) AS profit, round(sum({_PROFIT}) OVER (ORDER BY date, league, home, away ROWS UNBOUNDED PRECEDING), 4) + 0 AS total FROM pick", _F, _EV, _PICK))
def cumulative_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.running_pnl(_constant(spark, sf_dir))
    return out.select(*KEY, F.round("profit", 6).alias("profit"), (F.round("total", 4) + F.lit(0.0)).alias("total"))


@BOOK.add(sql("""SELECT CAST(least(59, floor((x - lo) / (hi - lo) * 60)) AS INT) AS bin, count(*) AS n
    FROM (SELECT 0.45::DOUBLE - p_home AS x, min(0.45::DOUBLE - p_home) OVER () AS lo, max(0.45::DOUBLE - p_home) OVER () AS hi FROM u) GROUP BY bin""", USABLE_SQL))
def edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.histogram(market.with_edge(_constant(spark, sf_dir)), "edge_home")


# --- folds ------------------------------------------------------------------------------------------------------------

_GROUPS = "g AS (SELECT date, CAST(ntile(6) OVER (ORDER BY date) AS INT) AS fold_group FROM (SELECT DISTINCT date FROM m))"


@BOOK.add(sql(f"SELECT {KEYS}, fold_group FROM m JOIN g USING (date)", _GROUPS))
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.with_groups(matches(spark, sf_dir)).select(*KEY, "fold_group")


@BOOK.add(sql("SELECT CAST(fold AS INT) AS fold, count(*) FILTER (WHERE fold_group <= fold) AS n_train, count(*) FILTER (WHERE fold_group = fold + 1) AS n_test FROM m JOIN g USING (date), range(1, 6) r(fold) GROUP BY fold", _GROUPS))
def cv_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(matches(spark, sf_dir))


@BOOK.add(sql("SELECT CAST(fold AS INT) AS fold, CASE WHEN fold_group = fold + 1 THEN 'test' ELSE 'train' END AS part, league, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM m JOIN g USING (date), range(1, 6) r(fold) WHERE fold_group <= fold + 1 GROUP BY ALL", _GROUPS))
def cv_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = folds.train_test(matches(spark, sf_dir))
    return split.groupBy("fold", "part", "league").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@BOOK.add(sql("SELECT CAST(fold AS INT) AS fold, date FROM g, range(1, 6) r(fold) WHERE fold_group <= fold INTERSECT SELECT CAST(fold AS INT), date FROM g, range(1, 6) r(fold) WHERE fold_group = fold + 1", _GROUPS))
def fold_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows: no fold tests on a day that it trains on."""
    return folds.fold_overlap(matches(spark, sf_dir))


@BOOK.add(sql(f"SELECT round(avg(l), 6) AS log_loss, round(avg(b), 6) AS brier, round(avg(h), 6) AS accuracy FROM (SELECT fold_group, avg({_LOSS}) AS l, avg({_BRIER}) AS b, avg({_HIT}) AS h FROM s JOIN (SELECT date, ntile(6) OVER (ORDER BY date) AS fold_group FROM (SELECT DISTINCT date FROM u)) USING (date) WHERE fold_group > 1 GROUP BY fold_group)", USABLE_SQL, _SCORED))
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's scores as the plain mean of five folds' means."""
    split = folds.with_groups(_implied(spark, sf_dir)).where("fold_group > 1")
    return rounded(scoring.macro_scores(split, "fold_group"))


_CANDIDATES_SQL = f"""cand AS (SELECT 'market' AS name, 0 AS place, FALSE AS deployable, avg({_LOSS}) AS log_loss, avg({_BRIER}) AS brier, avg({_HIT}) AS accuracy FROM s
    UNION ALL SELECT 'constant', 1, TRUE, avg({_LOSS}), avg({_BRIER}), avg({_HIT}) FROM (SELECT * REPLACE ([0.45::DOUBLE, 0.27::DOUBLE, 0.28::DOUBLE] AS p) FROM s)
    UNION ALL SELECT 'even', 2, TRUE, avg({_LOSS}), avg({_BRIER}), avg({_HIT}) FROM (SELECT * REPLACE ([0.25::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE] AS p) FROM s))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the market and of two constant forecasts."""
    rows = _implied(spark, sf_dir)
    constant = lambda p: rows.withColumns({c: F.lit(v) for c, v in zip(_P, p)})
    out = None
    for place, (name, deployable, df) in enumerate((("market", False, rows), ("constant", True, constant(FORECAST)), ("even", True, constant((0.25, 0.5, 0.25))))):
        own = scoring.score_summary(df).select(F.lit(name).alias("name"), F.lit(place).alias("place"), F.lit(deployable).alias("deployable"), "log_loss", "brier", "accuracy")
        out = own if out is None else out.unionByName(own)
    return out


@BOOK.add(sql("SELECT name, place, deployable, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy FROM cand ORDER BY log_loss, place", USABLE_SQL, _SCORED, _CANDIDATES_SQL))
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.leaderboard(_candidates(spark, sf_dir)))


@BOOK.add(sql("SELECT name, place, deployable, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy FROM cand WHERE deployable ORDER BY log_loss, place LIMIT 1", USABLE_SQL, _SCORED, _CANDIDATES_SQL))
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.select_best(_candidates(spark, sf_dir)))


@BOOK.add(sql("""SELECT distinct_dates, rarest, least(5, distinct_dates - 1, rarest) AS n_splits,
    (SELECT min(least(h, d, a)) > 0 FROM (SELECT fold_group, count(*) FILTER (WHERE result = 'H') AS h, count(*) FILTER (WHERE result = 'D') AS d, count(*) FILTER (WHERE result = 'A') AS a FROM m JOIN g USING (date) WHERE fold_group IN (1, 6) GROUP BY fold_group)) AS usable
    FROM (SELECT count(DISTINCT date) AS distinct_dates, least(count(*) FILTER (WHERE result = 'H'), count(*) FILTER (WHERE result = 'D'), count(*) FILTER (WHERE result = 'A')) AS rarest FROM m)""", _GROUPS))
def calibration_split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.guard(matches(spark, sf_dir))
