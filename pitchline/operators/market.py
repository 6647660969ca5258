"""Model against market: edge, expected value, flat-stake back-test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import expected_value, implied
from ..functions.outcomes import argmax, encode
from ..schema import KEY, ODDS, PROBABILITIES


def with_edge(df: DataFrame) -> DataFrame:
    """df with edge_home, edge_draw, edge_away: the model's probability less the implied one."""
    return df.withColumns({f"edge_{p[2:]}": F.col(p) - q for p, q in zip(PROBABILITIES, implied())})


def with_ev(df: DataFrame) -> DataFrame:
    """df with ev_home, ev_draw, ev_away."""
    return df.withColumns({f"ev_{p[2:]}": expected_value(F.col(p), F.col(o)) for p, o in zip(PROBABILITIES, ODDS)})


def with_pick(df: DataFrame) -> DataFrame:
    """df with the outcome of largest expected value, its value and odds, and the profit of a stake of 1 if it was bet on."""
    ev = [expected_value(F.col(p), F.col(o)) for p, o in zip(PROBABILITIES, ODDS)]
    out = df.withColumns({"pick": argmax(*ev), "pick_ev": F.greatest(*ev)})
    return out.withColumns({"pick_odds": F.get(F.array(*[F.col(o) for o in ODDS]), F.col("pick")), "won": F.col("pick") == encode(F.col("result"))})


def profit(threshold: Column | float = 0.0) -> Column:
    """Profit of a picked row: 0 without a bet, odds - 1 if won, else -1."""
    bet = F.col("pick_ev") > threshold
    return F.when(~bet | bet.isNull(), F.lit(0.0)).when(F.col("won"), F.col("pick_odds") - F.lit(1.0)).otherwise(F.lit(-1.0))


def _summary(stake: float) -> list[Column]:
    """The back-test's measures over picked rows with a column threshold."""
    bet = F.col("pick_ev") > F.col("threshold")
    win = bet & F.col("won")
    bets = F.count_if(bet)
    back = F.lit(stake) * F.coalesce(F.sum(F.when(win, F.col("pick_odds"))), F.lit(0.0))
    staked = F.lit(stake) * bets.cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [F.count(F.lit(1)).alias("n_matches"), bets.alias("n_bets"), F.count_if(win).alias("n_wins"), staked.alias("total_staked"), back.alias("total_return"), (back - staked).alias("pnl"), share(back - staked, staked).alias("roi"), share(F.count_if(win).cast("double"), bets).alias("win_rate")]


def backtest(df: DataFrame, threshold: float = 0.0, stake: float = 1.0) -> DataFrame:
    """One row: matches, bets, wins, staked, return, profit, return on investment, win rate.

    A match is bet on if its largest expected value is strictly above the threshold. Rates are 0 without bets.
    """
    return with_pick(df).withColumn("threshold", F.lit(float(threshold))).agg(*_summary(stake))


def backtest_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.02, 0.05), stake: float = 1.0) -> DataFrame:
    """The back-test at several thresholds in one pass over the rows."""
    each = with_pick(df).select("pick_ev", "won", "pick_odds", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return each.groupBy("threshold").agg(*_summary(stake))


def cumulative_pnl(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Day by day the profit so far: date, profit, total.

    Profits are summed by day first, so the running sum, which one task makes, covers a calendar and not matches.
    """
    daily = with_pick(df).groupBy("date").agg(F.sum(profit(threshold)).alias("profit"))
    return daily.withColumn("total", F.sum("profit").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def running_pnl(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Match by match the profit so far, in order of the natural key: offsets by day come from cumulative_pnl."""
    rows = with_pick(df).select(*KEY, profit(threshold).alias("profit"))
    days = cumulative_pnl(df, threshold).select("date", (F.col("total") - F.col("profit")).alias("__before"))
    within = F.sum("profit").over(Window.partitionBy("date").orderBy("league", "home", "away").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(days, "date").select(*KEY, "profit", (F.col("__before") + F.col("within")).alias("total"))


def histogram(df: DataFrame, column: str, n_bins: int = 60) -> DataFrame:
    """bin (from 0), n over equally wide bins between the least and the largest value; the largest falls in the last."""
    span = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    share = (F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    place = F.least(F.lit(n_bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * n_bins)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
