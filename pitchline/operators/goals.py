"""A goals model: two Poisson rates with a correction of low scores, one fit for each league.

Only the counts of each score of each pairing enter the likelihood, so matches are summed to those cells on Spark
first; a league's fit then sees at most teams * teams * scores rows, however many matches there were.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS

RHO_BOUND = 0.99
LEAST_TAU = 1e-10
FIRST_ADVANTAGE = 0.1
_FIT = "league string, team string, attack double, defense double, home_adv double, rho double"


def recency_weights(matches: DataFrame, half_life_days: int | None) -> DataFrame:
    """matches with a weight that halves every half_life_days before the league's last match; 1 without a half-life."""
    if half_life_days is None:
        return matches.withColumn("weight", F.lit(1.0))
    last = matches.groupBy(F.col("league").alias("__league")).agg(F.max("date").alias("__last"))
    aged = matches.join(F.broadcast(last), F.col("league") == F.col("__league"))
    return aged.withColumn("weight", F.pow(F.lit(0.5), F.datediff("__last", "date") / F.lit(float(half_life_days)))).drop("__league", "__last")


class Likelihood:
    """Weighted log-likelihood of score counts and its gradient; parameters are attacks, defences, advantage, atanh(rho / bound)."""

    def __init__(self, home: np.ndarray, away: np.ndarray, scored: np.ndarray, conceded: np.ndarray, weight: np.ndarray, n_teams: int):
        self.home, self.away, self.x, self.y, self.w, self.n = home, away, scored, conceded, weight, n_teams
        self.low = [np.flatnonzero((scored == i) & (conceded == j)) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]

    def __call__(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood, up to a constant, and its gradient."""
        n, w = self.n, self.w
        attack, defense, advantage, rho = v[:n], v[n : 2 * n], v[2 * n], RHO_BOUND * np.tanh(v[2 * n + 1])
        log_l, log_m = attack[self.home] + defense[self.away] + advantage, attack[self.away] + defense[self.home]
        lam, mu = np.exp(log_l), np.exp(log_m)
        value = float((w * (self.x * log_l - lam + self.y * log_m - mu)).sum())
        g_l, g_m, g_rho = w * (self.x - lam), w * (self.y - mu), 0.0
        for k, at in enumerate(self.low):
            l, m = lam[at], mu[at]
            # Slopes of tau along log lambda, log mu and rho.
            tau, by_l, by_m, by_rho = ((1 - l * m * rho, -l * m * rho, -l * m * rho, -l * m), (1 + l * rho, l * rho, 0 * l, l), (1 + m * rho, 0 * m, m * rho, m), (1 - rho + 0 * l, 0 * l, 0 * l, -1 + 0 * l))[k]
            value += float((w[at] * np.log(np.maximum(tau, LEAST_TAU))).sum())
            share = np.where(tau > LEAST_TAU, w[at] / np.maximum(tau, LEAST_TAU), 0.0)
            g_l[at] += share * by_l
            g_m[at] += share * by_m
            g_rho += float((share * by_rho).sum())
        slope = np.zeros_like(v)
        slope[:n] = np.bincount(self.home, g_l, n) + np.bincount(self.away, g_m, n)
        slope[n : 2 * n] = np.bincount(self.away, g_l, n) + np.bincount(self.home, g_m, n)
        slope[2 * n], slope[2 * n + 1] = g_l.sum(), g_rho * RHO_BOUND * (1 - np.tanh(v[2 * n + 1]) ** 2)
        return -value, -slope


def minimise(f, start: np.ndarray, steps: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Quasi-Newton descent (BFGS with halving steps)."""
    v, (value, slope), h = start, f(start), np.eye(len(start))
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance * max(1.0, abs(value)):
            break
        way = -h @ slope
        if way @ slope >= 0:
            h, way = np.eye(len(v)), -slope
        size = min(1.0, 2.0 / max(np.abs(way).max(), 1e-300))
        while size > 1e-14:
            next_value, next_slope = f(v + size * way)
            if np.isfinite(next_value) and next_value <= value + 1e-4 * size * (way @ slope):
                break
            size /= 2
        else:
            break
        s, y = size * way, next_slope - slope
        v, value, slope = v + s, next_value, next_slope
        if (sy := s @ y) > 1e-12:
            hy = h @ y
            h = h + np.outer(s, s) * (sy + y @ hy) / sy**2 - (np.outer(hy, s) + np.outer(s, hy)) / sy
    return v


def _fit_league(cells: pd.DataFrame) -> pd.DataFrame:
    teams = sorted(set(cells["home"]) | set(cells["away"]))
    place = {t: i for i, t in enumerate(teams)}
    cells = cells.sort_values(["home", "away", "ft_home_goals", "ft_away_goals"])
    likelihood = Likelihood(cells["home"].map(place).to_numpy(), cells["away"].map(place).to_numpy(), cells["ft_home_goals"].to_numpy(float), cells["ft_away_goals"].to_numpy(float), cells["weight"].to_numpy(), len(teams))
    start = np.zeros(2 * len(teams) + 2)
    start[-2] = FIRST_ADVANTAGE
    v = minimise(likelihood, start)
    n, shift = len(teams), v[: len(teams)].mean()
    return pd.DataFrame({"league": cells["league"].iloc[0], "team": teams, "attack": v[:n] - shift, "defense": v[n : 2 * n] + shift, "home_adv": v[2 * n], "rho": RHO_BOUND * np.tanh(v[2 * n + 1])})


def fit_goals(matches: DataFrame, half_life_days: int | None = SETTINGS.dc_half_life_days) -> DataFrame:
    """Strengths: league, team, attack (mean 0 in each league), defense, and the league's home_adv and rho."""
    weighted = recency_weights(matches, half_life_days)
    cells = weighted.groupBy("league", "home", "away", "ft_home_goals", "ft_away_goals").agg(F.sum("weight").alias("weight"))
    return cells.groupBy("league").applyInPandas(_fit_league, _FIT)


def league_params(strengths: DataFrame) -> DataFrame:
    """league, home_adv, rho, avg_attack, avg_defense."""
    return strengths.groupBy("league").agg(F.first("home_adv").alias("home_adv"), F.first("rho").alias("rho"), F.avg("attack").alias("avg_attack"), F.avg("defense").alias("avg_defense"))


def global_params(strengths: DataFrame) -> DataFrame:
    """One row: plain means over leagues of their parameters, for leagues that weren't fitted."""
    names = ("home_adv", "rho", "avg_attack", "avg_defense")
    means = league_params(strengths).agg(*[F.avg(c).alias(f"any_{c}") for c in names])
    default = {"any_home_adv": FIRST_ADVANTAGE, "any_rho": 0.0, "any_avg_attack": 0.0, "any_avg_defense": 0.0}
    return means.na.fill(default)


def with_strengths(fixtures: DataFrame, strengths: DataFrame) -> DataFrame:
    """fixtures with rho and the rates lam and mu; unseen teams are average, unseen leagues the mean of all."""
    params = league_params(strengths).withColumnRenamed("league", "__league")
    out = fixtures.join(params, F.col("league") == F.col("__league"), "left").crossJoin(F.broadcast(global_params(strengths)))
    for side in ("home", "away"):
        own = strengths.select(F.col("league").alias("__l"), F.col("team").alias("__t"), F.col("attack").alias(f"{side}_attack"), F.col("defense").alias(f"{side}_defense"))
        out = out.join(own, (F.col("league") == F.col("__l")) & (F.col(side) == F.col("__t")), "left").drop("__l", "__t")
    either = lambda *names: F.coalesce(*[F.col(n) for n in names])
    attack = {s: either(f"{s}_attack", "avg_attack", "any_avg_attack") for s in ("home", "away")}
    defense = {s: either(f"{s}_defense", "avg_defense", "any_avg_defense") for s in ("home", "away")}
    lam = F.exp(attack["home"] + defense["away"] + either("home_adv", "any_home_adv"))
    mu = F.exp(attack["away"] + defense["home"])
    return out.select(*[fixtures[c] for c in fixtures.columns], lam.alias("lam"), mu.alias("mu"), either("rho", "any_rho").alias("rho"))


def _pmf(rate: Column, most: int) -> Column:
    """Poisson masses of 0 to `most` goals."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(k * F.ln(rate) - rate - F.ln(F.factorial(k).cast("double"))))


def predict_goals(fixtures: DataFrame, strengths: DataFrame, max_goals: int = SETTINGS.dc_max_goals) -> DataFrame:
    """fixtures with p_home, p_draw, p_away from the corrected scores up to max_goals (at most 20) a side.

    Rates are capped at max_goals, corrected cells at 0 from below.
    """
    if not 1 <= max_goals <= 20:
        raise ValueError("max_goals must be from 1 to 20")
    cap = F.lit(float(max_goals))
    rated = with_strengths(fixtures, strengths).withColumns({"lam": F.least("lam", cap), "mu": F.least("mu", cap)})
    rated = rated.withColumns({"__h": _pmf(F.col("lam"), max_goals), "__a": _pmf(F.col("mu"), max_goals)})
    h, a = lambda k: F.get("__h", k), lambda k: F.get("__a", k)
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    ahead = lambda x, y: total(F.transform(F.sequence(F.lit(1), F.lit(max_goals)), lambda k: F.get(x, k) * total(F.slice(y, F.lit(1), k))))
    lam, mu, rho = F.col("lam"), F.col("mu"), F.col("rho")
    one = F.lit(1.0)

    def change(i: int, j: int, tau: Column) -> Column:
        """What the correction adds to a cell."""
        cell = h(F.lit(i)) * a(F.lit(j))
        return F.greatest(cell * tau, F.lit(0.0)) - cell

    level = total(F.zip_with("__h", "__a", lambda x, y: x * y)) + change(0, 0, one - lam * mu * rho) + change(1, 1, one - rho)
    sums = rated.withColumns({"__home": ahead(F.col("__h"), F.col("__a")) + change(1, 0, one + mu * rho), "__draw": level, "__away": ahead(F.col("__a"), F.col("__h")) + change(0, 1, one + lam * rho)})
    whole = F.col("__home") + F.col("__draw") + F.col("__away")
    return sums.select(*fixtures.columns, *[(F.col(f"__{c}") / whole).alias(f"p_{c}") for c in ("home", "draw", "away")])


def score_matrix(rates: DataFrame, max_goals: int = SETTINGS.dc_max_goals) -> DataFrame:
    """rates (with lam, mu, rho) once for each score: home_goals, away_goals, p, corrected and not normalised."""
    side = lambda name: F.posexplode(_pmf(F.col(name), max_goals))
    grid = rates.select("*", side("lam").alias("home_goals", "__h")).select("*", side("mu").alias("away_goals", "__a"))
    lam, mu, rho = F.col("lam"), F.col("mu"), F.col("rho")
    is_score = lambda i, j: (F.col("home_goals") == i) & (F.col("away_goals") == j)
    tau = F.when(is_score(0, 0), 1 - lam * mu * rho).when(is_score(0, 1), 1 + lam * rho).when(is_score(1, 0), 1 + mu * rho).when(is_score(1, 1), 1 - rho).otherwise(F.lit(1.0))
    return grid.withColumn("p", F.greatest(F.col("__h") * F.col("__a") * tau, F.lit(0.0))).drop("__h", "__a")
