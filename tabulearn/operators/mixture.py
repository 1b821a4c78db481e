"""Binomial and Gaussian mixtures by expectation maximisation.

Rows with equal values have equal responsibilities, so the rounds run on the
distinct values with their counts; each round is one aggregate of a few sums.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import required
from tabulearn.functions.tables import collapse, worth_collapsing
from tabulearn.session import kept


@dataclass
class CoinModel:
    theta_a: float
    theta_b: float
    iterations: int
    converged: bool
    history: list

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "step int, theta_a double, theta_b double")

    def responsibilities(self, trials: DataFrame, heads: str, tosses: str) -> DataFrame:
        pa = coin_share(F.col(heads), F.col(tosses), self.theta_a, self.theta_b)
        return trials.withColumn("share_a", pa).withColumn("share_b", F.lit(1.0) - F.col("share_a"))


def coin_share(h, n, a, b):
    """Posterior of coin a at equal priors; the binomial coefficients cancel."""
    def log_like(t):
        t = min(max(t, 1e-300), 1.0 - 1e-16)
        return h * F.lit(math.log(t)) + (n - h) * F.lit(math.log1p(-t))

    return F.lit(1.0) / (F.lit(1.0) + F.exp(log_like(b) - log_like(a)))


def coin_trials(tosses: DataFrame, trial: str, outcome: str) -> DataFrame:
    """Raw 0/1 tosses to (trial, heads, n)."""
    return tosses.groupBy(trial).agg(F.sum(outcome).cast("long").alias("heads"), F.count("*").alias("n"))


def coin_em_fit(trials: DataFrame, heads: str, tosses: str, theta_a: float, theta_b: float, eps: float = 1e-3,
                max_iter: int = 1000) -> CoinModel:
    """Two coins with equal priors from (heads, tosses) per trial."""
    if theta_a == theta_b:
        raise ValueError("equal starts are a fixed point; give two different values")
    table = kept(trials.groupBy(F.col(heads).cast("double").alias("h"), F.col(tosses).cast("double").alias("n")).agg(
        F.count("*").alias("c")))
    history, done, step = [(0, theta_a, theta_b)], False, 0
    for step in range(1, max_iter + 1):
        p = coin_share(F.col("h"), F.col("n"), theta_a, theta_b)
        row = table.select("h", "n", "c", p.alias("p")).agg(
            F.sum(F.col("c") * F.col("p") * F.col("h")).alias("ah"), F.sum(F.col("c") * F.col("p") * F.col("n")).alias("an"),
            F.sum(F.col("c") * (1.0 - F.col("p")) * F.col("h")).alias("bh"),
            F.sum(F.col("c") * (1.0 - F.col("p")) * F.col("n")).alias("bn")).first()
        if row["an"] is None:
            raise ValueError("no rows to learn from")
        new_a = row["ah"] / row["an"] if row["an"] else theta_a
        new_b = row["bh"] / row["bn"] if row["bn"] else theta_b
        moved = math.hypot(new_a - theta_a, new_b - theta_b)
        theta_a, theta_b = new_a, new_b
        history.append((step, theta_a, theta_b))
        if moved < eps:
            done = True
            break
    table.unpersist()
    return CoinModel(theta_a, theta_b, step, done, history)


@dataclass
class MixtureModel:
    alpha: list
    mu: list
    var: list
    iterations: int = 0
    converged: bool = False

    def table(self, spark) -> DataFrame:
        rows = [(i, a, m, v) for i, (a, m, v) in enumerate(zip(self.alpha, self.mu, self.var))]
        return spark.createDataFrame(rows, "component int, alpha double, mu double, sigma_square double")

    def shares(self, x):
        """Posterior of each component, in order."""
        dens = component_densities(x, self.alpha, self.mu, self.var)
        whole = sum(dens[1:], dens[0])
        return [d / whole for d in dens]

    def responsibilities(self, df: DataFrame, x: str, keep: list) -> DataFrame:
        shares = F.array(*self.shares(required(x)))
        return df.select(*keep, F.posexplode(shares).alias("component", "responsibility"))


def component_densities(x, alpha, mu, var):
    """alpha * (exp(-(x - mu)^2 / 2v) + 1e-9) / sqrt(2 pi v)"""
    return [F.lit(a / math.sqrt(2.0 * math.pi * v)) * (F.exp(-(x - F.lit(m)) * (x - F.lit(m)) / F.lit(2.0 * v)) + F.lit(1e-9))
            for a, m, v in zip(alpha, mu, var)]


def quantile_start(df: DataFrame, x: str, k: int) -> MixtureModel:
    """Equal shares, means at the quantiles, the overall variance."""
    shares = [(i + 0.5) / k for i in range(k)]
    row = df.agg(F.percentile_approx(x, shares, 10000).alias("q"), F.var_pop(x).alias("v")).first()
    return MixtureModel([1.0 / k] * k, [float(q) for q in row["q"]], [row["v"]] * k)


def gmm_fit(df: DataFrame, x: str, start: MixtureModel = None, n_components: int = 1, eps: float = 1e-3,
            max_iter: int = 200) -> MixtureModel:
    """One-dimensional Gaussian mixture; stops when all three parameter moves are under eps."""
    model = start or quantile_start(df, x, n_components)
    rows = df.select(required(x).alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("x").alias("d"), F.avg("x").alias("m")).first()
    if not size["n"]:
        raise ValueError("no rows to learn from")
    if worth_collapsing(size["n"], size["d"]):
        table = collapse(rows, ["x"], {"c": F.lit(1.0)})
    else:
        table = rows.withColumn("c", F.lit(1.0))
    table = kept(table)
    n, centre = size["n"], F.lit(size["m"])
    alpha, mu, var, done, step = model.alpha, model.mu, model.var, False, 0
    k = len(alpha)
    for step in range(1, max_iter + 1):
        shares = F.array(*MixtureModel(alpha, mu, var).shares(F.col("x")))
        d = F.col("x") - centre
        row = table.select("c", d.alias("d"), shares.alias("g")).select(
            "d", *[(F.col("c") * F.element_at("g", i + 1)).alias(f"g{i}") for i in range(k)]).agg(
            *[F.sum(f"g{i}").alias(f"s{i}") for i in range(k)],
            *[F.sum(F.col(f"g{i}") * F.col("d")).alias(f"x{i}") for i in range(k)],
            *[F.sum(F.col(f"g{i}") * F.col("d") * F.col("d")).alias(f"q{i}") for i in range(k)]).first()
        if any(not row[f"s{i}"] > 0 for i in range(k)):
            raise ValueError("a component lost all its weight; give another start")
        shift = [row[f"x{i}"] / row[f"s{i}"] for i in range(k)]
        new = ([row[f"s{i}"] / n for i in range(k)], [size["m"] + s for s in shift],
               [max(row[f"q{i}"] / row[f"s{i}"] - s * s, 1e-300) for i, s in enumerate(shift)])
        moves = [math.dist(a, b) for a, b in zip(new, (alpha, mu, var))]
        alpha, mu, var = new
        if all(m < eps for m in moves):
            done = True
            break
    table.unpersist()
    return MixtureModel(alpha, mu, var, step, done)
