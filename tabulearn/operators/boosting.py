"""Stump and tree boosting, AdaBoost and gradient boosting.

The running score F of a row depends on its features only, so every round works
on the collapsed training table. F is an expression over the models found so
far; every ``checkpoint_every`` rounds it is written out as a column, so plans
keep a fixed size however many rounds there are.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import distinct_labels, plus_minus, sigmoid
from tabulearn.operators.metrics import r2_of
from tabulearn.operators.splits import Variance, best_splits, best_weighted_stump, centred, prepare
from tabulearn.operators.trees import Tree, grow, prepare_regression
from tabulearn.session import checkpointed

CHECKPOINT_EVERY = 10


class Scored:
    """A training table with its running score."""

    def __init__(self, data, start: float, every: int):
        self.data, self.every = data, every
        self.table = data.table
        self.score = F.lit(float(start))
        self.rounds = 0

    def add(self, change: Column):
        self.score = self.score + change
        self.rounds += 1
        if self.rounds % self.every == 0:
            table = checkpointed(self.table.withColumn("_next", self.score).drop("_score").withColumnRenamed("_next", "_score"))
            self.table.unpersist()
            self.table, self.score = table, F.col("_score")

    def residuals(self) -> DataFrame:
        """n, m, w of (target - score)."""
        return self.table.select(*self.data.features, "n", (F.col("m") - self.score).alias("m"), "w")


@dataclass
class Stump:
    feature: int
    point: float
    left: float
    right: float


def stump_column(features, stump) -> Column:
    return F.when(F.col(features[stump.feature]) <= F.lit(stump.point), F.lit(stump.left)).otherwise(F.lit(stump.right))


def running_sums(outputs: list) -> Column:
    """Array of the cumulative sums of the round outputs."""
    return F.aggregate(
        F.array(*outputs), F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


@dataclass
class StumpRegressor:
    features: list
    stumps: list

    def table(self, spark) -> DataFrame:
        rows = [(i + 1, self.features[s.feature], s.point, s.left, s.right) for i, s in enumerate(self.stumps)]
        return spark.createDataFrame(rows, "round int, feature string, point double, left_output double, right_output double")

    def outputs(self) -> list:
        return [stump_column(self.features, s) for s in self.stumps]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, sum(self.outputs(), F.lit(0.0)))


def stump_regress_fit(df: DataFrame, features: list, target: str, n_estimators: int = 50,
                      checkpoint_every: int = CHECKPOINT_EVERY, **options) -> StumpRegressor:
    """Each round fits one split to the residual; stops when no split improves it."""
    data, mean = prepare_regression(df, features, target, **options)
    state, stumps = Scored(data, mean, checkpoint_every), []
    for i in range(n_estimators):
        rows = centred(state.residuals().withColumn("node", F.lit(1)), F.lit(0.0))
        found = best_splits(rows, features, Variance, ["n", "s", "q"], data.cuts).collect()
        if not found:
            break
        r = found[0]
        stump = Stump(r["feature"], r["point"], r["c_s"] / r["c_n"], (r["t_s"] - r["c_s"]) / (r["t_n"] - r["c_n"]))
        state.add(stump_column(features, stump))
        if not stumps:
            # The score starts from the mean, which the first round adds back.
            stump = Stump(stump.feature, stump.point, stump.left + mean, stump.right + mean)
        stumps.append(stump)
    state.table.unpersist()
    return StumpRegressor(list(features), stumps)


@dataclass
class TreeEnsemble:
    """start + rate * sum of tree outputs."""

    features: list
    trees: list
    start: float = 0.0
    rate: float = 1.0

    def outputs(self) -> list:
        return [F.lit(self.rate) * t.value_column() for t in self.trees]

    def score_column(self) -> Column:
        return sum(self.outputs(), F.lit(self.start))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.score_column())

    def table(self, spark) -> DataFrame:
        out = None
        for i, t in enumerate(self.trees):
            part = t.table(spark).select(F.lit(i + 1).alias("round"), "*")
            out = part if out is None else out.unionByName(part)
        return out


def boosted_trees_fit(df: DataFrame, features: list, target: str, n_estimators: int = 50, max_depth: int = 3,
                      checkpoint_every: int = CHECKPOINT_EVERY, **options) -> TreeEnsemble:
    """Least-squares trees on residuals; leaves at most ``max_depth`` edges deep."""
    data, mean = prepare_regression(df, features, target, **options)
    state, trees = Scored(data, mean, checkpoint_every), []
    for i in range(n_estimators):
        nodes = grow(state.residuals(), features, ["n", "s", "q"], Variance, data.totals | {"m": 0.0}, data.cuts, max_depth)
        values = {k: n.mean for k, n in nodes.items()}
        state.add(Tree(list(features), nodes, values).value_column())
        if i == 0:
            values = {k: v + mean for k, v in values.items()}
        trees.append(Tree(list(features), nodes, values))
        if len(nodes) == 1:
            break
    state.table.unpersist()
    return TreeEnsemble(list(features), trees)


def negative_gradient(y: Column, f: Column) -> Column:
    return y / (F.lit(1.0) + F.exp(y * f))


@dataclass
class GradientBoosted(TreeEnsemble):
    classes: list = None

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        return df.withColumn(out, sigmoid(self.score_column()))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        low, high = self.classes
        return df.withColumn(out, F.when(sigmoid(self.score_column()) >= 0.5, F.lit(high)).otherwise(F.lit(low)))


def gbdt_fit(df: DataFrame, features: list, label: str, n_estimators: int = 100, learning_rate: float = 0.1,
             max_depth: int = 3, checkpoint_every: int = CHECKPOINT_EVERY, **options) -> GradientBoosted:
    """Trees on the logistic gradient; each leaf takes one Newton step.

    Starts from the mean of the -1/+1 labels.
    """
    classes = distinct_labels(df, label)
    y = plus_minus(label, classes).alias("_y")
    data = prepare(df, features, [y], {"n": F.lit(1.0)}, **options)
    start = data.table.agg((F.sum(F.col("_y") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    state, trees = Scored(data, start, checkpoint_every), []
    sums = ["n", "s", "q", "h"]
    for _ in range(n_estimators):
        r = negative_gradient(F.col("_y"), state.score)
        rows = state.table.select(*features, "n", r.alias("m")).select(
            *features, "n", "m", F.lit(0.0).alias("w"), (F.col("n") * F.abs("m") * (F.lit(1.0) - F.abs("m"))).alias("h"))
        totals = {"n": data.totals["n"], "m": 0.0, "s": 0.0, "q": 0.0, "h": 0.0}
        nodes = grow(rows, features, sums, Variance, totals, data.cuts, max_depth)
        if len(nodes) == 1:
            nodes[1].stats["h"] = rows.agg(F.sum("h").alias("h")).first()["h"]
        tree = Tree(list(features), nodes, {i: n.mean * n.size / (n.stats["h"] + 1e-9) for i, n in nodes.items()})
        state.add(F.lit(learning_rate) * tree.value_column())
        trees.append(tree)
    state.table.unpersist()
    return GradientBoosted(list(features), trees, start, learning_rate, classes)


@dataclass
class WeightedStump:
    feature: int
    threshold: float
    gt: bool
    error: float
    alpha: float


@dataclass
class AdaBoost:
    features: list
    classes: list
    stumps: list

    def table(self, spark) -> DataFrame:
        rows = [(i + 1, self.features[s.feature], s.threshold, "gt" if s.gt else "lt", s.error, s.alpha)
                for i, s in enumerate(self.stumps)]
        return spark.createDataFrame(
            rows, "round int, feature string, threshold double, direction string, error double, alpha double")

    def outputs(self) -> list:
        return [F.lit(s.alpha) * vote(self.features, s) for s in self.stumps]

    def score_column(self) -> Column:
        return sum(self.outputs(), F.lit(0.0))

    def decision_function(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.withColumn(out, self.score_column())

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        low, high = self.classes
        return df.withColumn(out, F.when(self.score_column() >= 0, F.lit(high)).otherwise(F.lit(low)))


def vote(features, stump) -> Column:
    below = F.col(features[stump.feature]) <= F.lit(stump.threshold)
    low, high = (1.0, -1.0) if stump.gt else (-1.0, 1.0)
    return F.when(below, F.lit(low)).otherwise(F.lit(high))


def adaboost_fit(df: DataFrame, features: list, label: str, n_estimators: int = 50,
                 checkpoint_every: int = CHECKPOINT_EVERY, **options) -> AdaBoost:
    """One job per round: the weight of a row is exp(-y F) up to a constant.

    A stump without error is kept and ends the rounds.
    """
    classes = distinct_labels(df, label)
    data = prepare(df, features, [plus_minus(label, classes).alias("_y")], {"n": F.lit(1.0)}, **options)
    state, stumps = Scored(data, 0.0, checkpoint_every), []
    for _ in range(n_estimators):
        y = F.col("_y")
        w = F.col("n") * F.exp(-y * state.score) / F.lit(data.totals["n"])
        rows = state.table.select(*features, F.when(y > 0, w).otherwise(0.0).alias("wp"),
                                  F.when(y > 0, 0.0).otherwise(w).alias("wn"))
        r = best_weighted_stump(rows, features, data.cuts).first()
        error = min(max(r["error"], 0.0), 1.0)
        if error < 1e-12:
            error = 0.0
        stump = WeightedStump(r["feature"], r["threshold"], bool(r["gt"]), error,
                              0.5 * math.log((1.0 - error) / (error + 1e-9)))
        stumps.append(stump)
        if error == 0.0:
            break
        state.add(F.lit(stump.alpha) * vote(features, stump))
    state.table.unpersist()
    return AdaBoost(list(features), classes, stumps)


def staged(model, df: DataFrame, metric: Column) -> DataFrame:
    """The metric after each round; ``metric`` reads the score so far from ``staged``.

    A row's scores after all rounds are one array, exploded and summed before
    the shuffle, so only one partial row per round and task moves.
    """
    return (
        df.withColumn("_stages", running_sums(model.outputs()))
        .select(*df.columns, F.posexplode("_stages").alias("_pos", "staged"))
        .groupBy((F.col("_pos") + 1).alias("round")).agg(metric.alias("metric")))


def staged_r2(model, df: DataFrame, target: str) -> DataFrame:
    return staged(model, df, r2_of(target, "staged")).withColumnRenamed("metric", "r2")


def staged_error(model, df: DataFrame, label: str) -> DataFrame:
    low, high = model.classes
    guess = F.when(F.col("staged") >= 0, F.lit(high)).otherwise(F.lit(low))
    return staged(model, df, F.avg((guess != F.col(label)).cast("int"))).withColumnRenamed("metric", "error_rate")
