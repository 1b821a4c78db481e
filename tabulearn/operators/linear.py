"""Logistic regression and perceptrons: weights on the driver, sums over all rows per step."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.batches import matrix, summed, vector
from tabulearn.functions.columns import (
    argmax_label, distinct_labels, dot, feature_array, label_code, literal_array, plus_minus, sigmoid)
from tabulearn.functions.tables import worth_collapsing
from tabulearn.session import kept

# Largest block of rows, in numbers (64 MB), that is replayed at once.
MAX_REPLAYED = 8_000_000


def _prepared(df, features, label, id_col=None):
    """Rows as (x with a trailing 1, class code)."""
    classes = distinct_labels(df, label)
    if len(classes) < 2:
        raise ValueError("need at least two classes")
    ident = [F.col(id_col).cast("long").alias("id")] if id_col else []
    rows = df.select(*ident, F.concat(feature_array(features), F.array(F.lit(1.0))).alias("x"),
                     label_code(label, classes).alias("c"))
    return kept(rows), classes


def class_targets(c: np.ndarray, n_classes: int) -> np.ndarray:
    """0/1 targets: one column for two classes, else one per class."""
    if n_classes == 2:
        return c.reshape(-1, 1).astype(float)
    return (c.reshape(-1, 1) == np.arange(n_classes)).astype(float)


def gradient_sums(w: np.ndarray, n_classes: int):
    """x^T (y - sigmoid(x w)) for all outputs at once, and the row count."""
    def part(batch):
        x, c = matrix(batch.column("x")), vector(batch.column("c"))
        z = x @ w
        p = 1.0 / (1.0 + np.exp(-z))
        return np.append((x.T @ (class_targets(c, n_classes) - p)).ravel(), float(len(c)))

    return part, w.size + 1


@dataclass
class LogisticModel:
    features: object
    classes: list
    w: np.ndarray  # (features + bias, outputs)

    def table(self, spark) -> DataFrame:
        """(output, feature, weight): output is the class position, the last feature is the bias."""
        rows = [(o, f, float(self.w[f, o])) for o in range(self.w.shape[1]) for f in range(self.w.shape[0])]
        return spark.createDataFrame(rows, "output int, feature int, weight double")

    def proba(self):
        x = feature_array(self.features)
        return F.array(*[sigmoid(dot(x, literal_array(self.w[:-1, o])) + F.lit(float(self.w[-1, o])))
                         for o in range(self.w.shape[1])])

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        return df.withColumn(out, self.proba())

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if len(self.classes) == 2:
            low, high = self.classes
            return df.withColumn(out, F.when(F.element_at(self.proba(), 1) >= 0.5, F.lit(high)).otherwise(F.lit(low)))
        return df.withColumn("_p", self.proba()).withColumn(out, argmax_label(F.col("_p"), self.classes)).drop("_p")


def in_batch(step: int, share: float):
    """A deterministic pseudo-random slice of the rows for one step, from the id."""
    # Three primes that mix id and step.
    mixed = F.pmod(F.pmod(F.col("id"), F.lit(1000003)) * F.lit(7919) + F.lit(step * 104729), F.lit(1000003))
    return mixed < F.lit(int(share * 1000003))


def logistic_fit(df: DataFrame, features, label: str, learning_rate: float = 1e-3, decay: float = 1e-4,
                 C: float = 1.0, max_iter: int = 5000, solver: str = "batch", id_col: str = None,
                 batch_share: float = 0.1) -> LogisticModel:
    """Gradient ascent on the log likelihood less |w|^2 / 2C; the bias carries no penalty.

    Step i uses learning_rate / (1 + decay i). All classes of one-vs-rest move
    in the same job. ``solver="minibatch"`` sums over a pseudo-random share of
    the rows per step, chosen by id.
    """
    if solver not in ("batch", "minibatch"):
        raise KeyError(solver)
    if solver == "minibatch" and id_col is None:
        raise ValueError("minibatch needs id_col")
    rows, classes = _prepared(df, features, label, id_col)
    d = rows.select(F.size("x")).first()[0]
    w = np.zeros((d, 1 if len(classes) == 2 else len(classes)))
    for i in range(max_iter):
        part, size = gradient_sums(w, len(classes))
        step_rows = rows.filter(in_batch(i, batch_share)) if solver == "minibatch" else rows
        sums = summed(step_rows.select("x", "c"), part, size)[:-1].reshape(w.shape)
        penalty = w / C
        penalty[-1, :] = 0.0
        w = w + learning_rate / (1.0 + decay * i) * (sums - penalty)
    rows.unpersist()
    return LogisticModel(features, classes, w)


def logistic_gradient(df: DataFrame, features, label: str, w: np.ndarray) -> np.ndarray:
    """x^T (y - sigmoid(x w)) at the given weights (bias last), without penalty."""
    rows, classes = _prepared(df, features, label)
    w = np.asarray(w, dtype=float)
    part, size = gradient_sums(w, len(classes))
    out = summed(rows, part, size)[:-1].reshape(w.shape)
    rows.unpersist()
    return out


@dataclass
class Perceptron:
    features: object
    classes: list
    w: np.ndarray
    b: float
    converged: bool
    updates: list  # (epoch, mistakes) or (id, alpha)
    jobs: int = 0

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate([*self.w, self.b])], "feature int, weight double")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """-1 or +1."""
        score = dot(feature_array(self.features), literal_array(self.w)) + F.lit(float(self.b))
        return df.withColumn(out, F.when(score >= 0, F.lit(1)).otherwise(F.lit(-1)))


def mistakes(w, b):
    """Sums of y x and y over the rows on the wrong side, and their number."""
    def part(batch):
        x, y = matrix(batch.column("x")), vector(batch.column("y"))
        wrong = np.where(y * (x @ w + b) <= 0.0, y, 0.0)
        return np.concatenate([wrong @ x, [wrong.sum(), np.abs(wrong).sum()]])

    return part, len(w) + 2


def perceptron_fit(df: DataFrame, features, label: str, eta: float = 1.0, max_epochs: int = 100) -> Perceptron:
    """Batch perceptron: each epoch adds eta y x over all rows on the wrong side."""
    classes = distinct_labels(df, label)
    rows = kept(df.select(feature_array(features).alias("x"), plus_minus(label, classes).alias("y")))
    d = rows.select(F.size("x")).first()[0]
    w, b, log, done = np.zeros(d), 0.0, [], False
    for epoch in range(max_epochs):
        sums = summed(rows, *mistakes(w, b))
        log.append((epoch + 1, int(sums[-1])))
        if sums[-1] == 0:
            done = True
            break
        w, b = w + eta * sums[:d], b + eta * float(sums[d])
    rows.unpersist()
    return Perceptron(features, classes, w, b, done, log)


def replay(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, eta: float, radius: float, most: int):
    """Updates by the first row on the wrong side, until none is, ``most`` are made, or the weights moved by ``radius``.

    Returns (rows updated in order, whether all rows are right, how far the weights moved). Scores are kept up by the
    columns of the Gram matrix that updates need.
    """
    score, gram, order = x @ w + b, {}, []
    moved, far = np.zeros(len(w) + 1), 0.0
    while True:
        wrong = y * score <= 0.0
        i = int(wrong.argmax()) if len(wrong) else 0
        if not len(wrong) or not wrong[i]:
            return order, True, far
        if len(order) == most or far and far >= radius:
            return order, False, far
        if i not in gram:
            gram[i] = x @ x[i] + 1.0
        score += eta * y[i] * gram[i]
        moved += eta * y[i] * np.append(x[i], 1.0)
        far = float(np.linalg.norm(moved))
        order.append(i)


def perceptron_dual_fit(df: DataFrame, features, label: str, id_col: str, eta: float = 1.0,
                        max_updates: int = 1000, block: int = 4096) -> Perceptron:
    """Each update takes the first row in id order on the wrong side; ``updates`` holds (id, alpha).

    A job brings the first ``block`` rows that are wrong or that a move of the weights by ``radius`` could make wrong;
    all others stay right until then, so many updates are replayed exactly among these. The radius is endless at first,
    which takes the first rows as they are. ``jobs`` counts the passes. Rows of equal id go by features and label.
    """
    classes = distinct_labels(df, label)
    rows = df.select(F.col(id_col).alias("id"), feature_array(features).alias("x"), plus_minus(label, classes).alias("y"))
    n = rows.agg(F.count("*").alias("all"), F.approx_count_distinct(F.struct("x", "y")).alias("some")).first()
    if worth_collapsing(n["all"], n["some"]):
        rows = rows.groupBy("x", "y").agg(F.min("id").alias("id"))  # of equal rows only the first is ever taken
    rows = kept(rows.select("id", "x", "y"))
    d = rows.select(F.size("x")).first()[0]
    block = max(1, min(block, MAX_REPLAYED // (d + 2)))
    w, b, alpha, done, made, jobs, radius = np.zeros(d), 0.0, {}, False, 0, 0, np.inf
    while not done and made < max_updates:
        near = rows
        if radius < np.inf:
            score = dot(F.col("x"), literal_array(w)) + F.lit(float(b))
            near = rows.filter(F.col("y") * score <= F.lit(radius) * F.sqrt(dot(F.col("x"), F.col("x")) + 1.0))
        found = near.orderBy("id", "x", "y").limit(block + 1).collect()
        jobs += 1
        cut, found = len(found) > block, found[:block]
        x, y = np.array([r["x"] for r in found], dtype=float).reshape(len(found), d), np.array([r["y"] for r in found])
        # A hair less than the radius, for what rounding does to the margins.
        order, right, far = replay(x, y, w, b, eta, radius * (1 - 1e-9), max_updates - made)
        for i in order:
            alpha[found[i]["id"]] = alpha.get(found[i]["id"], 0.0) + eta
            w, b = w + eta * y[i] * x[i], b + eta * y[i]
        made += len(order)
        if right and not cut and (far == 0.0 or far < radius * (1 - 1e-9)):
            done = True
        elif right and not order and radius < np.inf:
            radius = 0.0  # only wrong rows: the first of these is the first of all
        elif right:
            step = eta * float(np.sqrt((x * x).sum(axis=1) + 1.0).max())
            radius = 8.0 * step if radius == np.inf else radius / 2.0
        else:
            radius = 2.0 * max(radius, far)
    rows.unpersist()
    return Perceptron(features, classes, w, b, done, sorted(alpha.items()), jobs)
