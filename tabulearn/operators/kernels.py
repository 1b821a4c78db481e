"""Kernels, support-vector scoring, margins, and soft-margin fits.

A support table is small by nature, so scoring takes it as one array inside
each task, after its size is checked. A larger one becomes one vector for the
linear kernel, and else is divided into tiles: each task adds up one tile of
rows against one tile of support vectors.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.batches import matrix, summed, vector
from tabulearn.functions.columns import distinct_labels, dot, feature_array, literal_array, plus_minus
from tabulearn.session import kept

# Largest support table, in numbers (64 MB), that is copied into every task.
MAX_INLINE_NUMBERS = 8_000_000
TILE_NUMBERS = 2_000_000  # of a kernel matrix that a task holds at once


def kernel_matrix(x: np.ndarray, s: np.ndarray, kind: str, sigma: float) -> np.ndarray:
    """``rbf``: exp(-|x-s|^2 / (2 sigma)), sigma not squared; ``linear``: x.s"""
    if kind == "linear":
        return x @ s.T
    if kind == "rbf":
        sq = (x * x).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2.0 * (x @ s.T)
        return np.exp(-np.maximum(sq, 0.0) / (2.0 * sigma))
    raise KeyError("no such kernel function")


def _inline(support: DataFrame, features, columns=()):
    """The support rows in id order, or None when they are over the size bound."""
    table = support.select(F.col("sv_id").cast("long").alias("sv_id"), feature_array(features).alias("x"), *columns)
    size = table.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no support vectors")
    if size["n"] * (size["d"] + 2) > MAX_INLINE_NUMBERS:
        return None, table, size["n"]
    rows = sorted(table.collect(), key=lambda r: r["sv_id"])
    return rows, table, size["n"]


def kernel_rows(df: DataFrame, support: DataFrame, id_col: str, features, kind: str = "rbf", sigma: float = 1.0) -> DataFrame:
    """(id, kernel array in sv_id order): one row of the kernel matrix per input row.

    The support table must be within the size bound, since each output row
    holds one number per support vector.
    """
    rows, _, _ = _inline(support, features)
    if rows is None:
        raise ValueError("support table over the size bound; use decision_function")
    s = np.array([r["x"] for r in rows], dtype=float)
    table = df.select(id_col, feature_array(features).alias("x"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = kernel_matrix(matrix(batch.column("x")), s, kind, sigma)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(k.tolist(), pa.list_(pa.float64()))], [id_col, "kernel"])

    return table.mapInArrow(run, table.select(id_col).schema.add("kernel", T.ArrayType(T.DoubleType())))


def decision_function(df: DataFrame, support: DataFrame, b: float, id_col: str, features, keep: list = (),
                      kind: str = "rbf", sigma: float = 1.0, tile_rows: int = 4096,
                      max_inline: int = None) -> DataFrame:
    """(id, keep.., score): sum of alpha y K(x, s) over the support vectors, plus b.

    ``support`` has sv_id, the features, y (-1/+1) and alpha.
    """
    weight = (F.col("alpha").cast("double") * F.col("y").cast("double")).alias("weight")
    rows, table, n_support = _inline(support, features, [weight])
    if max_inline is not None and n_support > max_inline:
        rows = None
    data = df.select(id_col, *keep, feature_array(features).alias("x"))
    if rows is None and kind == "linear":
        # The sum of the kernels is the kernel with the sum: no pairs of rows and support vectors.
        d = table.select(F.size("x")).first()[0]
        s, w = summed(table, lambda batch: vector(batch.column("weight")) @ matrix(batch.column("x")), d)[None, :], np.ones(1)
    elif rows is None:
        return _tiled_decision(data, table, n_support, b, id_col, keep, kind, sigma, tile_rows)
    else:
        s = np.array([r["x"] for r in rows], dtype=float)
        w = np.array([r["weight"] for r in rows], dtype=float)
        if kind == "linear":
            s, w = (w @ s)[None, :], np.ones(1)
    step = max(1, TILE_NUMBERS // len(s))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                score = np.concatenate([kernel_matrix(x[i:i + step], s, kind, sigma) @ w for i in range(0, len(x), step)]) + b
                kept_columns = [batch.column(c) for c in (id_col, *keep)]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(score)], [id_col, *keep, "score"])

    return data.mapInArrow(run, data.drop("x").schema.add("score", T.DoubleType()))


def _tiled_decision(data, support, n_support, b, id_col, keep, kind, sigma, tile_rows):
    s_tiles = -(-n_support // tile_rows)
    q_tiles = max(1, -(-data.count() // tile_rows))
    left = data.withColumn("qt", F.pmod(F.xxhash64(id_col), F.lit(q_tiles)).cast("int")).withColumn(
        "st", F.explode(F.sequence(F.lit(0), F.lit(s_tiles - 1))))
    right = support.withColumn("st", F.pmod(F.xxhash64("sv_id"), F.lit(s_tiles)).cast("int")).withColumn(
        "qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))
    names = [id_col, *keep]

    def part(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        out = lhs[names].copy()
        out["part"] = 0.0
        if len(lhs) and len(rhs):
            k = kernel_matrix(np.stack(lhs["x"]).astype(float), np.stack(rhs["x"]).astype(float), kind, sigma)
            out["part"] = k @ rhs["weight"].to_numpy()
        return out

    parts = left.groupBy("qt", "st").cogroup(right.groupBy("qt", "st")).applyInPandas(
        part, data.drop("x").schema.add("part", T.DoubleType()))
    return parts.groupBy(*names).agg((F.sum("part") + F.lit(b)).alias("score"))


def kernel_predict(scored: DataFrame, classes: list, out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, F.when(F.col("score") >= 0, F.lit(classes[1])).otherwise(F.lit(classes[0])))


def kkt_violations(scored: DataFrame, support: DataFrame, id_col: str, y: str, C: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """Rows whose margin error breaks the optimality conditions.

    error = score - y; a row breaks them when y*error < -tol with alpha < C,
    or y*error > tol with alpha > 0. Rows outside the support table have alpha 0.
    """
    alphas = support.select(F.col("sv_id").alias(id_col), F.col("alpha").cast("double").alias("alpha"))
    err = F.col("score") - F.col(y)
    rows = scored.join(alphas, id_col, "left").select(
        id_col, y, "score", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), err.alias("error"))
    margin = F.col(y) * F.col("error")
    return rows.filter(((margin < -tol) & (F.col("alpha") < C)) | ((margin > tol) & (F.col("alpha") > 0)))


def weights_from_support(support: DataFrame, features) -> DataFrame:
    """(feature index, weight): w = sum of alpha y x over the support vectors."""
    scaled = F.col("alpha") * F.col("y")
    return (
        support.select(scaled.cast("double").alias("a"), F.posexplode(feature_array(features)).alias("feature", "v"))
        .groupBy("feature").agg(F.sum(F.col("a") * F.col("v")).alias("weight")))


class LinearSvm:
    def __init__(self, features, classes, w, b, frequencies=None, phases=None):
        self.features, self.classes, self.w, self.b = features, classes, w, b
        self.frequencies, self.phases = frequencies, phases

    def decision_function(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.frequencies is None:
            return df.withColumn(out, dot(feature_array(self.features), literal_array(self.w)) + F.lit(self.b))
        df = random_features(df, self.features, self.frequencies, self.phases, "_z")
        return df.withColumn(out, dot(F.col("_z"), literal_array(self.w)) + F.lit(self.b)).drop("_z")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return kernel_predict(self.decision_function(df), self.classes, out).drop("score")

    def table(self, spark) -> DataFrame:
        rows = [(i, float(v)) for i, v in enumerate([*self.w, self.b])]
        return spark.createDataFrame(rows, "feature int, weight double")


def _hinge_part(w, b):
    d = len(w)

    def part(batch):
        x, y = matrix(batch.column("x")), vector(batch.column("y"))
        margin = y * (x @ w + b)
        inside = np.where(margin < 1.0, y, 0.0)
        return np.concatenate([inside @ x, [inside.sum(), float(len(y)), np.maximum(0.0, 1.0 - margin).sum()]])

    return part, d + 3


def svm_linear_fit(df: DataFrame, features, label: str, C: float = 1.0, max_iter: int = 100,
                   learning_rate: float = 0.1, decay: float = 1e-2) -> LinearSvm:
    """Soft margin |w|^2 / 2 + C * hinge by batch subgradient steps, scaled by 1/(n C).

    One job per step, each a sum over all rows.
    """
    classes = distinct_labels(df, label)
    rows = kept(df.select(feature_array(features).alias("x"), plus_minus(label, classes).alias("y")))
    d = rows.select(F.size("x")).first()[0]
    w, b = np.zeros(d), 0.0
    for t in range(max_iter):
        part, size = _hinge_part(w, b)
        sums = summed(rows, part, size)
        n = sums[d + 1]
        rate = learning_rate / (1.0 + decay * t)
        w = (1.0 - rate / (n * C)) * w + rate * sums[:d] / n
        b += rate * sums[d] / n
    rows.unpersist()
    return LinearSvm(features, classes, w, float(b))


def random_features(df: DataFrame, features, frequencies: np.ndarray, phases: np.ndarray, out: str) -> DataFrame:
    """Add cos features whose inner products approach the rbf kernel."""
    table = df.withColumn(out, feature_array(features))
    at = table.columns.index(out)
    scale = np.sqrt(2.0 / len(phases))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = scale * np.cos(matrix(batch.column(out)) @ frequencies + phases)
                yield batch.set_column(at, out, pa.array(z.tolist(), pa.list_(pa.float64())))

    return table.mapInArrow(run, table.schema)


def svm_rbf_fit(df: DataFrame, features, label: str, sigma: float = 1.0, C: float = 1.0, n_components: int = 128,
                seed: int = 0, max_iter: int = 50, **options) -> LinearSvm:
    """Rbf soft margin by random Fourier features and the linear fit on them.

    Frequencies are drawn from N(0, 1/sigma), the spectrum of exp(-d^2/(2 sigma)).
    The kernel is approximated; every row takes part in every step.
    """
    d = df.select(F.size(feature_array(features))).first()[0]
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0.0, 1.0 / np.sqrt(sigma), size=(d, n_components))
    phases = rng.uniform(0.0, 2.0 * np.pi, size=n_components)
    mapped = random_features(df, features, frequencies, phases, "_z")
    linear = svm_linear_fit(mapped, "_z", label, C, max_iter, **options)
    return LinearSvm(features, linear.classes, linear.w, linear.b, frequencies, phases)
