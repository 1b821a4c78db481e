"""Maximum entropy on sparse counts by iterative scaling, and on dense features by L-BFGS.

The weights have one row per token and stay a table: the vocabulary grows with
the data. The counts are packed by document once (``token_blocks``): a step
moves a weight and a sum per block and distinct token of the block.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import argmax_label, distinct_labels, feature_array, label_array
from tabulearn.functions.tables import keyed_join
from tabulearn.operators import token_blocks
from tabulearn.operators.naive_bayes import per_class_rows
from tabulearn.operators.token_blocks import Packed, pack
from tabulearn.session import checkpointed, parts_of, released

TINY = 1e-9
TASK_ROWS = 500_000  # counted tokens in a task
RELEASED_EVERY = 8  # steps whose sums may lie on disk


@dataclass
class MaxentModel:
    classes: list
    weights: DataFrame  # token, w array<double> in class order
    iterations: int = 0
    converged: bool = False

    def table(self) -> DataFrame:
        return (
            self.weights.select("token", F.explode(F.arrays_zip(label_array(self.classes).alias("label"), "w")).alias("r"))
            .select(F.col("r.label").alias("label"), "token", F.col("r.w").alias("weight")))

    def score(self, docs: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
        """(id, jll): x.w per class; a document without known tokens scores 0 for all."""
        return _scores(docs, counts, self.weights, id_col, len(self.classes))

    def predict_proba(self, docs: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
        return per_class_rows(self.score(docs, counts, id_col), [id_col], self.classes).select(id_col, "label", "proba")

    def predict(self, docs: DataFrame, counts: DataFrame, id_col: str, out: str = "prediction") -> DataFrame:
        return self.score(docs, counts, id_col).select(id_col, argmax_label(F.col("jll"), self.classes).alias(out))


def _scores(docs, counts, weights, id_col, k):
    empty = docs.select(id_col, *[F.lit(0.0).alias(f"s{i}") for i in range(k)])
    if isinstance(counts, Packed):
        parts = counts.scores(weights, k, id_col).select(id_col, *[F.get("jll", F.lit(i)).alias(f"s{i}") for i in range(k)])
    else:
        known = keyed_join(counts.select(id_col, "token", "n"), weights, "token", F.col(id_col), salts=1)
        parts = known.select(id_col, *[(F.col("n") * F.element_at("w", i + 1)).alias(f"s{i}") for i in range(k)])
    return parts.unionByName(empty).groupBy(id_col).agg(F.array(*[F.sum(f"s{i}") for i in range(k)]).alias("jll"))


def expectations(docs: DataFrame, counts: DataFrame, label: str, classes: list = None) -> DataFrame:
    """(token, e): per class, the feature total over the number of documents."""
    classes = classes or distinct_labels(docs, label)
    n = docs.count()
    return counts.groupBy("token").agg(F.array(*[
        F.sum(F.when(F.col(label) == F.lit(c), F.col("n").cast("double")).otherwise(0.0)) / F.lit(n) for c in classes]).alias("e"))


def maxent_fit(docs: DataFrame, counts: DataFrame, id_col: str, label: str, max_iter: int = 200, eps: float = 1e-2,
               step_total: bool = False) -> MaxentModel:
    """Iterative scaling: w += log((observed + 1e-9) / (expected + 1e-9)) / M.

    M is the largest feature sum of a document, or the grand total with
    ``step_total``. Stops when no weight moves by ``eps``.
    """
    classes = distinct_labels(docs, label)
    spark, k, n = docs.sparkSession, len(classes), docs.count()
    packed = counts if isinstance(counts, Packed) else pack(counts, id_col, parts_of(spark, counts.count(), TASK_ROWS), label, classes)
    m = packed.total() if step_total else packed.largest()
    if not m:
        raise ValueError("no features to learn from")
    tokens = packed.tokens()
    fit = _fit_held if tokens.count() * k <= token_blocks.SENT_NUMBERS else _fit_table
    return MaxentModel(classes, *fit(packed, tokens, k, n, m, max_iter, eps))


def _fit_held(packed: Packed, tokens: DataFrame, k: int, n: int, m: int, max_iter: int, eps: float):
    """The weights are an array that every task has."""
    spark = tokens.sparkSession
    held = token_blocks.Held(packed, tokens.orderBy("token").toArrow()["token"].combine_chunks())
    observed = np.log(held.summed(k, lambda block, at: block.observed(k, len(at))) / n + TINY)
    w, done, i = np.zeros((len(held.vocab), k)), False, 0
    for i in range(1, max_iter + 1):
        send = spark.sparkContext.broadcast(w)
        expected = held.summed(k, lambda block, at, send=send: block.sums(token_blocks.shares(block.scores(send.value[at])), len(at))) / n
        send.destroy()
        move = (observed - np.log(expected + TINY)) / m
        w = w + move
        if i % RELEASED_EVERY == 0:
            released(spark)
        if np.abs(move).max() < eps:
            done = True
            break
    weights = spark.createDataFrame(pa.table({"token": held.vocab, "w": token_blocks.lists(w)}))
    return checkpointed(weights.repartition(packed.parts)), i, done


def _fit_table(packed: Packed, tokens: DataFrame, k: int, n: int, m: int, max_iter: int, eps: float):
    """The weights are a table that lies dealt out by token."""
    weights = packed.at_home(tokens.withColumn("w", F.array(*[F.lit(0.0)] * k)))
    counted = packed.met(weights, k, lambda block, w: token_blocks.token_sums(block, block.observed(k, len(w))), token_blocks.TOKEN_SUMS)
    observed = packed.at_home(packed.per_token(counted, k, n, "e"))
    done, i = False, 0
    for i in range(1, max_iter + 1):
        found = packed.met(weights, k, lambda block, w: token_blocks.token_sums(block, block.sums(token_blocks.shares(block.scores(w)), len(w))), token_blocks.TOKEN_SUMS)
        expected = packed.per_token(found, k, n, "m")
        move = F.zip_with("e", "m", lambda a, b: (F.log(a + F.lit(TINY)) - F.log(b + F.lit(TINY))) / F.lit(float(m)))
        stepped = observed.join(expected.hint("shuffle_hash"), "token").select("token", move.alias("d")).join(weights.hint("shuffle_hash"), "token")
        weights = packed.at_home(stepped.select("token", F.zip_with("w", "d", lambda a, b: a + b).alias("w"), F.array_max(
            F.transform("d", lambda v: F.abs(v))).alias("moved")))
        moved = weights.agg(F.max("moved")).first()[0]
        weights = weights.drop("moved")
        del found, expected, stepped
        released(tokens.sparkSession)
        if moved < eps:
            done = True
            break
    return weights, i, done


def maxent_fit_lbfgs(df: DataFrame, features, label: str, max_iter: int = 200, tol: float = 1e-6, reg_param: float = 0.0):
    """The same model class on dense features by distributed L-BFGS, without intercept.

    Returns (classes, weights): weights[c][f]. On separable data the optimum
    is at infinity; give ``reg_param`` there.
    """
    classes = distinct_labels(df, label)
    code = F.array_position(label_array(classes), F.col(label)).cast("double") - 1.0
    rows = df.select(array_to_vector(feature_array(features)).alias("features"), code.alias("label"))
    model = LogisticRegression(family="multinomial", fitIntercept=False, standardization=False, regParam=reg_param,
                               maxIter=max_iter, tol=tol).fit(rows)
    return classes, model.coefficientMatrix.toArray()
