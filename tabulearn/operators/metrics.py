"""Accuracy, squared error, R2, ROC points and the area under them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.tables import bucket_of, ordered_totals, quantile_cuts
from tabulearn.session import checkpointed


def accuracy_of(label, predicted):
    return F.avg(F.col(label).eqNullSafe(F.col(predicted)).cast("int"))


def mse_of(y, p):
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def r2_of(y, p):
    """1 - SSE / SST; null when the target is constant."""
    sse = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1.0 - sse / sst)


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(accuracy_of(label, predicted).alias("accuracy"),
                  (1.0 - accuracy_of(label, predicted)).alias("error_rate"))


def r2(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(r2_of(y, p).alias("r2"))


def mse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(mse_of(y, p).alias("mse"))


def _score_totals(df, positive, score, max_distinct, buckets):
    """One row per distinct score, with the positives and negatives at or above it."""
    hist = checkpointed(df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(positive, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(positive, 0.0).otherwise(1.0)).alias("neg")))
    cuts = quantile_cuts(hist, ["score"], max_distinct, buckets).get("score")
    hist = hist.withColumn("all", F.lit(0)).withColumn("bucket", bucket_of(F.col("score"), cuts))
    return ordered_totals(hist, ["all"], "score", ["pos", "neg"], bool(cuts))


def roc_points(df: DataFrame, positive, score: str, max_distinct: int = 100_000, buckets: int = 256) -> DataFrame:
    """(threshold, tpr, fpr) at the midpoint of each pair of adjacent scores.

    A row is predicted positive when its score is at least the threshold.
    """
    t = _score_totals(df, positive, score, max_distinct, buckets)
    return t.filter(F.col("nxt").isNotNull()).select(
        ((F.col("score") + F.col("nxt")) / 2.0).alias("threshold"),
        F.when(F.col("t_pos") > 0, (F.col("t_pos") - F.col("c_pos")) / F.col("t_pos")).alias("tpr"),
        F.when(F.col("t_neg") > 0, (F.col("t_neg") - F.col("c_neg")) / F.col("t_neg")).alias("fpr"))


def auc(df: DataFrame, positive, score: str, max_distinct: int = 100_000, buckets: int = 256) -> DataFrame:
    """Area by the trapezoid rule: each distinct score is one step of the curve."""
    t = _score_totals(df, positive, score, max_distinct, buckets)
    above = F.col("t_pos") - F.col("c_pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    weight = F.max("t_pos") * F.max("t_neg")
    return t.agg(F.when(weight > 0, area / weight).alias("auc"))
