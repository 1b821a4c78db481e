"""Impurities, split candidates and the best split per node.

One pass finds the best split of every open node: rows are unpivoted to
(node, feature, value), summed to a histogram before the shuffle, and running
sums over the ordered values give both sides of every candidate. Only the
winning split of each node comes back to the driver.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import distinct_labels, required
from tabulearn.functions.tables import (
    bucket_of, collapse, ordered_totals, quantile_cuts, worth_collapsing)
from tabulearn.session import kept

# Losses are compared as shares of the node's own loss with this many digits,
# so that sums added in another order never change which candidate wins.
TIE_DIGITS = 9
# A split improves its node if it removes more than this share of the loss, which
# is what the order of addition can make of a split that removes nothing.
IMPROVES = 1e-12


@dataclass
class Training:
    """Prepared input: distinct feature vectors (or rows) with statistics to sum."""

    table: DataFrame
    features: list
    sums: list
    totals: dict
    cuts: dict = field(default_factory=dict)
    distinct: int = 0  # of the keys, about

    def release(self):
        self.table.unpersist()


def prepare(df: DataFrame, features: list, keys: list, stats: dict, collapse_rows=None,
            max_distinct: int = 100_000, buckets: int = 256, target: str = None) -> Training:
    """Project to features, extra keys and statistics; collapse equal rows.

    ``stats`` maps a name to a per-row column. ``collapse_rows`` None decides
    from an approximate distinct count taken in the same job as the totals.
    With a ``target`` each row also has the mean ``m`` of its targets and their
    squared deviations ``w`` from that mean, which stay exact however far the
    targets lie from zero or from each other.
    """
    clash = set(features) & (set(stats) | {"node", "bucket", "_score"} | ({"m", "w"} if target else set()))
    if clash:
        raise ValueError(f"rename feature columns {sorted(clash)}")
    rows = df.select(*[required(f).alias(f) for f in features], *keys,
                     *[c.cast("double").alias(n) for n, c in stats.items()],
                     *([required(target).alias("m"), F.lit(0.0).alias("w")] if target else []))
    key_names = [c for c in rows.columns if c not in stats and not (target and c in ("m", "w"))]
    row = rows.agg(F.count("*").alias("_rows"),
                   F.approx_count_distinct(F.struct(*key_names)).alias("_distinct"),
                   *[F.sum(s).alias(s) for s in stats],
                   *([F.avg("m").alias("m")] if target else [])).first()
    if not row["_rows"]:
        raise ValueError("no rows to learn from")
    if collapse_rows is None:
        collapse_rows = worth_collapsing(row["_rows"], row["_distinct"])
    if collapse_rows and target:
        table = rows.groupBy(*key_names).agg(*[F.sum(s).alias(s) for s in stats], F.avg("m").alias("m"),
                                             F.when(F.min("m") < F.max("m"), F.var_pop("m") * F.count("*")).otherwise(0.0).alias("w"))
    else:
        table = collapse(rows, key_names, {s: F.col(s) for s in stats}) if collapse_rows else rows
    table = kept(table)
    cuts = {}
    if row["_distinct"] > max_distinct:
        cuts = quantile_cuts(table, features, max_distinct, buckets)
    return Training(table, list(features), list(stats), {s: row[s] for s in [*stats, *(["m"] if target else [])]}, cuts, row["_distinct"])


def centred(table: DataFrame, centre: Column) -> DataFrame:
    """``s`` and ``q``: sum and sum of squares of the targets around ``centre``, from n, m and w."""
    off = F.col("m") - centre
    return table.withColumns({"s": F.col("n") * off, "q": F.col("w") + F.col("n") * off * off})


def histogram(table: DataFrame, features: list, sums: list, cuts: dict) -> DataFrame:
    """(node, feature index, value, bucket) with summed statistics."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value"),
                 bucket_of(F.col(f), cuts.get(f)).alias("bucket"))
        for i, f in enumerate(features)])
    return (
        table.select("node", F.explode(pairs).alias("p"), *sums)
        .groupBy("node", F.col("p.feature").alias("feature"), F.col("p.value").alias("value"),
                 F.col("p.bucket").alias("bucket"))
        .agg(*[F.sum(s).alias(s) for s in sums]))


def ordered_histogram(table: DataFrame, features: list, sums: list, cuts: dict) -> DataFrame:
    return ordered_totals(histogram(table, features, sums, cuts), ["node", "feature"], "value", sums, bool(cuts))


def split_point(edges: bool) -> Column:
    """Midpoint of adjacent values; with ``edges`` the lowest value stands for the first gap.

    The highest value as a candidate leaves the right side empty and never
    improves a node, so it is listed by ``split_candidates`` but never chosen.
    """
    middle = (F.col("value") + F.col("nxt")) / 2.0
    return F.when(F.col("value") == F.col("lowest"), F.col("value")).otherwise(middle) if edges else middle


def split_candidates(df: DataFrame, features: list, edges: bool = True, max_distinct: int = 100_000,
                     buckets: int = 256) -> DataFrame:
    """(feature, point): midpoints of adjacent distinct values, and first and last value."""
    table = df.select(F.lit(1).alias("node"), *[required(f).alias(f) for f in features], F.lit(1.0).alias("n"))
    t = ordered_histogram(table, features, ["n"], quantile_cuts(table, features, max_distinct, buckets))
    middle = F.when(F.col("nxt").isNotNull(), (F.col("value") + F.col("nxt")) / 2.0)
    points = F.array(middle)
    if edges:
        points = F.array(
            F.when(F.col("value") == F.col("lowest"), F.col("value")), middle,
            F.when(F.col("nxt").isNull(), F.col("value")))
    names = F.array(*[F.lit(f) for f in features])
    return t.select(F.get(names, F.col("feature")).alias("feature"), F.explode(F.array_compact(points)).alias("point")).distinct()


class Variance:
    """Squared error: statistics n, s (sum) and q (sum of squares)."""

    @staticmethod
    def loss(get):
        n, s, q = get("n"), get("s"), get("q")
        return F.greatest(q - s * s / F.nullif(n, F.lit(0.0)), F.lit(0.0))

    @staticmethod
    def number(t):
        return max(t["q"] - t["s"] * t["s"] / t["n"], 0.0)

    @staticmethod
    def size(t):
        return t["n"]


class ClassCounts:
    """Gini or entropy over per-class counts k0..kC-1, times the node size."""

    def __init__(self, kind: str, classes: int):
        if kind not in ("gini", "entropy"):
            raise KeyError(kind)
        self.kind = kind
        self.names = [f"k{i}" for i in range(classes)]

    def loss(self, get):
        counts = [get(k) for k in self.names]
        n = sum(counts[1:], counts[0])
        return impurity(self.kind, counts, n) * n

    def number(self, t):
        n = self.size(t)
        shares = [t[k] / n for k in self.names]
        if self.kind == "gini":
            return n * (1.0 - sum(p * p for p in shares))
        return n * max(0.0, -sum(p * math.log2(p + 1e-9) for p in shares))

    def size(self, t):
        return sum(t[k] for k in self.names)


def impurity(kind: str, counts: list, n: Column) -> Column:
    """1 - sum p^2, or -sum p log2(p + 1e-9) floored at 0; 0 for an empty side."""
    shares = [c / F.nullif(n, F.lit(0.0)) for c in counts]
    if kind == "gini":
        value = F.lit(1.0) - sum([p * p for p in shares[1:]], shares[0] * shares[0])
    else:
        terms = [p * F.log2(p + F.lit(1e-9)) for p in shares]
        value = F.greatest(-sum(terms[1:], terms[0]), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def node_impurity(df: DataFrame, node: str, label: str, classes: list, target: str) -> DataFrame:
    """Per node: gini and entropy of the label; mean, population variance and size of the target."""
    counts = [F.sum(F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0)) for c in classes]
    n = F.count("*").cast("double")
    return df.groupBy(node).agg(
        F.count("*").alias("n"), impurity("gini", counts, n).alias("gini"), impurity("entropy", counts, n).alias("entropy"),
        F.avg(target).alias("mean"), F.var_pop(target).alias("variance"))


def scored_splits(table: DataFrame, features: list, criterion, sums: list, cuts: dict, edges: bool) -> DataFrame:
    """Every candidate of every node with its loss and rounded share of loss removed."""
    t = ordered_histogram(table, features, sums, cuts).filter(F.col("nxt").isNotNull())
    left = criterion.loss(lambda s: F.col(f"c_{s}"))
    right = criterion.loss(lambda s: F.col(f"t_{s}") - F.col(f"c_{s}"))
    parent = criterion.loss(lambda s: F.col(f"t_{s}"))
    return (
        t.withColumn("point", split_point(edges)).withColumn("loss", left + right).withColumn("parent_loss", parent)
        .withColumn("share", F.lit(1.0) - F.col("loss") / F.nullif(F.col("parent_loss"), F.lit(0.0)))
        .withColumn("gain", F.round("share", TIE_DIGITS)))


def best_splits(table: DataFrame, features: list, criterion, sums: list, cuts: dict = None, edges: bool = False) -> DataFrame:
    """The winner per node; ties go to the first feature, then the lowest point.

    A node without an improving split gives no row.
    """
    scored = scored_splits(table, features, criterion, sums, cuts or {}, edges).filter(F.col("share") > IMPROVES)
    best = F.min(F.struct(
        (-F.col("gain")).alias("cost"), "feature", "point", "gain", "loss", "parent_loss",
        *[f"c_{s}" for s in sums], *[f"t_{s}" for s in sums])).alias("b")
    return scored.groupBy("node").agg(best).select("node", "b.*").drop("cost")


def best_weighted_stump(table: DataFrame, features: list, cuts: dict = None) -> DataFrame:
    """Lowest weighted error over thresholds (the values) and both directions.

    ``wp`` and ``wn`` hold the weight of the +1 and -1 rows. Direction ``lt``
    answers -1 at or below the threshold, ``gt`` answers -1 above it.
    """
    t = ordered_histogram(table.withColumn("node", F.lit(1)), features, ["wp", "wn"], cuts or {})
    weight = F.nullif(F.col("t_wp") + F.col("t_wn"), F.lit(0.0))
    lt = (F.col("c_wp") + F.col("t_wn") - F.col("c_wn")) / weight
    gt = (F.col("c_wn") + F.col("t_wp") - F.col("c_wp")) / weight
    both = F.explode(F.array(
        F.struct(lt.alias("error"), F.lit(0).alias("gt")), F.struct(gt.alias("error"), F.lit(1).alias("gt"))))
    best = F.min(F.struct(F.round("e.error", TIE_DIGITS).alias("cost"), "feature", F.col("value").alias("threshold"),
                          F.col("e.gt").alias("gt"), F.col("e.error").alias("error"))).alias("b")
    return t.select("feature", "value", both.alias("e")).agg(best).select("b.*").drop("cost")


def best_split(df: DataFrame, features: list, target: str, criterion: str = "variance", node: str = None,
               edges: bool = False, max_distinct: int = 100_000, buckets: int = 256) -> DataFrame:
    """(node, feature, point, gain, loss, parent_loss): the best split of every group of rows."""
    group = F.col(node).cast("long") if node else F.lit(1).cast("long")
    if criterion == "variance":
        mean = df.agg(F.avg(required(target)).alias("m")).first()["m"]
        y = required(target) - F.lit(mean)
        rule, stats = Variance, {"n": F.lit(1.0), "s": y, "q": y * y}
    else:
        classes = distinct_labels(df, target)
        rule = ClassCounts(criterion, len(classes))
        stats = {k: F.when(F.col(target) == F.lit(c), 1.0).otherwise(0.0) for k, c in zip(rule.names, classes)}
    rows = df.select(group.alias("node"), *[required(f).alias(f) for f in features], *[c.alias(s) for s, c in stats.items()])
    names = F.array(*[F.lit(f) for f in features])
    cuts = quantile_cuts(rows, features, max_distinct, buckets)
    return best_splits(rows, features, rule, list(stats), cuts, edges).select(
        "node", F.get(names, F.col("feature")).alias("feature"), "point", "gain", "loss", "parent_loss")
