"""Gaussian, multinomial and Bernoulli naive Bayes.

The Gaussian model is a few numbers per class and scores as a projection over
literals. The two count models work on long tables (id, token, n): their
vocabulary grows with the data, so the model stays a table with one row per
token and an array of per-class logs, joined on the token with a salt.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import (
    argmax_label, distinct_labels, label_array, literal_array, log_sum_exp, required)
from tabulearn.functions.tables import keyed_join
from tabulearn.session import checkpointed


def per_class_rows(scored: DataFrame, keep: list, classes: list, label: str = "label") -> DataFrame:
    """From the per-class array ``jll`` to one row per class: jll, log_proba, proba."""
    with_norm = scored.withColumn("_norm", log_sum_exp(F.col("jll")))
    return (
        with_norm.select(*keep, "_norm", F.explode(F.arrays_zip(label_array(classes).alias("label"), "jll")).alias("r"))
        .select(*keep, F.col("r.label").alias(label), F.col("r.jll").alias("jll"),
                (F.col("r.jll") - F.col("_norm")).alias("log_proba"),
                F.exp(F.col("r.jll") - F.col("_norm")).alias("proba")))


@dataclass
class GaussianModel:
    features: list
    classes: list
    prior: list
    mean: list
    var: list

    def params(self, spark) -> DataFrame:
        rows = [(c, f, self.prior[i], self.mean[i][j], self.var[i][j])
                for i, c in enumerate(self.classes) for j, f in enumerate(self.features)]
        kind = "string" if isinstance(self.classes[0], str) else "double" if isinstance(self.classes[0], float) else "long"
        return spark.createDataFrame(rows, f"label {kind}, feature string, prior double, mean double, var double")

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``jll``: per class log prior + log density, in class order."""
        per_class = []
        for prior, mean, var in zip(self.prior, self.mean, self.var):
            col = F.lit(math.log(prior) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in var))
            for f, m, v in zip(self.features, mean, var):
                d = required(f) - F.lit(m)
                col = col - F.lit(0.5) * d * d / F.lit(v)
            per_class.append(col)
        return df.withColumn("jll", F.array(*per_class))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.score(df).withColumn(out, argmax_label(F.col("jll"), self.classes)).drop("jll")

    def predict_log_proba(self, df: DataFrame, keep: list) -> DataFrame:
        return per_class_rows(self.score(df), keep, self.classes)


def _checked_var(var, feature, label, floor):
    if var is None or var <= 0.0:
        if floor <= 0.0:
            raise ValueError(f"feature {feature} has no variance in class {label}; set var_floor")
        return floor
    return max(var, floor)


def gaussian_nb_fit(df: DataFrame, features: list, label: str, var_floor: float = 0.0) -> GaussianModel:
    """Class priors, per-class means and population variances, in one aggregate job."""
    rows = df.groupBy(label).agg(
        F.count("*").alias("n"),
        *[F.avg(required(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(required(f)).alias(f"v{i}") for i, f in enumerate(features)])
    rows = sorted(rows.collect(), key=lambda r: r[label])
    if not rows:
        raise ValueError("no rows to learn from")
    n = sum(r["n"] for r in rows)
    return GaussianModel(
        list(features), [r[label] for r in rows], [r["n"] / n for r in rows],
        [[r[f"m{i}"] for i in range(len(features))] for r in rows],
        [[_checked_var(r[f"v{i}"], f, r[label], var_floor) for i, f in enumerate(features)] for r in rows])


def gaussian_nb_cross_validate(df: DataFrame, features: list, label: str, key: str, folds: int) -> DataFrame:
    """Accuracy per fold with two jobs for all folds.

    Moments per (fold, class) merge exactly, so the model that leaves out a
    fold is the merge of the other folds' moments. Rows with a null key train
    every fold and are held out of none.
    """
    fold = F.pmod(F.col(key), F.lit(folds)).cast("int")
    base = df.withColumn("fold", fold)
    rows = base.groupBy("fold", label).agg(
        F.count("*").alias("n"),
        *[F.avg(required(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(required(f)).alias(f"v{i}") for i, f in enumerate(features)]).collect()
    models = [_merged_model([r for r in rows if r["fold"] != held], features, label) for held in range(folds)]
    classes = sorted({c for m in models for c in m.classes})
    # The parameters of the row's own fold, looked up in literal arrays: one
    # pass over the rows scores every fold.
    per_class = []
    for c in classes:
        at = [m.classes.index(c) if c in m.classes else None for m in models]
        col = F.get(literal_array([
            -math.inf if i is None else math.log(m.prior[i]) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in m.var[i])
            for m, i in zip(models, at)]), "fold")
        for j, f in enumerate(features):
            d = required(f) - F.get(literal_array([0.0 if i is None else m.mean[i][j] for m, i in zip(models, at)]), "fold")
            col = col - F.lit(0.5) * d * d / F.get(
                literal_array([1.0 if i is None else m.var[i][j] for m, i in zip(models, at)]), "fold")
        per_class.append(col)
    scored = base.filter("fold IS NOT NULL").withColumn("jll", F.array(*per_class))
    return scored.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.avg(argmax_label(F.col("jll"), classes).eqNullSafe(F.col(label)).cast("int")).alias("accuracy"))


def _merged_model(rows, features, label):
    merged = {}
    for r in rows:
        n0, mean0, sq0 = merged.get(r[label], (0, [0.0] * len(features), [0.0] * len(features)))
        n = n0 + r["n"]
        mean, sq = [], []
        for i in range(len(features)):
            gap = r[f"m{i}"] - mean0[i]
            mean.append(mean0[i] + gap * r["n"] / n)
            sq.append(sq0[i] + r[f"v{i}"] * r["n"] + gap * gap * n0 * r["n"] / n)
        merged[r[label]] = (n, mean, sq)
    classes = sorted(merged)
    n_all = sum(m[0] for m in merged.values())
    return GaussianModel(
        list(features), classes, [merged[c][0] / n_all for c in classes], [merged[c][1] for c in classes],
        [[_checked_var(q / merged[c][0], f, c, 0.0) for q, f in zip(merged[c][2], features)] for c in classes])


@dataclass
class CountModel:
    """Per-token class logs ``lp`` as a table; class priors and constants as numbers."""

    classes: list
    log_prior: list
    base: list
    tokens: DataFrame
    binary_above: float = None

    def log_prob(self) -> DataFrame:
        """(label, token, log_prob)"""
        return (
            self.tokens.select("token", F.explode(F.arrays_zip(label_array(self.classes).alias("label"), "log_prob")).alias("r"))
            .select(F.col("r.label").alias("label"), "token", F.col("r.log_prob").alias("log_prob")))

    def score(self, docs: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
        """(id, jll): documents without a known token keep the prior."""
        if self.binary_above is None:
            amount = F.col("n").cast("double")
        else:
            amount = F.lit(1.0)
            counts = counts.filter(F.col("n") > F.lit(self.binary_above))
        k = len(self.classes)
        known = keyed_join(counts.select(id_col, "token", "n"), self.tokens.select("token", "weight"),
                            "token", F.col(id_col), salts=1)
        parts = known.select(id_col, *[(amount * F.element_at("weight", i + 1)).alias(f"s{i}") for i in range(k)])
        empty = docs.select(id_col, *[F.lit(0.0).alias(f"s{i}") for i in range(k)])
        return parts.unionByName(empty).groupBy(id_col).agg(
            F.array(*[F.sum(f"s{i}") + F.lit(p + b) for i, (p, b) in enumerate(zip(self.log_prior, self.base))]).alias("jll"))

    def predict(self, docs: DataFrame, counts: DataFrame, id_col: str, out: str = "prediction") -> DataFrame:
        return self.score(docs, counts, id_col).select(id_col, argmax_label(F.col("jll"), self.classes).alias(out))

    def predict_log_proba(self, docs: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
        return per_class_rows(self.score(docs, counts, id_col), [id_col], self.classes)


def _class_sizes(docs, label):
    classes = distinct_labels(docs, label)
    sizes = {r[label]: r["n"] for r in docs.groupBy(label).agg(F.count("*").alias("n")).collect()}
    return classes, [sizes[c] for c in classes]


def _token_table(counts, label, classes, value):
    """One row per token with an array of per-class sums; a class without it has 0."""
    return checkpointed(counts.groupBy("token").agg(
        F.array(*[F.sum(F.when(F.col(label) == F.lit(c), value).otherwise(0.0)) for c in classes]).alias("by_class")))


def multinomial_nb_fit(docs: DataFrame, counts: DataFrame, label: str, alpha: float = 1.0) -> CountModel:
    """Unsmoothed log priors; log((count + alpha) / sum over the vocabulary).

    ``docs`` has the label of every document, ``counts`` (id, label, token, n).
    """
    classes, sizes = _class_sizes(docs, label)
    table = _token_table(counts, label, classes, F.col("n").cast("double"))
    k = len(classes)
    row = table.agg(F.count("*").alias("v"), *[F.sum(F.element_at("by_class", i + 1)).alias(f"t{i}") for i in range(k)]).first()
    logs = [math.log(row[f"t{i}"] + alpha * row["v"]) if row["v"] else 0.0 for i in range(k)]
    lp = F.zip_with("by_class", literal_array(logs), lambda n, t: F.log(n + F.lit(alpha)) - t)
    tokens = table.select("token", lp.alias("log_prob"), lp.alias("weight"))
    n = sum(sizes)
    return CountModel(classes, [math.log(s / n) for s in sizes], [0.0] * k, tokens)


def bernoulli_nb_fit(docs: DataFrame, counts: DataFrame, label: str, alpha: float = 1.0,
                     threshold: float = 0.0) -> CountModel:
    """(documents of the class with the token + alpha) / (documents of the class + 2 alpha)."""
    classes, sizes = _class_sizes(docs, label)
    table = _token_table(counts, label, classes, F.when(F.col("n") > F.lit(threshold), 1.0).otherwise(0.0))
    k = len(classes)
    denominators = literal_array([math.log(s + 2.0 * alpha) for s in sizes])
    lp = F.zip_with("by_class", denominators, lambda n, d: F.log(n + F.lit(alpha)) - d)
    tokens = checkpointed(table.select("token", lp.alias("log_prob")).withColumn(
        "absent", F.transform("log_prob", lambda p: F.log(F.lit(1.0) - F.exp(p)))))
    base = tokens.agg(*[F.sum(F.element_at("absent", i + 1)).alias(f"b{i}") for i in range(k)]).first()
    tokens = tokens.withColumn("weight", F.zip_with("log_prob", "absent", lambda p, a: p - a))
    n = sum(sizes)
    return CountModel(classes, [math.log(s / n) for s in sizes], [base[f"b{i}"] or 0.0 for i in range(k)],
                      tokens, threshold)
