"""Grids grown in shared jobs against one fit after another."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import boosting, grids, metrics, prep, trees


def points(spark, n=240, seed=3, wide=False):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 12, n), rng.integers(0, 9, n)
    y = (a > 6) * 4.0 + (b > 4) * 1.5 + rng.normal(0, 0.5, n)
    if wide:
        y = y * 10.0 ** rng.integers(0, 9, n)
    rows = [(i, float(p), float(q), float(v), "xyz"[int(p + q) % 3]) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, c string").repartition(3)


def r2(held, model):
    return model.predict(held).agg(metrics.r2_of("y", "prediction")).first()[0]


@pytest.mark.parametrize("wide", [False, True])
def test_regression_grid_equals_separate_fits(spark, wide):
    df = points(spark, wide=wide)
    grid = {"max_depth": [1, 3, None], "min_samples": [2, 30], "min_impurity": [0.0]}
    found = grids.tree_regress_grid(df, ["a", "b"], "y", grid, "id", 3)
    assert [(tuple(p.values()), f) for p, f, _ in found.scores] == [
        (v, f) for v in itertools.product(*grid.values()) for f in range(3)]
    for params, fold, score in found.scores:
        train, held = prep.split_by_key(df, "id", 3, fold)
        fit = trees.tree_regress_fit(train, ["a", "b"], "y", max_depth=params["max_depth"], min_samples=params["min_samples"])
        assert score == pytest.approx(r2(held, fit), rel=1e-9, abs=1e-9)
    means = found.means()
    assert found.best == means[0][0] and means[0][1] == max(m for _, m in means)
    table = found.table(spark)
    assert table.columns == ["max_depth", "min_samples", "min_impurity", "fold", "score"] and table.where("max_depth is null").count() == 6


def test_impurity_limit_cuts_like_a_fit(spark):
    df = points(spark)
    found = grids.tree_classify_grid(df, ["a", "b"], "c", {"criterion": ["entropy", "gini"], "min_impurity": [0.0, 0.5, 0.6], "max_depth": [2, 4]}, "id", 2)
    for params, fold, score in found.scores:
        train, held = prep.split_by_key(df, "id", 2, fold)
        fit = trees.tree_classify_fit(train, ["a", "b"], "c", params["criterion"], min_impurity=params["min_impurity"], max_depth=params["max_depth"])
        right = fit.predict(held).agg(F.avg((F.col("prediction") == F.col("c")).cast("int"))).first()[0]
        assert score == pytest.approx(right, abs=1e-12)


@pytest.mark.parametrize("every", [2, 10])
def test_stump_grid_equals_separate_fits(spark, every):
    df = points(spark)
    found = grids.stump_grid(df, ["a", "b"], "y", [1, 5, 3], "id", 3, checkpoint_every=every)
    for params, fold, score in found.scores:
        train, held = prep.split_by_key(df, "id", 3, fold)
        fit = boosting.stump_regress_fit(train, ["a", "b"], "y", params["n_estimators"])
        assert score == pytest.approx(r2(held, fit), abs=1e-9)


def test_rounds_that_run_out(spark):
    rows = [(i, float(i % 2), float(i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    found = grids.stump_grid(df, ["a"], "y", [1, 9], "id", 3)
    assert [s for _, _, s in found.scores] == pytest.approx([1.0] * 6)


def test_null_keys_train_and_folds_may_hold_nothing(spark):
    df = points(spark, 90).withColumn("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1))
    found = grids.tree_regress_grid(df, ["a", "b"], "y", {"max_depth": [1, 2]}, "id", 3)
    scores = {(p["max_depth"], f): s for p, f, s in found.scores}
    assert scores[1, 2] is None and scores[2, 2] is None
    for (depth, fold), score in scores.items():
        if fold < 2:
            fit = trees.tree_regress_fit(df.where(f"id is null or id <> {fold}"), ["a", "b"], "y", max_depth=depth)
            assert score == pytest.approx(r2(df.where(f"id = {fold}"), fit), abs=1e-9)
    assert found.means()[0][1] == pytest.approx(max(sum(scores[d, f] for f in (0, 1)) / 2 for d in (1, 2)))


def test_wrong_grids_are_refused(spark):
    df = points(spark, 20)
    for grid in ({"depth": [1]}, {"max_depth": []}):
        with pytest.raises(ValueError):
            grids.tree_regress_grid(df, ["a"], "y", grid, "id", 3)
    with pytest.raises(ValueError):
        grids.tree_regress_grid(df, ["a"], "y", {"max_depth": [1]}, "id", 1)
    with pytest.raises(ValueError):
        grids.tree_regress_grid(df.withColumn("id", F.lit(0)), ["a"], "y", {"max_depth": [1]}, "id", 2)


def test_jobs_do_not_grow_with_folds_or_parameters(spark):
    df = points(spark).cache()
    df.count()
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for folds, depths, least in ((2, [3], [2]), (6, [1, 2, 3], [2, 20, 40])):
        name = f"grid{folds}"
        spark.sparkContext.setJobGroup(name, name)
        grids.tree_regress_grid(df, ["a", "b"], "y", {"max_depth": depths, "min_samples": least}, "id", folds)
        jobs.append(len(tracker.getJobIdsForGroup(name)))
    assert jobs[1] <= jobs[0] + 1
