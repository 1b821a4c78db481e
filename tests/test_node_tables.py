"""Trees as node tables against the trees whose nodes the driver holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import boosting, node_tables, trees
from tabulearn.operators.splits import Variance


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (220, 2)).astype(float)
    y = np.round(3 * (x[:, 0] > 5) + 2 * (x[:, 1] > 7) + 0.1 * rng.integers(0, 9, 220), 3)
    rows = [(i, float(a), float(b), float(c), "abc"[int(c) % 3], "no" if c < 3 else "yes") for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, kind string, two string").repartition(3).cache()


def values(df, column="prediction"):
    return [r[column] for r in df.select("id", column).orderBy("id").collect()]


@pytest.mark.parametrize("small_rows", [25, 10_000])
@pytest.mark.parametrize("max_depth", [2, None])
def test_regression_equals(table, small_rows, max_depth):
    want = trees.tree_regress_fit(table, ["a", "b"], "y", max_depth=max_depth)
    got = node_tables.tree_table_fit(table, ["a", "b"], "y", max_depth=max_depth, small_rows=small_rows)
    assert values(got.predict(table)) == pytest.approx(values(want.predict(table)), abs=1e-9)
    nodes = got.table().collect()
    assert len(nodes) == len(want.nodes) and sum(r["parent_node"] is None for r in nodes) == 1
    assert sorted(round(r["samples"]) for r in nodes) == sorted(round(n.size) for n in want.nodes.values())
    assert bool(got.levels) == (small_rows == 25)
    root = node_tables.subtree_costs(got).where("node = 1").first()
    assert root["leaves"] == len(want.leaves()) and root["loss"] == pytest.approx(want.nodes[1].loss)
    assert root["cost"] == pytest.approx(sum(n.loss for n in want.leaves()), abs=1e-9)


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_classification_equals(table, criterion):
    want = values(trees.tree_classify_fit(table, ["a", "b"], "kind", criterion=criterion, max_depth=3).predict(table))
    for small_rows in (40, 10_000):
        got = node_tables.tree_table_classify_fit(table, ["a", "b"], "kind", criterion=criterion, max_depth=3, small_rows=small_rows)
        assert values(got.predict(table)) == want


def test_boosting_equals(table):
    want = boosting.gbdt_fit(table, ["a", "b"], "two", n_estimators=2, max_depth=None)
    got = node_tables.gbdt_table_fit(table, ["a", "b"], "two", n_estimators=2, small_rows=60)
    assert values(got.score(table), "score") == pytest.approx(values(table.withColumn("score", want.score_column()), "score"), abs=1e-9)
    assert values(got.predict(table)) == values(want.predict(table))


def test_large_nodes_that_cannot_be_split(spark):
    """Equal rows never become few, and a pure node stays one: both are leaves that no task holds."""
    rows = [(i, 1.0, float(i % 2)) for i in range(60)] + [(i, 2.0, 7.0) for i in range(60, 120)]
    df = spark.createDataFrame(rows, "id long, a double, y double").repartition(2)
    tree = node_tables.tree_table_fit(df, ["a"], "y", small_rows=10, collapse_rows=False)
    assert len(tree.levels) == 1 and sorted({round(v, 9) for v in values(tree.predict(df))}) == [0.5, 7.0]
    one = node_tables.tree_table_fit(df.where("a = 2"), ["a"], "y", small_rows=10, collapse_rows=False)
    assert not one.levels and one.table().count() == 1


def test_prediction_keeps_columns_and_nulls(spark, table):
    tree = node_tables.tree_table_fit(table, ["a", "b"], "y", max_depth=3)
    odd = table.limit(5).select("id", "a", F.when(F.col("id") >= 0, F.lit(None)).cast("double").alias("b"), F.array("y").alias("left"), F.lit("x").alias("node"))
    before = odd.schema.simpleString()
    out = tree.predict(odd)
    assert out.columns == [*odd.columns, "prediction"] and odd.schema.simpleString() == before
    assert [r["prediction"] for r in out.collect()] == [None] * 5
    assert tree.predict(odd.limit(0)).count() == 0


def test_many_rows_meet_a_subtree_in_parts(table, monkeypatch):
    tree = node_tables.tree_table_fit(table, ["a", "b"], "y")
    want = values(tree.predict(table))
    monkeypatch.setattr(node_tables, "WALKED", 7)
    assert values(tree.predict(table)) == want


def test_trees_that_may_be_large_have_their_nodes_in_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), float(10 ** (i % 10) + i % 7), "abc"[i % 3]) for i, v in enumerate(np.round(rng.uniform(0, 100, 400), 1))]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    for fit, target in ((trees.tree_regress_fit, "y"), (trees.tree_classify_fit, "c")):
        large, held = fit(df, ["x"], target, held=100), fit(df, ["x"], target, held=None)
        assert isinstance(large, node_tables.NodeTree) and isinstance(held, trees.Tree)
        assert isinstance(fit(df, ["x"], target, held=100, max_depth=4), trees.Tree)
        want = {r["id"]: r["prediction"] for r in held.predict(df).collect()}
        got = {r["id"]: r["prediction"] for r in large.predict(df).collect()}
        assert got == (want if target == "c" else pytest.approx(want, rel=1e-12))


def test_nodes_of_a_level_are_split_together(monkeypatch):
    rng = np.random.default_rng(6)
    n, calls, plain = 5000, [], node_tables.losses
    monkeypatch.setattr(node_tables, "losses", lambda *a: calls.append(1) or plain(*a))
    x = rng.uniform(0, 1, (n, 1))
    stats = {"n": np.ones(n), "m": rng.integers(0, 50, n).astype(float), "w": np.zeros(n)}
    tree = node_tables.grow_rows(node_tables.Rule(["x"], Variance, ["n", "s", "q"]), x, stats, 0)
    at = np.zeros(n, int)
    while (tree["left"][at] >= 0).any():
        at = np.where(tree["left"][at] >= 0, tree["left"][at] + (x[:, 0] > tree["point"][at]), at)
    assert (tree["value"][at] == stats["m"]).all()
    assert len(calls) * 5 < len(tree["left"])
