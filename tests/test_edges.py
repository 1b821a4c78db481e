"""Empty, constant, null, unseen and degenerate inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import (
    boosting, kernels, linear, maxent, metrics, mixture, naive_bayes, neighbors, prep, sequence, splits, trees)
from tabulearn.sources import text as lines


def xy(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"x double, y {kind}")


def test_null_feature_is_refused(spark):
    df = xy(spark, [(1.0, "a"), (None, "b"), (3.0, "a")], "string")
    with pytest.raises(Exception, match="null in feature column x"):
        naive_bayes.gaussian_nb_fit(df, ["x"], "y")
    with pytest.raises(Exception, match="null in feature column x"):
        trees.tree_classify_fit(df, ["x"], "y")


def test_null_label_is_refused(spark):
    with pytest.raises(ValueError, match="null in label"):
        trees.tree_classify_fit(xy(spark, [(1.0, "a"), (2.0, None)], "string"), ["x"], "y")


def test_empty_input_is_refused(spark):
    none = xy(spark, [])
    for fit in (lambda: trees.tree_regress_fit(none, ["x"], "y"), lambda: naive_bayes.gaussian_nb_fit(none, ["x"], "y"),
                lambda: boosting.adaboost_fit(none, ["x"], "y"), lambda: mixture.gmm_fit(none, "x", mixture.MixtureModel([1.0], [0.0], [1.0])),
                lambda: neighbors.knn_join(none, none, "x", "x", ["x"], 1)):
        with pytest.raises(ValueError):
            fit()


def test_one_row_and_constant_target(spark):
    assert len(trees.tree_regress_fit(xy(spark, [(1.0, 2.0)]), ["x"], "y").nodes) == 1
    t = trees.tree_regress_fit(xy(spark, [(float(i), 1e9) for i in range(20)]), ["x"], "y")
    assert len(t.nodes) == 1 and t.values[1] == 1e9
    flat = xy(spark, [(1.0, float(i)) for i in range(5)])
    assert len(trees.tree_regress_fit(flat, ["x"], "y").nodes) == 1
    assert boosting.stump_regress_fit(flat, ["x"], "y", 3).stumps == []


def test_one_class(spark):
    one = xy(spark, [(1.0, "a"), (2.0, "a")], "string")
    t = trees.tree_classify_fit(one, ["x"], "y")
    assert len(t.nodes) == 1 and t.predict(one).filter("prediction = 'a'").count() == 2
    for fit in (boosting.adaboost_fit, linear.logistic_fit, linear.perceptron_fit, kernels.svm_linear_fit):
        with pytest.raises(ValueError):
            fit(one, ["x"], "y")


def test_zero_variance_names_the_feature(spark):
    df = xy(spark, [(1.0, "a"), (1.0, "a"), (2.0, "b"), (3.0, "b")], "string")
    with pytest.raises(ValueError, match="feature x has no variance in class a"):
        naive_bayes.gaussian_nb_fit(df, ["x"], "y")
    assert naive_bayes.gaussian_nb_fit(df, ["x"], "y", var_floor=0.1).var[0] == [0.1]


def test_tie_between_features_takes_the_first(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i > 2)) for i in range(6)], "b double, a double, y double")
    row = splits.best_split(df, ["b", "a"], "y").first()
    assert (row["feature"], row["point"]) == ("b", 2.5)


def test_thresholds_of_the_classification_tree(spark):
    df = xy(spark, [(float(i), "ab"[i % 2]) for i in range(8)], "string")
    assert len(trees.tree_classify_fit(df, ["x"], "y", min_samples=100).nodes) == 1
    assert len(trees.tree_classify_fit(df, ["x"], "y", min_impurity=0.6).nodes) == 1
    with pytest.raises(KeyError):
        trees.tree_classify_fit(df, ["x"], "y", criterion="other")


def test_entropy_differs_from_gini(spark):
    out = splits.node_impurity(spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "g int, y string, v double"), "g", "y", ["a", "b"], "v").first()
    assert out["gini"] == pytest.approx(4 / 9)
    assert out["entropy"] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3), abs=1e-6)


def test_unseen_token_and_threshold_binarise(spark):
    df = spark.createDataFrame([(1, "aa aa bb", "u"), (2, "bb cc", "v"), (3, "cc cc cc", "v")], "id long, text string, y string")
    counts = prep.bag_of_words(df, "id", "text", ["y"])
    model = naive_bayes.bernoulli_nb_fit(df, counts, "y", threshold=1.0)
    lp = {(r["label"], r["token"]): math.exp(r["log_prob"]) for r in model.log_prob().collect()}
    assert lp[("u", "aa")] == pytest.approx(2 / 3) and lp[("u", "bb")] == pytest.approx(1 / 3) and lp[("v", "cc")] == pytest.approx(2 / 4)
    probe = spark.createDataFrame([(9, "zz zz")], "id long, text string")
    proba = model.predict_log_proba(probe, prep.bag_of_words(probe, "id", "text"), "id").collect()
    assert sum(r["proba"] for r in proba) == pytest.approx(1.0)


def test_equal_coin_starts(spark):
    with pytest.raises(ValueError):
        mixture.coin_em_fit(spark.createDataFrame([(5, 10)], "h int, n int"), "h", "n", 0.5, 0.5)


def test_unknown_symbol(spark):
    df = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "q")], "s int, t int, id long, o string")
    with pytest.raises(Exception, match="outside the dictionary"):
        sequence.pack_sequences(df, "s", ["t"], "id", "o", ["a", "b"])


def test_long_sequence_does_not_underflow(spark):
    df = spark.range(5000).select(F.lit(0).alias("s"), F.col("id").alias("t"), "id", (F.col("id") % 2).cast("int").alias("o"))
    p = sequence.HmmParams.of([0, 1], [0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [[0.8, 0.2], [0.3, 0.7]])
    runs = sequence.pack_sequences(df, "s", ["t"], "id", "o", [0, 1], partitions=1)
    like = sequence.log_likelihood(runs, p).first()["log_likelihood"]
    assert -5000 < like < -2000 and math.isfinite(like)
    assert sequence.hmm_decode(runs, p).count() == 5000


def test_constant_target_r2_is_null(spark):
    assert metrics.r2(xy(spark, [(1.0, 1.0), (2.0, 1.0)]), "y", "x").first()["r2"] is None


def test_unknown_kernel_and_solver(spark):
    df = spark.createDataFrame([(1, [1.0])], "sv_id long, x array<double>")
    with pytest.raises(Exception, match="no such kernel"):
        kernels.kernel_rows(df, df, "sv_id", "x", kind="poly").count()
    with pytest.raises(KeyError):
        linear.logistic_fit(xy(spark, [(1.0, 1.0)]), ["x"], "y", solver="other")


def test_char_ngrams_of_short_words(spark):
    df = spark.createDataFrame([(1, "I am")], "id long, text string")
    got = {r["token"]: r["n"] for r in prep.char_ngrams(df, "id", "text", 4, 5).collect()}
    assert got == {" i ": 1, " am ": 1}
    got = {r["token"]: r["n"] for r in prep.char_ngrams(df, "id", "text", 1, 3).collect()}
    assert got == {" ": 4, "i": 1, " i": 1, "i ": 1, " i ": 1, "a": 1, "m": 1, " a": 1, "am": 1, "m ": 1, " am": 1, "am ": 1}


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1.0\t2.5\t1\n3.0\t0.0\t0\n")
    assert [tuple(r) for r in lines.read_labeled_tsv(spark, str(tmp_path / "t.tsv"), 2).collect()] == [(1.0, 2.5, 1.0), (3.0, 0.0, 0.0)]
    (tmp_path / "w.txt").write_text("1   2  0\n3 0   4\n")
    got = prep.impute_mean(lines.read_labeled_ws(spark, str(tmp_path / "w.txt"), 2), ["f0", "f1", "label"])
    assert [tuple(r) for r in got.collect()] == [(1.0, 2.0, 2.0), (3.0, 1.0, 4.0)]
    (tmp_path / "p.csv").write_text("0,255,51\n3,0,102\n")
    assert [(r["label"], r["pixels"]) for r in lines.read_labeled_pixels(spark, str(tmp_path / "p.csv")).collect()] == [
        (1, [1.0, 0.2]), (-1, [0.0, 0.4])]
    (tmp_path / "c.txt").write_text("doc1 some text here\nx0 more\n")
    assert [tuple(r) for r in lines.read_labeled_text(spark, str(tmp_path / "c.txt")).collect()] == [("1", "some text here"), ("0", "more")]
    (tmp_path / "y.txt").write_text("yes sunny hot\nno rain\n")
    assert [tuple(r) for r in lines.read_labeled_text(spark, str(tmp_path / "y.txt"), yes_no=True).collect()] == [("1", "sunny hot"), ("0", "rain")]
    with pytest.raises(Exception, match="wrong number of fields"):
        lines.read_labeled_tsv(spark, str(tmp_path / "t.tsv"), 5).collect()


def test_random_split_and_grid(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    train, held = prep.random_split(df, 0.25, seed=1)
    assert train.count() + held.count() == 200 and train.join(held, "id").count() == 0

    def fit(t, depth):
        return trees.tree_classify_fit(t, ["x"], "y", max_depth=depth)

    def score(m, h):
        return metrics.accuracy(m.predict(h), "y", "prediction").first()["accuracy"]

    best = prep.grid_search(df, fit, score, {"depth": [0, 1]}, "id", 3)
    assert best[0][0] == {"depth": 1} and best[0][1] == 1.0


def test_impute_without_missing(spark):
    df = xy(spark, [(0.0, 1.0), (4.0, 1.0)])
    assert [r["x"] for r in prep.impute_mean(df, ["x"], include_missing=False).collect()] == [4.0, 4.0]
    assert [r["x"] for r in prep.impute_mean(df, ["x"]).collect()] == [2.0, 4.0]


def test_maxent_separates_topics(spark):
    docs = [(i, ("sunny hot" if i % 3 else "rain cool") + (" windy" if i % 2 else ""), i % 3 > 0) for i in range(30)]
    df = spark.createDataFrame(docs, "id long, text string, y boolean")
    counts = prep.bag_of_words(df, "id", "text", ["y"])
    m = maxent.maxent_fit(df, counts, "id", "y", max_iter=12, eps=1e-4)
    assert m.predict(df, counts, "id").join(df, "id").filter("prediction <> y").count() == 0
    # The grand total makes the first step smaller than eps.
    slow = maxent.maxent_fit(df, counts, "id", "y", step_total=True, eps=0.5)
    assert slow.converged and slow.iterations == 1


def test_lbfgs_is_stationary(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    y = np.where(x[:, 0] + rng.normal(0, 1.5, 300) > 0, "p", "n")
    df = spark.createDataFrame([(r.tolist(), v) for r, v in zip(x, y)], "x array<double>, y string")
    classes, w = maxent.maxent_fit_lbfgs(df, "x", "y", tol=1e-9)
    z = np.exp(x @ w.T)
    p = z / z.sum(1, keepdims=True)
    truth = (y[:, None] == np.array(classes)).astype(float)
    assert np.abs((truth - p).T @ x / 300).max() < 1e-4


def test_scoring_takes_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), "ab"[i > 5]) for i in range(12)], "id long, x double, y string")
    model = trees.tree_classify_fit(df, ["x"], "y")
    df.write.parquet(str(tmp_path / "in"))
    stream = model.predict(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").filter("prediction = y").count() == 12


def test_tree_deeper_than_a_heap_number(spark):
    """A chain of 70 splits, whose last nodes have heap numbers over 63 bits."""
    nodes, values, at = {}, {}, 1
    for k in range(70):
        nodes[at] = trees.Node(at, {}, 1.0, 2.0, feature=0, point=69.5 - k, mean=0.0)
        nodes[2 * at + 1] = trees.Node(2 * at + 1, {}, 0.0, 1.0, mean=70.0 - k)
        at *= 2
    nodes[at] = trees.Node(at, {}, 0.0, 1.0, mean=0.0)
    tree = trees.Tree(["x"], nodes, {i: n.mean for i, n in nodes.items()})
    df = spark.range(71).select(F.col("id").cast("double").alias("x"))
    assert all(r["x"] == r["prediction"] for r in tree.predict(df).collect())
    table = tree.table(spark).collect()
    assert len({r["node_id"] for r in table}) == 141 and {r["parent_id"] for r in table} - {None} <= {r["node_id"] for r in table}
    assert {r["branch_true"] for r in tree.edges(spark).where("parent_id is not null").collect()} == {True, False}


def test_targets_far_from_the_mean_are_split(spark):
    rows = [(float(i), float(i) if i < 12 else 1e9 + i) for i in range(24)]
    df = spark.createDataFrame(rows, "x double, y double")
    tree = trees.tree_regress_fit(df, ["x"], "y")
    assert len(tree.leaves()) == 24 and all(n.loss == 0 for n in tree.leaves())
    assert [r["prediction"] for r in tree.predict(df).orderBy("x").collect()] == [y for _, y in rows]


def test_null_keys_train(spark):
    df = spark.createDataFrame([(0, 1.0), (None, 2.0), (3, 3.0)], "k long, v double")
    train, held = prep.split_by_key(df, "k", 3, 0)
    assert sorted(r["v"] for r in train.collect()) == [2.0] and sorted(r["v"] for r in held.collect()) == [1.0, 3.0]


def test_components_are_centred(spark):
    df = spark.createDataFrame([(i, [float(i) + 5, 2.0 * i + 7, 3.0]) for i in range(9)], "id long, x array<double>")
    out = [r["pc"] for r in prep.pca(df, "x", 2).collect()]
    assert abs(sum(p[0] for p in out)) < 1e-9 and abs(sum(p[1] for p in out)) < 1e-9 and max(p[0] for p in out) > 5


@pytest.mark.parametrize("options", [{}, {"max_run": 2, "partitions": 2}])
def test_impossible_sequences_have_no_likelihood(spark, options):
    p = sequence.HmmParams.of(("a", "b", "c"), [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3, 0.0], [0.4, 0.6, 0.0]])
    rows = [(s, t, 10 * s + t, o) for s, text in enumerate(["abab", "abcab", "c", "bbba"]) for t, o in enumerate(text)]
    df = spark.createDataFrame(rows, "s long, t int, id long, o string")
    runs = sequence.pack_sequences(df, "s", ["t"], "id", "o", p.symbols, **options)
    ahead = {r["seq"]: r["log_likelihood"] for r in sequence.log_likelihood(runs, p).collect()}
    back = {r["seq"]: r["log_likelihood"] for r in sequence.backward_log_likelihood(runs, p).collect()}
    assert ahead[1] == ahead[2] == back[1] == back[2] == float("-inf")
    assert ahead[0] == pytest.approx(back[0]) and ahead[3] == pytest.approx(back[3]) and ahead[0] > -10
    possible = sequence.pack_sequences(df.where("s in (0, 3)"), "s", ["t"], "id", "o", p.symbols)
    got, want = sequence.expected_counts(runs, p), sequence.expected_counts(possible, p)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_queries_that_visit_every_cell_are_handed_on_in_small_batches(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    cells = neighbors.Cells(x[:64], np.full(64, 8), np.full(64, 9.0), np.full(64, 9.0))
    monkeypatch.setattr(neighbors, "ROUTED", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(list(x))], ["qid", "x"])
    got = list(neighbors.routed_batches([batch], cells, 3))
    assert max(b.num_rows for b in got) <= 50 and sum(b.num_rows for b in got) == 500 * 64
