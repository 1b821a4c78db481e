"""Models written to a folder and read again."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import boosting, dual_svm, kernels, linear, maxent, mixture, naive_bayes, node_tables, quasi_newton, sequence, trees, wide_pca
from tabulearn.sources.models import KINDS, load_model, save_model

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(spark, n=60):
    return spark.createDataFrame(
        [(i, float(i % 7), float(i % 5), float((i % 7 > 3) + i % 2), "uv"[i % 7 > 3]) for i in range(n)], "id long, a double, b double, y double, c string")


def words(spark):
    docs = spark.createDataFrame([(i, "pqr"[i % 3]) for i in range(12)], "id long, c string")
    counts = spark.createDataFrame([(i, t, 1 + i % 2) for i in range(12) for t in (f"w{i % 3}", f"w{i % 4}x", "all")], "id long, token string, n long")
    return docs, counts.join(docs, "id")


def again(spark, model, folder):
    save_model(spark, model, str(folder))
    return load_model(spark.newSession(), str(folder))


def same(a, b, keys):
    a, b = ([tuple(r) for r in df.orderBy(*keys).collect()] for df in (a, b))
    assert a == b and a


FITS = {
    "tree": lambda df: trees.tree_regress_fit(df, ["a", "b"], "y"),
    "tree labels": lambda df: trees.tree_classify_fit(df, ["a", "b"], "c"),
    "pruned": lambda df: trees.prune_sequence(trees.tree_regress_fit(df, ["a", "b"], "y"))[1][1],
    "node tree": lambda df: node_tables.tree_table_classify_fit(df, ["a", "b"], "c", small_rows=10),
    "node ensemble": lambda df: node_tables.gbdt_table_fit(df, ["a"], "c", n_estimators=2, max_depth=2),
    "stumps": lambda df: boosting.stump_regress_fit(df, ["a", "b"], "y", 4),
    "boosted": lambda df: boosting.boosted_trees_fit(df, ["a", "b"], "y", 2, max_depth=2),
    "gbdt": lambda df: boosting.gbdt_fit(df, ["a", "b"], "c", 2),
    "adaboost": lambda df: boosting.adaboost_fit(df, ["b", "a"], "c", 3),
    "gnb": lambda df: naive_bayes.gaussian_nb_fit(df, ["a", "b"], "c"),
    "logistic": lambda df: linear.logistic_fit(df, ["a", "b"], "c", max_iter=3),
    "perceptron": lambda df: linear.perceptron_fit(df, ["a", "b"], "c", max_epochs=2),
    "svm": lambda df: kernels.svm_rbf_fit(df, ["a", "b"], "c", n_components=8, max_iter=3),
}


@pytest.mark.parametrize("name", FITS)
def test_row_models_predict_as_before(spark, tmp_path, name):
    df = rows(spark)
    model = FITS[name](df)
    found = again(spark, model, tmp_path / "m")
    assert type(found) is type(model)
    same(model.predict(df), found.predict(df), ["id"])


@pytest.mark.parametrize("fit", [
    lambda d, c: naive_bayes.multinomial_nb_fit(d, c, "c"), lambda d, c: naive_bayes.bernoulli_nb_fit(d, c, "c"),
    lambda d, c: maxent.maxent_fit(d, c, "id", "c", max_iter=2), lambda d, c: quasi_newton.token_newton_fit(d, c.drop("c"), "id", "c", max_iter=2)])
def test_token_models_score_as_before(spark, tmp_path, fit):
    docs, counts = words(spark)
    model = fit(docs, counts)
    found = again(spark, model, tmp_path / "m")
    same(model.score(docs, counts.drop("c"), "id").select("id", F.transform("jll", lambda v: F.round(v, 9))),
         found.score(docs, counts.drop("c"), "id").select("id", F.transform("jll", lambda v: F.round(v, 9))), ["id"])


def test_other_models_keep_every_number(spark, tmp_path):
    coins = mixture.CoinModel(0.1 + 0.2, 1e-300, 3, True, [(0, 0.5, 0.25), (1, 0.3, 0.1)])
    assert again(spark, coins, tmp_path / "coins") == coins
    gmm = mixture.MixtureModel([0.5, 0.5], [math.inf, -0.0], [1.0, 2.0])
    assert again(spark, gmm, tmp_path / "gmm") == gmm
    hmm = sequence.HmmParams.of(("x", "y"), [0.5, 0.5], [[0.1, 0.9], [0.2, 0.8]], [[0.3, 0.7], [1.0, 0.0]])
    found = again(spark, hmm, tmp_path / "hmm")
    assert found.symbols == hmm.symbols and all(np.array_equal(getattr(found, k), getattr(hmm, k)) for k in ("start", "trans", "emit"))
    x = np.array([[0.0, 1.0], [2.0, 0.5], [3.0, 3.0], [0.2, 0.1]])
    pca = wide_pca.wide_pca_fit(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"), "x", 1)
    found = again(spark, pca, tmp_path / "pca")
    assert np.array_equal(found.components, pca.components) and (found.features, found.passes, found.sparse) == ("x", pca.passes, False)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, x array<double>, y int")
    svm = dual_svm.dual_linear_fit(df, "x", "y", "id")
    found = again(spark, svm, tmp_path / "svm")
    assert (found.b, found.gap, found.converged, found.classes) == (svm.b, svm.gap, svm.converged, svm.classes) and np.array_equal(found.w, svm.w)
    same(svm.support, found.support, ["sv_id"])


@pytest.mark.parametrize("classes", [
    [False, True], [1, 2**70], ["", "é\n"], [datetime.date(2020, 1, 2), datetime.date(2021, 1, 1)], [decimal.Decimal("1.10"), decimal.Decimal("2")],
    [datetime.datetime(2020, 1, 2, 3, 4, 5, 6)], [1.5, -0.0], [1, "a", None, 2.5], []])
def test_class_labels_keep_their_type(spark, tmp_path, classes):
    found = again(spark, naive_bayes.GaussianModel(["a"], classes, [], [[1.0], []], [[]]), tmp_path / "m")
    assert found.classes == classes and [type(c) for c in found.classes] == [type(c) for c in classes]
    assert found.mean == [[1.0], []] and found.prior == []


def test_deep_trees_keep_their_numbers(spark, tmp_path):
    n = 70
    df = spark.createDataFrame([(i, float(i), 4.0 ** i) for i in range(n)], "id long, a double, y double")
    model = trees.tree_regress_fit(df, ["a"], "y")
    assert max(model.nodes) > 2**63
    found = again(spark, model, tmp_path / "m")
    assert sorted(found.nodes) == sorted(model.nodes)
    same(model.predict(df), found.predict(df), ["id"])


def test_wrong_folders_are_refused(spark, tmp_path):
    folder = str(tmp_path / "m")
    docs, counts = words(spark)
    model = naive_bayes.multinomial_nb_fit(docs, counts, "c")
    save_model(spark, model, folder)
    with pytest.raises(ValueError, match="token_nb"):
        load_model(spark, folder, "tree")
    with pytest.raises(Exception, match="(?i)exists"):
        save_model(spark, model, folder)
    with pytest.raises(TypeError):
        save_model(spark, {"not": "a model"}, str(tmp_path / "other"))
    narrow = naive_bayes.CountModel(model.classes, model.log_prior, model.base, model.tokens.select("token", "log_prob"))
    save_model(spark, narrow, str(tmp_path / "narrow"))
    with pytest.raises(ValueError, match="weight is missing"):
        load_model(spark, str(tmp_path / "narrow"))
    with pytest.raises(TypeError):
        save_model(spark, naive_bayes.GaussianModel(["a"], [object()], [], [], []), str(tmp_path / "object"))
    with pytest.raises(Exception):
        load_model(spark, str(tmp_path / "object"))  # nothing whole was written


def test_every_kind_is_a_class_once():
    assert len({id(c) for c in KINDS.values()}) == len(KINDS)


def test_another_process_reads_them(spark, tmp_path):
    df = rows(spark)
    docs, counts = words(spark)
    row, token = boosting.gbdt_fit(df, ["a", "b"], "c", 2), naive_bayes.bernoulli_nb_fit(docs, counts, "c")
    save_model(spark, row, f"{tmp_path}/row")
    save_model(spark, token, f"{tmp_path}/token")
    for name, table in (("rows", df), ("docs", docs), ("counts", counts.drop("c"))):
        table.write.parquet(f"{tmp_path}/{name}")
    script = f"""
from tabulearn.session import local_session
from tabulearn.sources.models import load_model
spark = local_session(2, shuffle_partitions=2)
read = lambda name: spark.read.parquet("{tmp_path}/" + name)
load_model(spark, "{tmp_path}/row").predict(read("rows")).write.parquet("{tmp_path}/row_out")
load_model(spark, "{tmp_path}/token").predict(read("docs"), read("counts"), "id").write.parquet("{tmp_path}/token_out")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, timeout=200, capture_output=True)
    same(row.predict(df), spark.read.parquet(f"{tmp_path}/row_out"), ["id"])
    same(token.predict(docs, counts.drop("c"), "id"), spark.read.parquet(f"{tmp_path}/token_out"), ["id"])
