"""Small cases worked by hand or by a direct computation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import boosting, linear, metrics, mixture, naive_bayes, neighbors, prep, sequence, trees

TOSSES = [[1, 0, 0, 0, 1, 1, 0, 1, 0, 1], [1, 1, 1, 1, 0, 1, 1, 1, 1, 1], [1, 0, 1, 1, 1, 1, 1, 0, 1, 1],
          [1, 0, 1, 0, 0, 0, 1, 1, 0, 0], [0, 1, 1, 1, 0, 1, 1, 1, 0, 1]]


def test_two_coins(spark):
    rows = [(i, v) for i, t in enumerate(TOSSES) for v in t]
    trials = mixture.coin_trials(spark.createDataFrame(rows, "trial int, v int"), "trial", "v")
    model = mixture.coin_em_fit(trials, "heads", "n", 0.999999999, 0.000001)
    a, b = 0.999999999, 0.000001
    for _ in range(model.iterations):
        h = np.array([sum(t) for t in TOSSES])
        la, lb = a ** h * (1 - a) ** (10 - h), b ** h * (1 - b) ** (10 - h)
        pa = la / (la + lb)
        a, b = (pa * h).sum() / (pa * 10).sum(), ((1 - pa) * h).sum() / ((1 - pa) * 10).sum()
    assert model.converged and (model.theta_a, model.theta_b) == pytest.approx((a, b), abs=1e-9)
    assert model.theta_a == pytest.approx(0.797, abs=2e-3) and model.theta_b == pytest.approx(0.520, abs=2e-3)


SERIES = list(zip([float(i) for i in range(1, 11)], [5.56, 5.70, 5.91, 6.40, 6.80, 7.05, 8.90, 8.70, 9.00, 9.05]))


def test_boosted_stumps_series(spark):
    df = spark.createDataFrame(SERIES, "x double, y double")
    model = boosting.stump_regress_fit(df, ["x"], "y", 6, checkpoint_every=2)
    assert [s.point for s in model.stumps] == [6.5, 3.5, 6.5, 4.5, 6.5, 2.5]
    want = [(6.24, 8.91), (-0.52, 0.22), (0.15, -0.22), (-0.16, 0.11), (0.07, -0.11), (-0.15, 0.04)]
    for s, (left, right) in zip(model.stumps, want):
        assert (s.left, s.right) == pytest.approx((left, right), abs=0.015)
    r2 = [r["r2"] for r in boosting.staged_r2(model, df, "y").orderBy("round").collect()]
    assert r2 == sorted(r2)
    loss = model.predict(df).agg(F.sum((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert loss == pytest.approx(0.17, abs=0.01)


def test_adaboost_ten_points(spark):
    ys = [1, 1, 1, -1, -1, -1, 1, 1, 1, -1]
    df = spark.createDataFrame([(float(i), y) for i, y in enumerate(ys)], "x double, y int")
    model = boosting.adaboost_fit(df, ["x"], "y", 3)
    assert [round(s.alpha, 4) for s in model.stumps] == [0.4236, 0.6496, 0.752]
    assert [round(s.error, 4) for s in model.stumps] == [0.3, 0.2143, 0.1818]
    assert model.predict(df).filter("prediction <> y").count() == 0


def test_perfect_stump_is_kept(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 5 else "b") for i in range(10)], "x double, y string")
    model = boosting.adaboost_fit(df, ["x"], "y", 5)
    assert len(model.stumps) == 1 and model.predict(df).filter("prediction <> y").count() == 0


def test_multinomial_toy(spark):
    words = ["S M M S S S M M L L L M M L L".split()[i] for i in range(15)]
    ys = [-1, -1, 1, 1, -1, -1, -1, 1, 1, 1, 1, 1, 1, 1, -1]
    df = spark.createDataFrame([(i, f"{w * 2} v{(i // 5) + 1}", y) for i, (w, y) in enumerate(zip(words, ys))],
                               "id long, text string, y int")
    counts = prep.bag_of_words(df, "id", "text", ["y"])
    model = naive_bayes.multinomial_nb_fit(df, counts, "y", alpha=1.0)
    lp = {(r["label"], r["token"]): r["log_prob"] for r in model.log_prob().collect()}
    # 9 positive rows with 2 words each, 6 distinct words: (4 + 1) / (18 + 6)
    assert lp[(1, "ll")] == pytest.approx(math.log(5 / 24)) and lp[(-1, "ss")] == pytest.approx(math.log(4 / 18))
    assert model.log_prior == pytest.approx([math.log(6 / 15), math.log(9 / 15)])
    probe = spark.createDataFrame([(1, "ss v1"), (2, "unknown"), (3, "")], "id long, text string")
    out = {r["id"]: r["prediction"] for r in model.predict(probe, prep.bag_of_words(probe, "id", "text"), "id").collect()}
    assert out == {1: -1, 2: 1, 3: 1}


PI = [0.2, 0.4, 0.4]
A = [[0.5, 0.2, 0.3], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]]
B = [[0.5, 0.5], [0.4, 0.6], [0.7, 0.3]]


def joint(path, obs):
    p = PI[path[0]] * B[path[0]][obs[0]]
    for s, t, o in zip(path, path[1:], obs[1:]):
        p *= A[s][t] * B[t][o]
    return p


@pytest.mark.parametrize("max_run", [3, 100])
def test_hmm_against_all_paths(spark, max_run):
    seqs = [[0, 1, 0], [0], [1, 1, 0, 0, 1, 0, 1], [1, 0, 1, 1, 1, 0]]
    rows = [(s, t, 100 * s + t, "rw"[o]) for s, seq in enumerate(seqs) for t, o in enumerate(seq)]
    df = spark.createDataFrame(rows, "seq int, t int, id long, obs string")
    p = sequence.HmmParams.of("rw", PI, A, B)
    runs = sequence.pack_sequences(df, "seq", ["t"], "id", "obs", "rw", max_run=max_run)
    like = {r["seq"]: r["log_likelihood"] for r in sequence.log_likelihood(runs, p).collect()}
    back = {r["seq"]: r["log_likelihood"] for r in sequence.backward_log_likelihood(runs, p).collect()}
    path = {r["row_id"]: r["state"] for r in sequence.hmm_decode(runs, p).collect()}
    for s, obs in enumerate(seqs):
        every = {q: joint(q, obs) for q in itertools.product(range(3), repeat=len(obs))}
        assert math.exp(like[s]) == pytest.approx(sum(every.values())) and math.exp(back[s]) == pytest.approx(sum(every.values()))
        found = tuple(path[100 * s + t] for t in range(len(obs)))
        assert every[found] == pytest.approx(max(every.values()))


def test_known_viterbi_path(spark):
    df = spark.createDataFrame([(0, t, o) for t, o in enumerate("rwr")], "seq int, t int, obs string").withColumn("id", F.col("t").cast("long"))
    p = sequence.HmmParams.of("rw", PI, [[0.5, 0.2, 0.3], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]], B)
    runs = sequence.pack_sequences(df, "seq", ["t"], "id", "obs", "rw")
    assert [r["state"] for r in sequence.hmm_decode(runs, p).orderBy("row_id").collect()] == [2, 2, 2]


def test_baum_welch_likelihood_rises(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, 1000 * s + t, int(rng.integers(0, 3))) for s in range(6) for t in range(20 + s)]
    df = spark.createDataFrame(rows, "seq int, t int, id long, obs int")
    runs = sequence.pack_sequences(df, "seq", ["t"], "id", "obs", [0, 1, 2])
    p, last = sequence.random_start([0, 1, 2], 2, seed=5), -math.inf
    for _ in range(5):
        now = sequence.log_likelihood(runs, p).agg(F.sum("log_likelihood")).first()[0]
        assert now >= last - 1e-9
        last = now
        p, _, _ = sequence.hmm_fit(runs, p, max_iter=1)
        assert p.trans.sum(1) == pytest.approx([1, 1]) and p.emit.sum(1) == pytest.approx([1, 1])


def test_mixture_likelihood_rises(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(12, 0.2, 100), rng.normal(11, 6, 900)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    start = mixture.MixtureModel([0.5, 0.5], [12.0, 10.0], [1.0, 30.0])

    def like(m):
        d = sum(a / math.sqrt(2 * math.pi * v) * (np.exp(-(x - u) ** 2 / (2 * v)) + 1e-9) for a, u, v in zip(m.alpha, m.mu, m.var))
        return np.log(d).sum()

    last = like(start)
    for steps in (1, 3, 8):
        m = mixture.gmm_fit(df, "x", start, max_iter=steps, eps=0.0)
        assert like(m) >= last - 1e-6 and sum(m.alpha) == pytest.approx(1)
        last = like(m)
    r = m.responsibilities(df, "x", ["x"]).groupBy("x").agg(F.sum("responsibility").alias("s"))
    assert r.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def tree_by_hand(x, y, depth, edges):
    """Straight recursion over all candidates, as a check of the level-wise fit."""
    def grow(rows, d):
        loss0 = y[rows].var() * len(rows)
        best = None
        for f in range(x.shape[1]):
            vals = np.unique(x[rows, f])
            for i, (a, b) in enumerate(zip(vals, vals[1:])):
                p = a if edges and i == 0 else (a + b) / 2
                left = rows[x[rows, f] <= p]
                right = rows[x[rows, f] > p]
                loss = y[left].var() * len(left) + y[right].var() * len(right)
                if round(1 - loss / loss0, 9) > 0 and (best is None or round(1 - loss / loss0, 9) > best[0]):
                    best = (round(1 - loss / loss0, 9), f, p, left, right)
        if d == depth or len(rows) < 2 or loss0 < 1e-12 or best is None:
            return {rows.tobytes(): y[rows].mean()}, [(None, None)]
        (l, sl), (r, sr) = grow(best[3], d + 1), grow(best[4], d + 1)
        return {**l, **r}, [(best[1], best[2])] + sl + sr

    return grow(np.arange(len(y)), 0)


@pytest.mark.parametrize("edges", [False, True])
def test_regression_tree_against_recursion(spark, edges):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, (60, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 4) * 5 + rng.normal(0, 1, 60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    t = trees.tree_regress_fit(df, ["a", "b", "c"], "y", max_depth=4, edges=edges)
    leaves, splits = tree_by_hand(x, y, 4, edges)
    assert sorted(t.values[n.id] for n in t.leaves()) == pytest.approx(sorted(leaves.values()))
    assert sorted((n.feature, n.point) for n in t.nodes.values() if not n.is_leaf) == sorted(s for s in splits if s[0] is not None)


def test_full_tree_fits_training_data(spark):
    df = spark.createDataFrame(SERIES, "x double, y double")
    t = trees.tree_regress_fit(df, ["x"], "y")
    assert len(t.leaves()) == 10
    assert t.predict(df).filter(F.abs(F.col("y") - F.col("prediction")) > 1e-9).count() == 0


def test_pruning_is_nested_and_monotone(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 30)), float(rng.integers(0, 30)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    steps = trees.prune_sequence(trees.tree_regress_fit(df, ["a", "b"], "y", max_depth=4))
    alphas = [a for a, _ in steps]
    assert alphas == sorted(alphas) and len(steps[-1][1].nodes) == 1
    for (_, big), (_, small) in zip(steps, steps[1:]):
        assert set(small.nodes) < set(big.nodes)
    scores, best = trees.select_subtree(steps, df, "y")
    for k, _, r2 in scores[:3]:
        direct = metrics.r2(steps[k][1].predict(df), "y", "prediction").first()["r2"]
        assert r2 == pytest.approx(direct, abs=1e-9)
    assert best is steps[0][1]
    assert trees.tree_fit_pruned(df, ["a", "b"], "y", "id", 5, max_depth=3).nodes


def test_gbdt_loss_falls(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (200, 2)).astype(float)
    y = np.where(x.sum(1) + rng.normal(0, 2, 200) > 11, "p", "n")
    df = spark.createDataFrame([(*map(float, r), v) for r, v in zip(x, y)], "a double, b double, y string")
    model = boosting.gbdt_fit(df, ["a", "b"], "y", 6, 0.3, max_depth=2, checkpoint_every=2)
    sign = F.when(F.col("y") == "p", 1.0).otherwise(-1.0)
    out = df.withColumn("score", model.score_column())
    losses = []
    for k in range(7):
        part = boosting.GradientBoosted(model.features, model.trees[:k], model.start, model.rate, model.classes)
        losses.append(df.agg(F.avg(F.log1p(F.exp(-sign * part.score_column())))).first()[0])
    assert losses == sorted(losses, reverse=True) and len(set(losses)) == 7
    assert out.count() == 200 and model.predict(df).filter("prediction = y").count() > 150


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    train, query = rng.integers(0, 6, (400, 3)).astype(float), rng.integers(0, 6, (150, 3)).astype(float)
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(train)], "id long, x array<double>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(query)], "qid long, x array<double>")
    for tile in (7, 50, 4096):
        got = {(r["qid"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in neighbors.knn_join(q, t, "qid", "id", "x", 4, tile_rows=tile).collect()}
        assert len(got) == 600
        for i, v in enumerate(query):
            d = np.sqrt(((train - v) ** 2).sum(1))
            order = np.lexsort((np.arange(400), d))[:4]
            assert [got[(i, k + 1)][0] for k in range(4)] == order.tolist()


def test_knn_with_few_rows_and_ties(spark):
    t = spark.createDataFrame([(1, 0.0, "b"), (2, 2.0, "a"), (3, 2.0, "a")], "id long, x double, y string")
    q = spark.createDataFrame([(7, 1.0)], "qid long, x double")
    near = neighbors.knn_join(q, t, "qid", "id", ["x"], 10)
    assert [r["neighbor_id"] for r in near.orderBy("rank").collect()] == [1, 2, 3]
    assert neighbors.knn_predict(near, t, "qid", "id", "y").first()["prediction"] == "a"
    two = neighbors.knn_join(q, t, "qid", "id", ["x"], 2)
    assert neighbors.knn_predict(two, t, "qid", "id", "y").first()["prediction"] == "b"


def test_perceptrons_separate(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(2, 0.3, (30, 2)), rng.normal(-2, 0.3, (30, 2))]
    rows = [(i, *map(float, r), 1 if i < 30 else -1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    for p in (linear.perceptron_fit(df, ["a", "b"], "y"), linear.perceptron_dual_fit(df, ["a", "b"], "y", "id")):
        assert p.converged and p.predict(df).filter("prediction <> y").count() == 0
    mixed = spark.createDataFrame([(0, 1.0, 1), (1, 1.0, -1)], "id long, a double, y int")
    assert not linear.perceptron_fit(mixed, ["a"], "y", max_epochs=5).converged
    assert not linear.perceptron_dual_fit(mixed, ["a"], "y", "id", max_updates=5).converged


def test_auc_and_roc_by_pairs(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a, p in rows for b, n in rows if p == 1 and n == 0]
    assert metrics.auc(df, F.col("y") == 1, "s").first()["auc"] == pytest.approx(np.mean(pairs))
    points = metrics.roc_points(df, F.col("y") == 1, "s").orderBy("threshold").collect()
    assert [v for r in points for v in r] == pytest.approx([0.225, 1.0, 0.5, 0.375, 2 / 3, 0.5, 0.6, 1 / 3, 0.0])
