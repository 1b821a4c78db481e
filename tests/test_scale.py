"""The ways taken by large or skewed data give the results of the plain ways."""

import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulearn.functions import batches, tables
from tabulearn.operators import boosting, dual_svm, kernels, linear, maxent, metrics, naive_bayes, neighbors, prep, quasi_newton, sequence, splits, trees
from tabulearn.plans import catalog
from tabulearn.session import laid_out


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one feature vector; the rest spread over many values."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((900, 1)) < 0.34, 5.0, np.round(rng.normal(0, 50, (900, 2)), 2))
    y = x[:, 0] * 0.3 + (x[:, 1] > 10) * 20 + rng.normal(0, 3, 900)
    rows = [(i, float(a), float(b), float(v), "hi" if v > 5 else "lo") for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, c string").repartition(5).cache()


def splits_of(t):
    return sorted((n.id, n.feature, n.point) for n in t.nodes.values() if not n.is_leaf)


def test_bucketed_split_search_is_exact(skewed):
    plain = trees.tree_regress_fit(skewed, ["a", "b"], "y", max_depth=4)
    spread = trees.tree_regress_fit(skewed, ["a", "b"], "y", max_depth=4, max_distinct=10, buckets=16)
    assert splits_of(plain) == splits_of(spread)
    one = trees.tree_classify_fit(skewed, ["a", "b"], "c", "entropy", max_depth=3)
    two = trees.tree_classify_fit(skewed, ["a", "b"], "c", "entropy", max_depth=3, max_distinct=10, buckets=16)
    assert splits_of(one) == splits_of(two)


@pytest.mark.parametrize("collapse", [True, False])
def test_collapsing_changes_nothing(skewed, collapse):
    base = trees.tree_regress_fit(skewed, ["a", "b"], "y", max_depth=3)
    assert splits_of(trees.tree_regress_fit(skewed, ["a", "b"], "y", max_depth=3, collapse_rows=collapse)) == splits_of(base)
    ada = boosting.adaboost_fit(skewed, ["a", "b"], "c", 4)
    other = boosting.adaboost_fit(skewed, ["a", "b"], "c", 4, collapse_rows=collapse, checkpoint_every=1, max_distinct=10, buckets=8)
    assert [(s.feature, s.threshold, s.gt) for s in ada.stumps] == [(s.feature, s.threshold, s.gt) for s in other.stumps]


def test_checkpoint_interval_changes_nothing(skewed):
    a = boosting.boosted_trees_fit(skewed, ["a", "b"], "y", 4, max_depth=2, checkpoint_every=1)
    b = boosting.boosted_trees_fit(skewed, ["a", "b"], "y", 4, max_depth=2, checkpoint_every=100)
    assert [splits_of(t) for t in a.trees] == [splits_of(t) for t in b.trees]


def test_large_tree_walk_equals_case_when(skewed, monkeypatch):
    t = trees.tree_regress_fit(skewed, ["a", "b"], "y", max_depth=8)
    assert len(t.nodes) > trees.INLINE_NODES
    walk = skewed.select("id", t.value_column().alias("v"), t.node_column().alias("n"))
    monkeypatch.setattr(trees, "INLINE_NODES", 10_000)
    nested = skewed.select("id", t.value_column().alias("w"), t.node_column().alias("m"))
    assert walk.join(nested, "id").filter("v <> w or n <> m or v is null").count() == 0


def test_bucketed_metrics(skewed):
    pos = F.col("c") == "hi"
    assert metrics.auc(skewed, pos, "a").first()[0] == pytest.approx(metrics.auc(skewed, pos, "a", max_distinct=5, buckets=9).first()[0])
    one = [v for r in metrics.roc_points(skewed, pos, "a").orderBy("threshold").collect() for v in r]
    two = [v for r in metrics.roc_points(skewed, pos, "a", max_distinct=5, buckets=9).orderBy("threshold").collect() for v in r]
    assert one == pytest.approx(two)


def test_salted_joins(spark, monkeypatch):
    rows = [(i, "the the " + ("cat sat" if i % 2 else "dog ran off") + f" w{i % 7}", "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y string")

    def run():
        counts = prep.bag_of_words(df, "id", "text", ["y"], min_df=3)
        nb = naive_bayes.multinomial_nb_fit(df, counts, "y").predict_log_proba(df, counts, "id")
        me = maxent.maxent_fit(df, counts, "id", "y", max_iter=3, eps=0.0).table()
        return (sorted(map(tuple, counts.collect())), [r["jll"] for r in nb.orderBy("id", "label").collect()],
                [r["weight"] for r in me.orderBy("token", "label").collect()])

    plain = run()
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    salted = run()
    assert plain[0] == salted[0] and plain[1] == pytest.approx(salted[1]) and plain[2] == pytest.approx(salted[2])


def test_hot_cell_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.r_[np.zeros((150, 4)), rng.normal(0, 5, (250, 4))]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = neighbors.knn_join(df, df, "id", "id", "x", 3, skip_same_id=True, tile_rows=20)
    out = {}
    for r in got.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor_id"])
    for i in range(400):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert out[i] == np.lexsort((np.arange(400), d))[:3].tolist()


def test_tiled_kernel_sums(spark):
    rng = np.random.default_rng(6)
    x, s = rng.normal(0, 1, (50, 3)), rng.normal(0, 1, (40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    sv = spark.createDataFrame([(i, r.tolist(), 1.0 if i % 3 else -1.0, 0.1 * i) for i, r in enumerate(s)],
                               "sv_id long, x array<double>, y double, alpha double")
    want = np.exp(-((x[:, None] - s[None]) ** 2).sum(2) / 4.0) @ np.array([(1.0 if i % 3 else -1.0) * 0.1 * i for i in range(40)]) + 0.3
    for options in ({}, {"max_inline": 1, "tile_rows": 16}):
        got = kernels.decision_function(df, sv, 0.3, "id", "x", sigma=2.0, **options).orderBy("id").collect()
        assert [r["score"] for r in got] == pytest.approx(want.tolist())


@pytest.mark.parametrize("partitions,max_run", [(1, 1 << 16), (6, 1 << 16), (6, 11)])
def test_hot_sequence_is_split(spark, partitions, max_run):
    rng = np.random.default_rng(7)
    sizes = [300, 1, 2, 40, 60, 200]
    rows = [(s, t, 1000 * s + t, int(rng.integers(0, 3))) for s, n in enumerate(sizes) for t in range(n)]
    df = spark.createDataFrame(rows, "seq int, t int, id long, o int").repartition(4)
    p = sequence.random_start([0, 1, 2], 3, seed=2)
    whole = sequence.pack_sequences(df, "seq", ["t"], "id", "o", [0, 1, 2], partitions=1)
    runs = sequence.pack_sequences(df, "seq", ["t"], "id", "o", [0, 1, 2], partitions=partitions, max_run=max_run)
    assert runs.has_split == (partitions > 1) and not whole.has_split

    def values(df, col):
        return [r[col] for r in df.orderBy(*[c for c in df.columns if c != col]).collect()]

    for f, col in ((sequence.forward_table, "log_alpha"), (sequence.backward_table, "log_beta"),
                   (sequence.log_likelihood, "log_likelihood"), (sequence.backward_log_likelihood, "log_likelihood"), (sequence.hmm_decode, "state")):
        assert values(f(runs, p), col) == pytest.approx(values(f(whole, p), col), abs=1e-8)
    a, b = sequence.expected_counts(runs, p), sequence.expected_counts(whole, p)
    for k in a:
        assert np.allclose(a[k], b[k])
    assert a["emit"].sum() == pytest.approx(sum(sizes)) and a["sequences"] == pytest.approx(len(sizes))


def test_partitioning_changes_nothing(skewed):
    a = linear.logistic_fit(skewed, ["a", "b"], "c", 1e-4, max_iter=3).w
    b = linear.logistic_fit(skewed.repartition(17), ["a", "b"], "c", 1e-4, max_iter=3).w
    assert np.allclose(a, b)


def test_job_count_per_round_is_fixed(spark, skewed):
    def jobs(n):
        name = f"rounds{n}"
        spark.sparkContext.setJobGroup(name, name)
        boosting.adaboost_fit(skewed, ["a", "b"], "c", n)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    two, four, six = jobs(2), jobs(4), jobs(6)
    assert four - two == six - four


def test_partial_sums_before_the_shuffle(skewed):
    rows = skewed.select(F.lit(1).alias("node"), "a", "b", F.lit(1.0).alias("n"), F.col("y").alias("s"), (F.col("y") ** 2).alias("q"))
    plan = splits.best_splits(rows, ["a", "b"], splits.Variance, ["n", "s", "q"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan


def test_no_local_checkpoint_and_no_crossjoin():
    found = subprocess.run(["grep", "-rnE", r"localCheckpoint|crossJoin|\.toPandas\(|\.rdd\.map", "tabulearn"], capture_output=True, text=True)
    assert found.stdout == ""


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 8), st.integers(0, 10_000))
def test_tile_search_is_exact(nq, nt, k, seed):
    rng = np.random.default_rng(seed)
    q, t = rng.integers(0, 4, (nq, 2)).astype(float), rng.integers(0, 4, (nt, 2)).astype(float)
    tid = rng.permutation(nt)
    i, j, d = neighbors.nearest_in_tile(np.arange(nq), q, tid, t, k, False)
    for a in range(nq):
        dist = np.sqrt(((t - q[a]) ** 2).sum(1))
        assert j[i == a].tolist() == np.lexsort((tid, dist))[:k].tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(0, 1000))
def test_forward_equals_backward(states, obs, seed):
    p = sequence.random_start([0, 1, 2], states, seed)
    obs = [np.array(o) for o in obs]
    codes, lengths, alpha, scale = sequence.forward(p, obs, [None] * len(obs))
    beta, logs = sequence.backward(p, codes, lengths, [None] * len(obs))
    first = np.log((p.start * p.emit[:, codes[:, 0]].T * beta[:, 0]).sum(1)) + logs[:, 0]
    assert np.allclose(scale.sum(1), first)


def test_tasks_of_word_counts_follow_the_bytes(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(30)), "xy"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, y string").repartition(3).cache()
    plain = [sorted(map(tuple, c.collect())) for c in (prep.bag_of_words(df, "id", "text", min_df=2), prep.char_ngrams(df, "id", "text", min_df=2))]
    monkeypatch.setattr(prep, "TEXT_BYTES", 2000)
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    bytes_of = sum(len(r[1]) for r in rows)
    small = [prep.bag_of_words(df, "id", "text", min_df=2), prep.char_ngrams(df, "id", "text", min_df=2)]
    assert small[0].rdd.getNumPartitions() >= bytes_of // 2000 and small[1].rdd.getNumPartitions() >= 3 * bytes_of // 2000
    assert [sorted(map(tuple, c.collect())) for c in small] == plain


def test_tasks_of_the_vocabulary_are_not_put_together(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j % 20}" for j in range(30))) for i in range(200)]  # each document has words of its own
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).cache()
    monkeypatch.setattr(prep, "TEXT_BYTES", 5000)
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    twice, sizes = df.unionByName(df.withColumn("id", F.col("id") + 1000)), []
    parts = prep.text_parts(twice, "text")

    def within(vocab, *limits):
        sizes.extend(vocab.rdd.glom().map(len).collect())
        return tables.within(vocab, *limits)

    monkeypatch.setattr(prep, "within", within)
    bag = prep.bag_of_words(twice, "id", "text", min_df=2)
    assert len(sizes) == parts > 10 and sum(sizes) == 4000 and max(sizes) < 4000 // 5
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(token") == 1  # of the counts; the vocabulary lies where it is
    assert bag.count() == 8000


def test_large_token_tables_are_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(30)), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, y string")
    counts = laid_out(prep.bag_of_words(df, "id", "text", ["y"], min_df=2))
    model = naive_bayes.multinomial_nb_fit(df, counts, "y")
    plan = model.score(df.select("id"), counts, "id")._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "Generate explode" not in plan
    assert plan.count("Exchange hashpartitioning(token") == 1  # of the model; the counts lie where they are


def test_counts_are_not_sorted_to_meet_tokens(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    rows = [(i, "hot " + " ".join(f"w{(i * 7 + j) % 90}" for j in range(30)), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, y string")
    bag = prep.bag_of_words(df, "id", "text", ["y"], min_df=2)
    counts = laid_out(bag)
    model = naive_bayes.multinomial_nb_fit(df, counts, "y")
    for made in (bag, model.score(df.select("id"), counts, "id"), maxent.maxent_fit(df, counts, "id", "y", max_iter=1).score(df, counts, "id")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert bag.filter("token = 'hot'").count() == 60


def test_counts_are_not_sorted_to_meet_labels(spark, monkeypatch):
    d, fit, seen = "/root/testdata/sf0.001", naive_bayes.bernoulli_nb_fit, []
    want = sorted(map(tuple, catalog.QUERIES["bnb_params"](spark, d).collect()))

    def watched(docs, counts, label):
        seen.append((counts._jdf.queryExecution().executedPlan().toString(), counts.groupBy("token").count().rdd.getNumPartitions()))
        return fit(docs, counts, label)

    monkeypatch.setattr(naive_bayes, "bernoulli_nb_fit", watched)
    monkeypatch.setattr(catalog, "LABEL_ROWS", 0, raising=False)
    monkeypatch.setattr(prep, "TEXT_BYTES", 100_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, catalog.QUERIES["bnb_params"](spark, d).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan, tasks = seen[0]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert tasks == prep.text_parts(catalog.table(spark, d, "documents"), "text") > 2
    assert got == want


def test_words_of_distinct_rows_are_counted_by_batch(spark):
    rows = [(1, "a", "The the Ünï_1 x yy"), (2, None, None), (3, "b", ""), (4, "b", "yy YY zz ǅa 𝒜𝒜 𝒜"), (None, "c", "pp pp")]
    want = [(1, "a", "the", 2), (1, "a", "yy", 1), (1, "a", "ünï_1", 1), (4, "b", "yy", 2), (4, "b", "zz", 1), (4, "b", "ǆa", 1), (4, "b", "𝒜𝒜", 1), (None, "c", "pp", 2)]
    more = [(4, "b", "zz yy"), (4, "d", "zz")]

    def run(rows):
        counts = prep.word_counts(spark.createDataFrame(rows, "id long, y string, text string"), ["id", "y"], "text", 3)
        return counts._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, counts.collect()), key=str)

    plan, got = run(rows)
    assert "HashAggregate" not in plan and "Generate" not in plan  # no row of its own for each word
    assert got == sorted(want, key=str)
    shared = {r[:3]: r[3] for r in want} | {(4, "b", "zz"): 2, (4, "b", "yy"): 3, (4, "d", "zz"): 1}
    assert run(rows + more)[1] == sorted([(*k, n) for k, n in shared.items()], key=str)


def test_counts_read_once_are_not_written_again(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.QUERIES["mnb_predict"](spark, d).collect()))
    monkeypatch.setattr(catalog, "laid_out", lambda df: pytest.fail("written again"))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, catalog.QUERIES["reread_mnb"](spark, d).collect())) == want
    assert catalog.QUERIES["mnb_params"](spark, d).count() > 0


def test_counts_that_the_fit_alone_reads_are_not_written_again(spark, monkeypatch):
    monkeypatch.setattr(catalog, "laid_out", lambda df: pytest.fail("written again"))
    assert catalog.QUERIES["bnb_params"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("task_rows", [50, 10**6])
def test_layouts_of_counts_change_no_fit(spark, monkeypatch, task_rows):
    rows = [(i, "the the " + ("cat sat" if i % 2 else "dog ran off") + f" w{i % 7}", "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y string")
    counts = prep.bag_of_words(df, "id", "text", ["y"], min_df=2)
    want = [r["weight"] for r in maxent.maxent_fit(df, counts, "id", "y", max_iter=3, eps=0.0).table().orderBy("token", "label").collect()]
    newton = [r["weight"] for r in quasi_newton.token_newton_fit(df, counts, "id", "y", max_iter=2, eps=0.0).table().orderBy("token", "label").collect()]
    for module in (maxent, quasi_newton):
        monkeypatch.setattr(module, "TASK_ROWS", task_rows)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    lying = laid_out(counts.repartition(5, "token"))
    assert [r["weight"] for r in maxent.maxent_fit(df, lying, "id", "y", max_iter=3, eps=0.0).table().orderBy("token", "label").collect()] == pytest.approx(want)
    got = quasi_newton.token_newton_fit(df, lying, "id", "y", max_iter=2, eps=0.0, broadcast_rows=0).table()
    assert [r["weight"] for r in got.orderBy("token", "label").collect()] == pytest.approx(newton)


def test_blocks_of_a_dual_fit_stay_where_they_are(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b), "no" if a + b < 0 else "yes") for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))], "id long, a double, b double, c string")
    rows, n, parts = dual_svm.blocked(df, ["a", "b"], "c", ["no", "yes"], "id", 16)
    state = dual_svm.start(rows, ["alpha", "move"])
    assert n == 200 and state.count() >= 200 // 16 and parts == rows.rdd.getNumPartitions()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.join(state, "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan  # nor is the state of the first round dealt anew


def test_char_ngrams_are_counted_in_blocks_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abé𝄞"), rng.integers(1, 6))) for _ in range(rng.integers(1, 30))) for _ in range(30)]
    rows = [*enumerate(texts), (30, ""), (31, None), (32, " \t x\n")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {}
    for i, text in rows:
        for w in (text or "").lower().split():
            for n in (1, 2, 3):
                for j in range(len(w) + 3 - n):
                    key = i, f" {w} "[j:j + n]
                    want[key] = want.get(key, 0) + 1
    for letters in (40, 10**6):
        monkeypatch.setattr(batches, "GRAM_LETTERS", letters)
        out = prep.char_ngrams(df, "id", "text")
        assert {(r["id"], r["token"]): r["n"] for r in out.collect()} == want
    assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
    twice = prep.char_ngrams(df.union(df), "id", "text")  # rows that share an id are counted together
    assert {(r["id"], r["token"]): r["n"] for r in twice.collect()} == {k: 2 * n for k, n in want.items()}
