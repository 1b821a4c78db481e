"""Fits run to their end against plain loops and direct optima."""

import numpy as np
import pytest

from tabulearn.operators import dual_svm, kernels, linear, quasi_newton


def frame(spark, x, y, ids=None):
    rows = [(int(i if ids is None else ids[i]), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(3)


# ---- quasi-Newton on tokens ----

def token_data(spark, seed=0, docs=40):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c"]
    labels = [names[int(c)] for c in rng.integers(0, 3, docs)]
    counts = [(i, f"{t}", int(n)) for i in range(docs - 2) for t, n in zip([*rng.choice(12, 4, replace=False), labels[i]], rng.integers(1, 4, 5))]
    return (spark.createDataFrame(list(enumerate(labels)), "id long, label string").repartition(3),
            spark.createDataFrame(counts, "id long, token string, n long").repartition(4), labels, counts)


@pytest.mark.parametrize("sent", [None, 0])
def test_token_newton_reaches_the_optimum(spark, sent):
    docs, counts, labels, rows = token_data(spark)
    fit = quasi_newton.token_newton_fit(docs, counts, "id", "label", eps=1e-4, ridge=0.05, broadcast_rows=sent)
    tokens = sorted({t for _, t, _ in rows})
    x = np.zeros((len(labels), len(tokens)))
    for i, t, n in rows:
        x[i, tokens.index(t)] += n
    w = np.zeros((len(tokens), 3))
    for r in fit.weights.collect():
        w[tokens.index(r["token"])] = r["w"]
    c = np.array([fit.classes.index(v) for v in labels])
    loss, gradient = quasi_newton.dense_loss(x, c, w, 0.05)
    assert fit.converged and np.linalg.norm(gradient) < 1.01e-4 and fit.steps[-1][1] == pytest.approx(loss, abs=1e-9)
    # Convex with curvature 0.05: plain descent from there finds nothing that is lower by more than this.
    best = w.copy()
    for _ in range(3000):
        best -= 0.05 * quasi_newton.dense_loss(x, c, best, 0.05)[1]
    assert loss - quasi_newton.dense_loss(x, c, best, 0.05)[0] < 1e-7
    losses = [s[1] for s in fit.steps]
    assert all(a > b for a, b in zip(losses, losses[1:])) and fit.steps_table(spark).where("converged").count() == 1


def test_token_newton_stops(spark):
    docs, counts, _, _ = token_data(spark)
    fit = quasi_newton.token_newton_fit(docs, counts, "id", "label", max_iter=2, eps=0.0)
    assert (fit.iterations, fit.converged, len(fit.steps)) == (2, False, 3)
    with pytest.raises(ValueError):
        quasi_newton.token_newton_fit(docs, counts.limit(0), "id", "label")
    one = quasi_newton.token_newton_fit(docs.where("label = 'a'"), counts, "id", "label")
    assert one.converged and one.iterations == 0


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(2)
    basis = {n: rng.normal(size=7) for n in ("g", "s1", "y1", "s2", "y2")}
    basis["y1"] += 3 * basis["s1"]
    basis["y2"] += 3 * basis["s2"]
    dots = {(min(a, b), max(a, b)): float(basis[a] @ basis[b]) for a in basis for b in basis}
    found = quasi_newton.direction(dots, [("s1", "y1"), ("s2", "y2")])
    s, y = basis["s2"], basis["y2"]
    h = np.eye(7) * (s @ y) / (y @ y)
    for k in ("1", "2"):
        s, y = basis["s" + k], basis["y" + k]
        v = np.eye(7) - np.outer(y, s) / (s @ y)
        h = v.T @ h @ v + np.outer(s, s) / (s @ y)
    assert sum(c * basis[n] for n, c in found.items()) == pytest.approx(-h @ basis["g"])


# ---- dual perceptron ----

def plain_dual(x, y, ids):
    order = np.argsort(ids, kind="stable")
    x, y, ids = x[order].astype(float), y[order].astype(float), np.array(ids)[order]
    w, b, alpha = np.zeros(x.shape[1]), 0.0, {}
    while True:
        wrong = np.flatnonzero(y * (x @ w + b) <= 0)
        if not len(wrong):
            return sorted(alpha.items()), w, b
        i = wrong[0]
        alpha[int(ids[i])] = alpha.get(int(ids[i]), 0.0) + 1.0
        w, b = w + y[i] * x[i], b + y[i]


@pytest.mark.parametrize("block", [20, 60, 4096])
def test_dual_perceptron_equals_the_plain_loop(spark, block):
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 10, (150, 3))
    y = np.where(x @ [2, -5, 3] + 11.5 > 0, 1, -1)
    ids = rng.permutation(150)
    want, w, b = plain_dual(x, y, ids)
    fit = linear.perceptron_dual_fit(frame(spark, x, y, ids), "x", "y", "id", max_updates=10_000, block=block)
    assert fit.converged and fit.updates == want and (fit.w == w).all() and fit.b == b
    made = sum(a for _, a in want)
    assert made > 50 and (block < 60 or fit.jobs * 3 < made)


def test_dual_perceptron_stops_where_nothing_separates(spark):
    fit = linear.perceptron_dual_fit(frame(spark, [[1.0], [1.0], [2.0]], [1, -1, 1]), "x", "y", "id", max_updates=7, block=2)
    assert not fit.converged and sum(a for _, a in fit.updates) == 7


# ---- multipliers ----

def dual_optimum(gram, y, C, steps=20_000):
    """Projected gradient ascent."""
    q, alpha = gram * np.outer(y, y), np.zeros(len(y))
    rate = 1.0 / np.linalg.eigvalsh(q).max()
    for _ in range(steps):
        alpha = np.clip(alpha + rate * (1.0 - q @ alpha), 0.0, C)
    return alpha.sum() - alpha @ q @ alpha / 2


@pytest.mark.parametrize("kind", ["linear", "rbf"])
@pytest.mark.parametrize("block", [7, 1024])
def test_multipliers_reach_the_dual_optimum(spark, kind, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    y = np.where(x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=60) > 0.5, 1, -1)
    x[50:], y[50:] = x[:10], y[:10]  # repeated rows
    df = frame(spark, x, y)
    options, tol = ({"working": 9}, 1e-4) if kind == "rbf" else ({}, 1e-3)
    fit = (dual_svm.dual_linear_fit if kind == "linear" else dual_svm.dual_rbf_fit)(df, "x", "y", "id", C=0.7, tol=tol, block=block, **options)
    gram = kernels.kernel_matrix(x, x, kind, 1.0) + 1.0
    rows = {r["sv_id"]: r for r in fit.support.collect()}
    alpha = np.array([rows[i]["alpha"] if i in rows else 0.0 for i in range(60)])
    assert fit.converged and fit.gap <= tol * fit.primal and (alpha >= 0).all() and (alpha <= 0.7).all()
    value = alpha.sum() - (alpha * y) @ gram @ (alpha * y) / 2
    best = dual_optimum(gram, y, 0.7)
    assert best - fit.gap - 1e-9 <= value <= best + 1e-9
    assert fit.b == pytest.approx(float(alpha @ y), abs=1e-9)
    scored = kernels.decision_function(df, fit.support, fit.b, "id", "x", keep=["y"], kind=kind, sigma=1.0).collect()
    want = gram @ (alpha * y)
    assert [r["score"] for r in sorted(scored)] == pytest.approx(want.tolist(), abs=1e-9)


def test_multipliers_of_rows_far_apart(spark):
    """Separable: only the two rows at the border have multipliers, and an endless C does not matter."""
    fit = dual_svm.dual_linear_fit(frame(spark, [[-3.0], [-1.0], [1.0], [4.0]], [-1, -1, 1, 1]), "x", "y", "id", C=100.0, tol=1e-6)
    assert sorted((r["sv_id"], round(r["alpha"], 3)) for r in fit.support.collect()) == [(1, 0.5), (2, 0.5)]
    assert fit.w == pytest.approx([1.0], abs=1e-3) and fit.b == pytest.approx(0.0, abs=1e-3)


def test_rbf_rounds_do_not_grow_with_the_rows_that_are_wrong(spark):
    """Unit vectors without structure: nearly all rows end at C, many times as many as move a round."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fit = dual_svm.dual_rbf_fit(frame(spark, x, np.where(rng.random(400) < 0.5, 1, -1)), "x", "y", "id", C=0.5, working=32, max_rounds=45, block=100)
    assert fit.converged and fit.support.count() > 300


def test_blocks_are_written_once_and_large_linear_support_meets_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype(np.float32).astype(float)
    df, written = frame(spark, x, np.where(x[:, 0] > 0, 1, -1)), []
    plain = dual_svm.checkpointed
    monkeypatch.setattr(dual_svm, "checkpointed", lambda t: written.append(t) or plain(t))
    rows, _, _ = dual_svm.blocked(df, "x", "y", [-1, 1], "id", 16)
    assert not written and all(len(r["x"]) == len(r["y"]) // 8 * 5 * 4 + 1 for r in rows.collect())
    sv = df.selectExpr("id as sv_id", "x", "cast(y as double) as y", "0.25D as alpha")
    want = [r["score"] for r in kernels.decision_function(df, sv, 0.5, "id", "x", kind="linear").orderBy("id").collect()]
    assert want == pytest.approx((x @ x.T @ (0.25 * np.where(x[:, 0] > 0, 1, -1)) + 0.5).tolist())
    monkeypatch.setattr(kernels, "_tiled_decision", lambda *a: pytest.fail("pairs"))
    got = kernels.decision_function(df, sv, 0.5, "id", "x", kind="linear", max_inline=5).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(want)
    monkeypatch.setattr(kernels, "TILE_NUMBERS", 100)
    rbf = kernels.decision_function(df, sv, 0.0, "id", "x").orderBy("id").collect()
    assert [r["score"] for r in rbf] == pytest.approx((kernels.kernel_matrix(x, x, "rbf", 1.0) @ (0.25 * np.where(x[:, 0] > 0, 1, -1))).tolist())
