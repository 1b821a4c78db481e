"""Counts packed by document: both forms of a fit against numpy, and what a step moves."""

import numpy as np
import pytest

from tabulearn.operators import maxent, prep, quasi_newton, token_blocks
from tabulearn.plans import catalog
from tabulearn.session import laid_out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "the the " + ("cat sat" if i % 2 else "dog ran off") + f" w{i % 7}", "xy"[i % 2]) for i in range(40)]
    return spark.createDataFrame([*rows, (40, "", "x")], "id long, text string, y string")


def by_hand(rows, steps):
    """Weights of the steps, and the scores of the documents, from a dense matrix."""
    ids, tokens = sorted({r["id"] for r in rows}), sorted({r["token"] for r in rows})
    x, y = np.zeros((len(ids), len(tokens))), np.zeros((len(ids), 2))
    for r in rows:
        x[ids.index(r["id"]), tokens.index(r["token"])] = r["n"]
        y[ids.index(r["id"]), "xy".index(r["y"])] = 1
    w, n = np.zeros((len(tokens), 2)), len(ids) + 1  # one document has no words
    for _ in range(steps):
        p = token_blocks.shares(x @ w)
        w += (np.log(x.T @ y / n + 1e-9) - np.log(x.T @ p / n + 1e-9)) / x.sum(axis=1).max()
    return dict(zip(tokens, w)), dict(zip(ids, x @ w))


@pytest.mark.parametrize("sent", [0, 10**6])
def test_packed_counts_fit_and_score_as_a_dense_matrix(docs, monkeypatch, sent):
    monkeypatch.setattr(token_blocks, "SENT_NUMBERS", sent)
    counts = prep.bag_of_words(docs, "id", "text", ["y"], min_df=2)
    w, scores = by_hand(counts.collect(), 5)
    packed = token_blocks.pack(counts, "id", 3, "y", ["x", "y"])
    model = maxent.maxent_fit(docs, packed, "id", "y", max_iter=5, eps=0.0)
    got = {r["token"]: r["w"] for r in model.weights.collect()}
    assert got.keys() == w.keys() and all(got[t] == pytest.approx(w[t], abs=1e-12) for t in w)
    for given in (packed, counts):
        found = {r["id"]: r["jll"] for r in model.score(docs, given, "id").collect()}
        assert found.pop(40) == [0.0, 0.0] and all(found[i] == pytest.approx(scores[i], abs=1e-12) for i in scores)


def test_a_step_moves_tokens_of_blocks_and_not_of_documents(docs):
    packed = token_blocks.pack(prep.bag_of_words(docs, "id", "text", ["y"]), "id", 3, "y", ["x", "y"])
    assert packed.table.count() <= 3
    weights = packed.at_home(packed.tokens().selectExpr("token", "array(0D, 0D) as w"))
    plan = packed.places().join(weights.hint("shuffle_hash"), "token")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and packed.places().count() <= 3 * weights.count()


def test_a_fit_read_back_or_streamed_takes_all_steps(docs):
    counts = laid_out(prep.bag_of_words(docs.select("id", "text", "y"), "id", "text", ["y"], min_df=2))
    model = catalog.whole_maxent(docs.selectExpr("id as doc_id", "y as lang"), counts.selectExpr("id as doc_id", "y as lang", "token", "n"))
    assert model.iterations == 200


@pytest.mark.parametrize("sent", [0, None])
def test_quasi_newton_steps_read_packed_counts_and_give_back_their_files(docs, monkeypatch, sent):
    calls, plain = [], quasi_newton.released
    monkeypatch.setattr(quasi_newton, "released", lambda spark: calls.append(1) or plain(spark))
    counts = prep.bag_of_words(docs, "id", "text", ["y"], min_df=2)
    packed = token_blocks.pack(counts, "id", 3, "y", ["x", "y"])
    fit = quasi_newton.token_newton_fit(docs, packed, "id", "y", max_iter=3, eps=0.0, broadcast_rows=sent)
    assert len(calls) == fit.iterations == 3
    rows, tokens = counts.collect(), sorted(r["token"] for r in fit.weights.collect())
    x, c = np.zeros((41, len(tokens))), np.array([*[i % 2 for i in range(40)], 0])
    for r in rows:
        x[r["id"], tokens.index(r["token"])] = r["n"]
    w = {r["token"]: r["w"] for r in fit.weights.collect()}
    loss, gradient = quasi_newton.dense_loss(x, c, np.array([w[t] for t in tokens]), 0.0)
    assert fit.steps[0][1] == pytest.approx(np.log(2)) and fit.steps[-1][1] == pytest.approx(loss)
    assert fit.steps[-1][2] == pytest.approx(np.linalg.norm(gradient))
