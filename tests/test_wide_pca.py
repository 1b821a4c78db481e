"""Block iteration against the exact axes, and many columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.operators import wide_pca


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def exact(x, k):
    c = (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
    values, axes = np.linalg.eigh(c)
    axes = axes[:, ::-1][:, :k]
    return values[::-1][:k], axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])


@pytest.mark.parametrize("n,d,k,far", [(200, 12, 3, 0.0), (300, 40, 2, 1e4), (5, 30, 2, 0.0), (50, 3, 3, 5.0)])
def test_axes_are_the_exact_ones(spark, n, d, k, far):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * np.linspace(1, 3, d) + far
    fit = wide_pca.wide_pca_fit(frame(spark, x), "x", k)
    values, axes = exact(x, k)
    assert fit.converged and fit.variances == pytest.approx(values, rel=1e-7)
    assert fit.components == pytest.approx(axes, abs=1e-5)
    scored = fit.project(frame(spark, x)).orderBy("id").collect()
    assert np.array([r["pc"] for r in scored]) == pytest.approx((x - x.mean(0)) @ axes, abs=1e-3 if far > 10 else 1e-4)


def test_a_seed_and_the_partitions_change_nothing(spark):
    x = np.random.default_rng(5).normal(size=(150, 40)) * np.linspace(0.5, 2, 40)
    fits = [wide_pca.wide_pca_fit(frame(spark, x, p), "x", 2, seed=s) for p, s in ((1, 0), (5, 9))]
    assert fits[0].components == pytest.approx(fits[1].components, abs=1e-5)


def test_twenty_thousand_columns(spark):
    rng = np.random.default_rng(1)
    wide, n = 20_000, 60
    axes = np.linalg.qr(rng.normal(size=(wide, 3)))[0]
    weights = rng.normal(size=(n, 3)) * [30.0, 20.0, 10.0]
    x = weights @ axes.T + rng.normal(size=(n, wide)) * 0.01
    df = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(x)], "id long, b binary").repartition(3)
    schema = "id long, x array<double>"

    def unpack(frames):
        for f in frames:
            f["x"] = [np.frombuffer(b) for b in f.pop("b")]
            yield f

    fit = wide_pca.wide_pca_fit(df.mapInPandas(unpack, schema), "x", 3)
    left, values, right = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert fit.converged and fit.passes < 30 and fit.variances == pytest.approx(values[:3] ** 2 / n, rel=1e-6)
    assert np.abs(np.sum(fit.components * right[:3].T, axis=0)) == pytest.approx(1.0, abs=1e-6)
    assert fit.components.shape == (wide, 3) and fit.table(spark).where("component = 0").count() == wide


def test_directions_in_several_passes(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(80, 30))
    want = wide_pca.wide_pca_fit(frame(spark, x), "x", 2, extra=2).variances
    monkeypatch.setattr(wide_pca, "PASS_BYTES", 8 * 30 * 5)
    assert wide_pca.wide_pca_fit(frame(spark, x), "x", 2, extra=2).variances == pytest.approx(want)


def test_edges(spark):
    same = frame(spark, np.full((6, 4), 2.0))
    fit = wide_pca.wide_pca_fit(same, "x", 2)
    assert fit.converged and list(fit.variances) == [0.0, 0.0] and fit.components.T @ fit.components == pytest.approx(np.eye(2), abs=1e-12)
    short = wide_pca.wide_pca_fit(frame(spark, np.random.default_rng(0).normal(size=(60, 40))), "x", 2, max_passes=1)
    assert not short.converged and short.passes == 1 and short.residual > 0
    columns = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    fit = wide_pca.wide_pca_fit(columns, ["a", "b"], 1)
    assert fit.components[:, 0] == pytest.approx(np.array([1.0, 2.0]) / np.sqrt(5))
    assert fit.project(columns).columns == ["a", "b", "pc"]
    for bad in (same.limit(0), spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, x array<double>"),
                spark.createDataFrame([(0, [1.0, None])], "id long, x array<double>")):
        with pytest.raises(ValueError):
            wide_pca.wide_pca_fit(bad, "x", 1)
    with pytest.raises(ValueError):
        wide_pca.wide_pca_fit(same, "x", 5)
    with pytest.raises(ValueError):
        fit.project(columns.withColumn("pc", F.lit(0)))


@pytest.mark.parametrize("piece", [7, 500_000])
def test_counted_places_equal_dense_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(wide_pca, "PIECE_NUMBERS", piece)
    rng = np.random.default_rng(4)
    lists = [[int(v) for v in rng.integers(0, 6 if i % 3 else 25, rng.integers(0, 30))] for i in range(60)] + [[], None, [3, None, 3]]
    x = np.array([np.bincount([v for v in r or [] if v is not None], minlength=25) for r in lists], float)
    df = spark.createDataFrame(list(enumerate(lists)), "id long, at array<int>").repartition(3)
    fit = wide_pca.wide_pca_fit(df, "at", 2, wide=25)
    values, axes = exact(x, 2)
    assert fit.converged and fit.variances == pytest.approx(values, rel=1e-7) and fit.components == pytest.approx(axes, abs=1e-5)
    scored = np.array([r["pc"] for r in fit.project(df).orderBy("id").collect()])
    assert scored == pytest.approx((x - x.mean(0)) @ axes, abs=1e-4)
    with pytest.raises(ValueError, match="places"):
        wide_pca.wide_pca_fit(df, "at", 2, wide=24)
