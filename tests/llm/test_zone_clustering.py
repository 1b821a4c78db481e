import hashlib
import math

import numpy as np
import pytest

from tabulearn.llm import zone_clustering as Z

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]


def plain(rows, k, rounds, dims):
    """The definition with Python's integers; rows of (id, vector)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, j, d, sum(e for e, m in found if m == j), total, digest[j]) for (i, _), (d, j) in zip(kept, found))


def got(df, **options):
    return sorted((r[0] is None, r[0] or 0, *r[1:6]) for r in Z.cluster(df, **options).collect())


def frame(spark, rows):
    rows = [(i, v, "?", "?") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, cluster string").repartition(3)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.2).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, -4.0, 5.0]) for i in range(300, 400)]  # equal vectors
    rows += [(None, [0.5] * 5), (None, [0.25] * 5), (7, [9.0] * 5), (900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 0.0, 0.0, 0.0]),
             (904, [float("nan")] * 5), (905, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (906, [0.0] * 5)]
    df = frame(spark, rows)
    assert got(df, k=9, rounds=4, dims=5, block=block) == plain(rows, 9, 4, 5)
    found = Z.cluster(df, k=9, rounds=4, dims=5, block=block)
    assert found.columns == COLUMNS
    # Groups far apart: the boxes of small blocks leave few centroids.
    assert block > 7 or found.selectExpr("avg(compared)").first()[0] < 5


def test_few_rows_large_numbers_and_none(spark):
    rows = [(1, [200000.0, -0.001]), (2, [200000.0, 0.001]), (3, [-262144.0, 262144.0]), (4, [1e-9, -1e-9])]
    assert got(frame(spark, rows), k=40, rounds=3, dims=2) == plain(rows, 40, 3, 2)
    assert got(frame(spark, rows), k=2, rounds=3, dims=2) == plain(rows, 2, 3, 2)
    assert got(frame(spark, rows[:1]).limit(0), k=2, dims=2) == []
    with pytest.raises(Exception, match="beyond"):
        got(frame(spark, [*rows, (5, [1e9, 0.0])]), k=2, dims=2)


def test_curve_is_a_walk():
    """Cells in the order of their keys are each one step from the last, and every cell has a key of its own."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = [k.tobytes() for k in Z.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(keys)
        walk = cells[np.argsort(np.array(keys, dtype=object))]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-50, 50, (8, 3))
        c = rng.integers(-90, 90, (12, 3))
        some = Z.candidates(x.min(axis=0), x.max(axis=0), c)
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        assert set(far.argmin(axis=1)) <= set(some.tolist()) and (np.diff(some) > 0).all()
