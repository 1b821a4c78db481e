"""Exact k nearest neighbours between two tables of any size.

The training rows are divided into cells around a few pivots; a query is sent
only to the cells that can hold one of its k nearest rows, judged by the
triangle inequality, so the pruning never loses a neighbour. Cells larger than
a tile are split, and so are the queries that meet in one cell; each task
compares one tile of queries with one tile of rows and returns k rows per
query, never the pairs.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.batches import matrix
from tabulearn.functions.columns import feature_array, literal_array
from tabulearn.session import checkpointed

MAX_PIVOTS = 512
ROUTED = 4096  # queries that are looked at together, and rows that are handed on together


@dataclass
class Cells:
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    near: np.ndarray  # distance from the pivot to its k-th nearest row, inf when the cell is smaller


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by the Gram matrix; used for pruning, not for results."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """Room for the rounding error of ``distances``."""
    big = max((a * a).sum(1).max(initial=0.0), (b * b).sum(1).max(initial=0.0))
    return 1e-6 * (1.0 + np.sqrt(big))


def _with_fields(schema, **fields):
    return T.StructType(schema.fields + [T.StructField(n, t) for n, t in fields.items()])


def _with_nearest_pivot(df, pivots):
    """Add the nearest pivot and the distance to it."""
    schema = df.schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(matrix(batch.column("x")), pivots)
            cell = d.argmin(1)
            table = batch.append_column("cell", pa.array(cell.astype("int32")))
            yield table.append_column("far", pa.array(d[np.arange(len(cell)), cell]))

    return df.mapInArrow(run, _with_fields(schema, cell=T.IntegerType(), far=T.DoubleType()))


def cells_to_visit(x: np.ndarray, cells: Cells, k: int):
    """(row, cell) pairs: each row with every cell that may hold one of its k nearest rows."""
    d = distances(x, cells.pivots)
    tol = slack(x, cells.pivots)
    bound = (d + cells.near).min(1)
    by_reach = np.argsort(d + cells.radius, axis=1)
    reach = np.take_along_axis(d + cells.radius, by_reach, 1)
    have = cells.count[by_reach].cumsum(1)
    enough = (have >= k)
    first = enough.argmax(1)
    from_cells = np.where(enough.any(1), reach[np.arange(len(x)), first], np.inf)
    bound = np.minimum(bound, from_cells)
    return np.nonzero((d - cells.radius <= bound[:, None] + tol) & (cells.count > 0))


def routed_batches(batches, cells: Cells, k: int):
    """The batches with each row once per cell it visits. Queries are looked at some at a time and handed on in small batches: a row may visit every cell."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROUTED):
            part = batch.slice(start, ROUTED)
            q, c = cells_to_visit(matrix(part.column("x")), cells, k)
            for i in range(0, len(q), ROUTED):
                yield part.take(pa.array(q[i:i + ROUTED])).append_column("cell", pa.array(c[i:i + ROUTED].astype("int32")))


def _routes(df, cells: Cells, k: int):
    """Repeat each query once per cell that may hold one of its k nearest rows."""
    return df.mapInArrow(lambda batches: routed_batches(batches, cells, k), _with_fields(df.schema, cell=T.IntegerType()))


def _visits(df, cells: Cells, k: int) -> np.ndarray:
    """How many queries visit each cell."""
    def run(batches):
        n = np.zeros(len(cells.count), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROUTED):
                n += np.bincount(cells_to_visit(matrix(batch.slice(start, ROUTED).column("x")), cells, k)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype("int32")), pa.array(n[n > 0])], ["cell", "n"])

    visits = np.zeros(len(cells.count), dtype=int)
    for r in df.select("x").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visits[r["cell"]] = r["n"]
    return visits


def vectors(df: DataFrame, features):
    """The features as doubles, or as floats if that is what their column holds: half of what is moved."""
    x = feature_array(features)
    kind = df.schema[features].dataType if isinstance(features, str) else None
    return x.cast(kind) if kind == T.ArrayType(T.FloatType(), True) or kind == T.ArrayType(T.FloatType(), False) else x


def nearest_in_tile(qid, qx, tid, tx, k, skip_same_id):
    """k nearest of ``tx`` for each row of ``qx``: (query index, train index, distance)."""
    out = []
    tol = slack(qx, tx) ** 2 + 1e-6 * ((qx * qx).sum(1).max(initial=0.0) + (tx * tx).sum(1).max(initial=0.0))
    step = max(1, 2_000_000 // max(1, len(tx)))
    for start in range(0, len(qx), step):
        a = qx[start:start + step]
        sq = (a * a).sum(1)[:, None] + (tx * tx).sum(1)[None, :] - 2.0 * (a @ tx.T)
        if skip_same_id:
            sq[qid[start:start + step][:, None] == tid[None, :]] = np.inf
        kth = np.partition(sq, min(k, sq.shape[1]) - 1, axis=1)[:, min(k, sq.shape[1]) - 1]
        q, t = np.nonzero((sq <= kth[:, None] + tol) & np.isfinite(sq))
        diff = a[q] - tx[t]
        exact = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((tid[t], exact, q))
        q, t, exact = q[order], t[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        out.append((q[keep] + start, t[keep], exact[keep]))
    return [np.concatenate(part) for part in zip(*out)]


def knn_join(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, features, k: int,
             skip_same_id: bool = False, tile_rows: int = 4096) -> DataFrame:
    """(query_id, train_id, distance, rank): exact, ties by train id.

    Ids are numbers. ``skip_same_id`` leaves out the training row with the
    query's own id, for a table compared with itself.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = queries.select(F.col(query_id).cast("long").alias("qid"), vectors(queries, features).alias("x"))
    t = train.select(F.col(train_id).cast("long").alias("tid"), vectors(train, features).alias("x"))
    train_rows, n_train = t, t.count()
    if not n_train:
        raise ValueError("no rows to learn from")
    need = k + 1 if skip_same_id else k
    # Of rows with equal vectors only those with the lowest ids can be among the
    # nearest, so a large group of copies shrinks to ``need`` rows; Spark cuts
    # each group per task before the shuffle.
    copies = Window.partitionBy("x").orderBy("tid")
    t = t.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= need).drop("_copy")
    n_pivots = int(min(MAX_PIVOTS, max(1, n_train // tile_rows)))
    # Pivots only steer the pruning; any rows would give the same result.
    pivots = np.array([r["x"] for r in train_rows.orderBy(F.xxhash64("tid"), "tid").limit(n_pivots).collect()], dtype=float)
    homed = checkpointed(_with_nearest_pivot(t, pivots))
    cells = _cell_stats(homed, pivots, need)
    # Counted first and sent when compared: written out, they would be the queries once per cell.
    visits = _visits(q, cells, need)
    routed = _routes(q, cells, need)
    row_tiles = literal_array(-(-cells.count // tile_rows), "int")
    query_tiles = literal_array(-(-visits // tile_rows), "int")
    left = routed.withColumn("qt", F.pmod(F.xxhash64("qid"), F.get(query_tiles, "cell")).cast("int")).withColumn(
        "tt", F.explode(F.sequence(F.lit(0), F.get(row_tiles, "cell") - 1)))
    right = (
        homed.filter(F.get(query_tiles, "cell") > 0)
        .withColumn("tt", F.pmod(F.xxhash64("tid"), F.get(row_tiles, "cell")).cast("int"))
        .withColumn("qt", F.explode(F.sequence(F.lit(0), F.get(query_tiles, "cell") - 1))))

    def compare(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if not len(lhs) or not len(rhs):
            return pd.DataFrame({"qid": [], "tid": [], "distance": []}).astype({"qid": "int64", "tid": "int64"})
        qid, tid = lhs["qid"].to_numpy(), rhs["tid"].to_numpy()
        i, j, d = nearest_in_tile(qid, np.stack(lhs["x"]).astype(float), tid, np.stack(rhs["x"]).astype(float), k, skip_same_id)
        return pd.DataFrame({"qid": qid[i], "tid": tid[j], "distance": d})

    keys = ["cell", "qt", "tt"]
    found = (
        left.select(*keys, "qid", "x").groupBy(*keys)
        .cogroup(right.select(*keys, "tid", "x").groupBy(*keys))
        .applyInPandas(compare, "qid long, tid long, distance double"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "tid"))
    return (
        found.withColumn("rank", place).filter(F.col("rank") <= k)
        .select(F.col("qid").alias(query_id), F.col("tid").alias("neighbor_id"), "distance", "rank"))


def _cell_stats(homed, pivots, need):
    n = len(pivots)
    count, radius, near = np.zeros(n, dtype=int), np.zeros(n), np.full(n, np.inf)
    for r in homed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    order = Window.partitionBy("cell").orderBy("far", "tid")
    kth = homed.select("cell", "far", "tid").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need)
    for r in kth.filter(F.col("place") == need).collect():
        near[r["cell"]] = r["far"]
    return Cells(pivots, count, radius, near)


def knn_predict(neighbors: DataFrame, train: DataFrame, query_id: str, train_id: str, label: str) -> DataFrame:
    """Most common label among the neighbours; the label met first wins a tie."""
    votes = (
        neighbors.join(train.select(F.col(train_id).alias("neighbor_id"), F.col(label).alias("prediction")), "neighbor_id")
        .groupBy(query_id, "prediction").agg(F.count("*").alias("votes"), F.min("rank").alias("_first")))
    best = F.max(F.struct("votes", (-F.col("_first")).alias("_near"), "prediction")).alias("b")
    return votes.groupBy(query_id).agg(best).select(query_id, "b.prediction", "b.votes")
