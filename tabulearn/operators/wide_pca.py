"""Principal components of wide rows by randomised block iteration, without a columns x columns matrix.

The block holds k + extra directions, cut from random ones. A pass multiplies
them by the covariance: each task sums X'(X V) of its rows around the mean, one
row per column of the table leaves the task, and Spark adds them up by column.
Between passes only columns x block numbers are in the driver, orthogonalised
by a QR; the next block is the best within the span of the block, its residual
and its last move, which needs far fewer passes than plain powers.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.batches import matrix
from tabulearn.functions.columns import feature_array

# A pass sends at most this many bytes of directions to each task; more go in several passes.
PASS_BYTES = 64_000_000
PIECE_NUMBERS = 500_000


def _input(features, sparse: bool):
    return F.array_compact(F.coalesce(F.col(features).cast("array<int>"), F.array().cast("array<int>"))) if sparse else feature_array(features)


@dataclass
class WidePca:
    features: object
    mean: np.ndarray
    components: np.ndarray  # (columns, k), orthonormal, largest loading positive
    variances: np.ndarray  # population variance along each, descending
    residual: float  # largest |C v - variance v|, as a share of the largest variance
    passes: int
    converged: bool
    sparse: bool = False

    def project(self, df: DataFrame, out: str = "pc") -> DataFrame:
        """Adds the coordinates of the centred row along the components."""
        form, axes, names = Counted() if self.sparse else Dense(self.mean), self.components, df.columns
        shift = self.mean @ axes if self.sparse else 0.0
        if {out, "_x"} & set(names):
            raise ValueError(f"rename columns {sorted({out, '_x'} & set(names))}")

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    scores = np.vstack([form.times(x, axes) for x in _pieces(batch.column("_x"), form)]) - shift
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores.tolist(), pa.list_(pa.float64()))], [*names, out])

        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
        return df.withColumn("_x", _input(self.features, self.sparse)).mapInArrow(run, schema)

    def table(self, spark) -> DataFrame:
        rows = [(i, float(v), f, float(c)) for i, v in enumerate(self.variances) for f, c in enumerate(self.components[:, i])]
        return spark.createDataFrame(rows, "component int, variance double, feature int, loading double")


class Dense:
    """Rows as arrays of numbers, taken around the mean."""

    def __init__(self, mean=None):
        self.mean = mean

    def rows(self, column):
        x = matrix(column)
        return x if self.mean is None else x - self.mean

    def times(self, x, v):
        return x @ v

    def back(self, x, y, wide):
        return x.T @ y


class Counted:
    """Rows as lists of places, one per occurrence, that stand for the counts of ``wide`` columns; never laid out."""

    def rows(self, column):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def times(self, x, v):
        places, lengths = x
        out, filled = np.zeros((len(lengths), v.shape[1])), np.flatnonzero(lengths)
        if len(filled):
            starts = (np.cumsum(lengths) - lengths)[filled]
            out[filled] = np.add.reduceat(v[places], starts, axis=0)
        return out

    def back(self, x, y, wide):
        places, lengths = x
        out = np.zeros((wide, y.shape[1]))
        if len(places):
            order = np.argsort(places, kind="stable")
            sorted_places = places[order]
            starts = np.flatnonzero(np.r_[True, sorted_places[1:] != sorted_places[:-1]])
            out[sorted_places[starts]] = np.add.reduceat(y[np.repeat(np.arange(len(lengths)), lengths)[order]], starts, axis=0)
        return out


def _pieces(column, form):
    """Some rows of an Arrow list column at a time, so that a piece has a bounded number of numbers or one row."""
    sizes = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + PIECE_NUMBERS, side="right")))
        yield form.rows(column.slice(at, end - at))
        at = end


def _by_column(rows: DataFrame, form, part, wide: int, out_of: int) -> np.ndarray:
    """Sum over all rows of ``part(rows) -> (columns, out_of)``."""

    def run(batches):
        total = np.zeros((wide, out_of))
        for batch in batches:
            for piece in _pieces(batch.column("x"), form):
                total += part(piece)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide)), *[pa.array(total[:, i]) for i in range(out_of)]],
                                             ["column", *[f"v{i}" for i in range(out_of)]])

    names = [f"v{i}" for i in range(out_of)]
    summed = rows.mapInArrow(run, ", ".join(["column long", *[f"{n} double" for n in names]])).groupBy("column").agg(*[F.sum(n).alias(n) for n in names])
    found, out = summed.toArrow(), np.zeros((wide, out_of))
    for i, n in enumerate(names):
        out[found.column("column").to_numpy(), i] = found.column(n).to_numpy()
    return out


def _covariance_times(rows, form, mean, n, block) -> np.ndarray:
    """C V, with C the population covariance, some directions a pass."""
    wide, step, parts = len(mean), max(1, PASS_BYTES // (8 * len(mean))), []
    for at in range(0, block.shape[1], step):
        v = np.ascontiguousarray(block[:, at:at + step])
        parts.append(_by_column(rows, form, lambda x, v=v: form.back(x, form.times(x, v), wide), wide, v.shape[1]))
    image = np.hstack(parts) / n
    return image if isinstance(form, Dense) else image - np.outer(mean, mean @ block)


def wide_pca_fit(df: DataFrame, features, k: int, extra: int = 8, tol: float = 1e-8, max_passes: int = 100, seed: int = 0,
                 wide: int = None) -> WidePca:
    """The top k components; stops when every residual is at most ``tol`` of the largest variance.

    With ``wide``, ``features`` names a column with an array of places from 0 to
    wide - 1, and a row is the counts of its places (null places don't count, a
    null array is a row of zeros). The table is read once a pass; a costly one
    should be written out or cached first. The seed only decides where the
    iteration starts. Fewer columns than k, no rows or a null component stop the
    job; rows that are all equal have zero variances. Directions of equal
    variance are any orthonormal basis of them.
    """
    sparse = wide is not None
    rows = df.select(_input(features, sparse).alias("x"))
    shape = rows.agg(
        F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.min(F.array_min("x")).alias("least"),
        F.max(F.array_max("x")).alias("most"), F.max(F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double")))).alias("broken")).first()
    n = shape["n"]
    if not n:
        raise ValueError("no rows to learn from")
    if sparse and (shape["least"] or 0) >= 0 and (shape["most"] or 0) < wide:
        form = Counted()
    elif sparse or shape["low"] != shape["high"] or shape["broken"]:
        raise ValueError(f"places need to be from 0 to {wide - 1}" if sparse else "rows need the same number of components, none of them null")
    else:
        form, wide = Dense(), shape["high"]
    if not 1 <= k <= wide:
        raise ValueError(f"k must be from 1 to {wide}")
    mean = _by_column(rows, form, lambda x: form.back(x, np.ones((len(x[1] if sparse else x), 1)), wide), wide, 1)[:, 0] / n
    form = form if sparse else Dense(mean)
    size = min(wide, k + extra)
    span = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, size)))[0]
    last, passes = None, 0
    while True:
        image = _covariance_times(rows, form, mean, n, span)
        passes += 1
        inner = span.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        mix = mix[:, ::-1][:, :size]
        block, values = span @ mix, np.maximum(values[::-1][:size], 0.0)
        off = image @ mix - block * values
        residual = float(np.linalg.norm(off[:, :k], axis=0).max() / values[0]) if values[0] > 0 else 0.0
        if residual <= tol or passes >= max_passes or span.shape[1] == wide:
            break
        move = block - last @ (last.T @ block) if last is not None else np.zeros((wide, 0))
        last = block
        # Columns are brought to length one first, so that the QR sees small moves as well as large ones.
        joined = [block, *[m / np.maximum(np.linalg.norm(m, axis=0), 1e-300) for m in (off, move)]]
        span = np.linalg.qr(np.hstack(joined))[0]
    axes = block[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    return WidePca(features, mean, axes, values[:k], residual, passes, residual <= tol, sparse)
