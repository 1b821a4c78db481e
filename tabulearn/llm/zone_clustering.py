"""Centroid clustering with zone maps along a Hilbert curve (operator 13).

Vectors of integers are put in the order of a Hilbert curve and cut into blocks; a block keeps the smallest and largest
value of each component, its box. For each centroid the box bounds the distance of any vector inside from below and
above, and only centroids whose lower bound is at most the smallest upper bound are candidates of the block. These are
compared with all its vectors at once, in exact integers. The curve only decides which vectors share a box, never a result.

A round is one pass over the written blocks; each task sends a sum and a count per centroid and component.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.session import checkpointed

BLOCK = 256
CURVE_BITS = 4
LIMIT = 1 << 26  # beyond, a squared distance of 64 components would not fit a long
EXACT = 1 << 23  # up to here products of 64 components are exact in doubles


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * scale))
    fits = F.forall(v, lambda x: F.abs(x) * scale <= float(LIMIT))
    told = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("array<bigint>")
    return F.when(F.coalesce(finite, F.lit(False)), F.when(fits, scaled).otherwise(told))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (row, axis), as bytes (row, ..) that sort in its order.

    The axes' bits are turned into the transposed form of the place, plane by plane from the highest bit, all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for axis in x:
            flip = (axis & q) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def vectors_of(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def hilbert_blocks(rows: DataFrame, dims: int, block: int) -> DataFrame:
    """(ids, vectors, low, high) per block of (id, v): the vectors as bytes, and their box."""
    ends = rows.select(F.posexplode("v").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for r in ends:
        low[r["axis"]], high[r["axis"]] = r["low"], r["high"]
    width = np.maximum((high - low + (1 << CURVE_BITS)) >> CURVE_BITS, 1)

    def place(batches):
        for batch in batches:
            keys = hilbert_keys((vectors_of(batch.column("v"), dims) - low) // width, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([k.tobytes() for k in keys], pa.binary())], ["id", "v", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, v array<bigint>, key binary").withColumn("turn", F.monotonically_increasing_id())
    # Written before it is dealt out, so that the turn, which spreads equal vectors over tasks, stays the same.
    placed = checkpointed(placed)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "key", F.pmod(F.xxhash64("turn"), F.lit(1 << 20))).sortWithinPartitions("key", "turn")

    def cut(batches):
        for batch in batches:
            x = vectors_of(batch.column("v"), dims)
            starts = range(0, len(x), block)
            parts = [x[s : s + block] for s in starts]
            lengths = np.minimum(np.cumsum([0, *map(len, parts)]), len(x)).astype(np.int32)
            ids = batch.column("id")
            ids = pa.ListArray.from_arrays(pa.array(lengths), ids if isinstance(ids, pa.Array) else ids.combine_chunks())
            yield pa.RecordBatch.from_arrays([ids, pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary()),
                                              pa.array([p.min(axis=0) for p in parts], pa.list_(pa.int64())), pa.array([p.max(axis=0) for p in parts], pa.list_(pa.int64()))],
                                             ["ids", "vectors", "low", "high"])

    return checkpointed(ordered.select("id", "v").mapInArrow(cut, f"ids array<{kind}>, vectors binary, low array<bigint>, high array<bigint>"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to some vector of the box, in ascending order; all arithmetic is exact."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    furthest = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((outside**2).sum(axis=1) <= (furthest**2).sum(axis=1).min())


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector of a block, ties to the smaller number, and how many were compared."""
    some = candidates(low, high, centroids)
    c = centroids[some]
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(c).max()) <= EXACT and x.shape[1] <= 64:
        crossed = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        far = (x * x).sum(axis=1)[:, None] - 2 * crossed + (c * c).sum(axis=1)
    else:
        far = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    best = far.argmin(axis=1)
    return some[best], far[np.arange(len(x)), best], len(some)


def unpacked(batches, dims: int):
    for batch in batches:
        for ids, raw, low, high in zip(batch.column("ids"), batch.column("vectors"), batch.column("low"), batch.column("high")):
            x = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64).reshape(-1, dims)
            yield ids.values, x, np.array(low.as_py(), np.int64), np.array(high.as_py(), np.int64)


def moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, low, high in unpacked(batches, dims):
            cluster, _, _ = nearest(x, low, high, centroids)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], starts, axis=0)
            n += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = zones.mapInArrow(run, "cluster int, n long, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("axis", "s"))
    big = "decimal(38,0)"
    out = centroids.copy()
    for r in parts.groupBy("cluster", "axis").agg(F.sum(F.col("n").cast(big)).alias("n"), F.sum(F.col("s").cast(big)).alias("s")).collect():
        out[r["cluster"], r["axis"]] = int(r["s"]) // int(r["n"])
    return out


def starting_centroids(rows: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors of the k rows with the smallest hash of seed and id; equal hashes go by the vector, null ids come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) per vector.

    Vectors that are null, of another length than ``dims`` or with a null or non-finite component are left out, repeated
    ids and vectors are rows like any other. Components become floor(scale * x); one beyond ±2^26 stops the job, as its
    squared distance would not fit. Fewer than ``k`` vectors give as many centroids; none give no rows. ``compared`` is
    the number of centroids that the box of the vector's block left.
    """
    spark = df.sparkSession
    rows = df.where(F.size(vector_col) == dims).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("v")).where("v is not null")
    rows = checkpointed(rows)
    centroids = starting_centroids(rows, k, dims, seed)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int")
    zones = hilbert_blocks(rows, dims, block)
    for _ in range(rounds):
        centroids = moved(zones, centroids)

    def assign(batches):
        for ids, x, low, high in unpacked(batches, dims):
            found, far, compared = nearest(x, low, high, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(far, pa.int64()), pa.array(np.full(len(x), compared), pa.int32())],
                                             ["id", "cluster", "distance", "compared"])

    assigned = checkpointed(zones.mapInArrow(assign, f"id {kind}, cluster int, distance long, compared int"))
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    at = F.col("cluster")
    per_cluster = F.array(*[F.lit(inertia.get(i, 0)).cast("bigint") for i in range(len(centroids))])
    return assigned.select(F.col("id").alias(id_col), "cluster", "distance", F.get(per_cluster, at).alias("cluster_inertia"),
                           F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), F.get(F.array(*map(F.lit, digest)), at).alias("centroid_sha256"), "compared")
