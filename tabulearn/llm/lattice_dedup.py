"""Embedding near-dedup by lattice hashing (operator 3).

Each table projects the unit vectors to eight random directions and decodes the point to the nearest point of the E8
lattice, its home cell; it is also filed under the neighbouring cells that are next nearest. Two vectors meet where the
home of one is a cell of the other, and their cosine is verified in double precision. With the given spacing, tables
and probes a pair at cosine 0.93 meets with probability 0.9996, and closer pairs more surely.

Equal vectors are one row with a count. A cell with many vectors is cut into blocks that are compared two by two;
from each comparison come one row per vector with its number of links and its place in a spanning forest, never the
pairs. A pair that meets in several cells counts in the one with the smallest key.
"""

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.llm.components import connected_components
from tabulearn.llm.suffix_dedup import whole_groups
from tabulearn.llm.vectors import matrix, unit, usable
from tabulearn.session import checkpointed

TABLES, PROBES, SPACING = 4, 4, 1.5
BLOCK = 2048
BATCH_ROWS = 4096


def shortest_vectors() -> np.ndarray:
    """The 240 lattice points nearest to the origin."""
    points = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            points.append([a if k == i else b if k == j else 0 for k in range(8)])
    points += [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(points)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    whole = np.rint(x)
    off = x - whole
    odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return whole


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: of the even integer points and the same shifted by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cell_keys(rows: np.ndarray, group: np.ndarray, tables: int, probes: int, spacing: float, seed: int = 23) -> np.ndarray:
    """Keys (row, table, 1 + probes) of the home cell and the next ones; ``group`` separates what must not meet."""
    dims = rows.shape[1]
    rng = np.random.default_rng([seed, dims])
    factors = rng.integers(1, 2**62, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    neighbours = shortest_vectors()
    out = np.empty((len(rows), tables, 1 + probes), np.uint64)
    for t in range(tables):
        across = np.linalg.qr(rng.normal(size=(max(dims, 8), 8)))[0][:dims] * np.sqrt(8) * spacing
        x = rows @ across + rng.random(8)
        home = nearest_point(x)
        near = np.argsort(-((x - home) @ neighbours.T), axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([home[:, None], home[:, None] + neighbours[near]], axis=1)
        codes = (np.rint(cells * 2).astype(np.int64).view(np.uint64) * factors[:8]).sum(axis=2, dtype=np.uint64)
        codes += group.view(np.uint64)[:, None] * factors[8] + np.uint64(t)
        codes ^= codes >> np.uint64(31)
        codes *= np.uint64(0x94D049BB133111EB)
        out[:, t] = codes ^ (codes >> np.uint64(29))
    return out.view(np.int64)


def counted_here(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the smallest of the keys at which each pair meets; a, b: keys (pair, table, 1 + probes)."""
    far = np.iinfo(np.int64).max
    first = np.where(a[:, :, :1] == b, b, far).min(axis=(1, 2))
    other = np.where(b[:, :, :1] == a, a, far).min(axis=(1, 2))
    return np.minimum(first, other) == key


def compare(key: int, left: np.ndarray, right: np.ndarray, rows: np.ndarray, home: np.ndarray, keys: np.ndarray, copies: np.ndarray, threshold: float):
    """Links of each member from the pairs (left, right), once each, and the smallest member it is connected to.

    ``left`` and ``right`` are positions of members; equal arrays stand for the pairs within.
    """
    links = np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))
    within = left is right
    a_found, b_found = [], []
    for k in range(0, len(left), 512):
        part = left[k : k + 512]
        near = rows[part] @ rows[right].T >= threshold - 1e-9
        near &= home[part][:, None] | home[right]
        if within:
            near &= part[:, None] < right
        i, j = np.nonzero(near)
        a, b = part[i], right[j]
        for c in range(0, len(a), 100_000):
            x, y = a[c : c + 100_000], b[c : c + 100_000]
            sure = ((rows[x] * rows[y]).sum(axis=1) >= threshold) & counted_here(key, keys[x], keys[y])
            x, y = x[sure], y[sure]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            a_found.append(x)
            b_found.append(y)
    a, b = np.concatenate(a_found or [left[:0]]), np.concatenate(b_found or [left[:0]])
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return links, root


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links): partial numbers of links per vector, and another one (or itself) that it is connected to."""
    index = classes.select("id", F.posexplode(F.flatten("keys")).alias("pos", "key"))
    index = index.select("id", "key", (F.col("pos") % (1 + PROBES) == 0).alias("home"))
    cells = index.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("home and n > 1")
    cells = cells.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    met = index.join(cells, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("id", F.col("key").alias("cell"), "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = met.join(classes, "id").withColumn("key", F.xxhash64("cell", "i", "j"))
    rows = rows.repartition("key").sortWithinPartitions("key", "cell", "i", "j", "id")

    def run(batches):
        for table in whole_groups(batches, BATCH_ROWS):
            cell, i, j, block = (table.column(c).to_numpy() for c in ("cell", "i", "j", "block"))
            new = np.append(True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            starts = np.append(np.flatnonzero(new), len(cell))
            ids, home, copies = table.column("id").to_numpy(), table.column("home").to_numpy(), table.column("copies").to_numpy()
            keys = matrix_of_keys(table.column("keys"))
            out = [[], [], []]
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2 or not home[s:e].any():
                    continue
                vectors = unit(matrix(table.column("vector").slice(s, e - s)))
                left = np.flatnonzero(block[s:e] == i[s])
                right = left if i[s] == j[s] else np.flatnonzero(block[s:e] == j[s])
                n, root = compare(cell[s], left, right, vectors, home[s:e], keys[s:e], copies[s:e], threshold)
                hit = np.flatnonzero(n)
                for k, values in enumerate((ids[s:e][hit], ids[s:e][root[hit]], n[hit])):
                    out[k].append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["id", "root", "links"])

    return rows.mapInArrow(run, "id long, root long, links long")


def matrix_of_keys(column) -> np.ndarray:
    flat = column.combine_chunks().flatten().flatten().to_numpy()
    return flat.reshape(len(column), -1, 1 + PROBES)


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) per row.

    Only rows with equal labels that are not null, and of equal length, are compared. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and are components of their own. Copies, repeated
    ids included, are linked with each other. Ids are long and not null.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    # Two hashes stand for label and vector: equal ones make a class.
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "vector"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64("vector", "label", F.lit(1))))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("vector", "id").alias("vector"),
                                                       F.min(F.xxhash64("label", F.size("vector"))).alias("kind"))
    vector_type = df.schema[vector_col].dataType.simpleString()

    def file(batches):
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = cell_keys(unit(matrix(part.column("vector"))), part.column("kind").to_numpy(), TABLES, PROBES, SPACING)
                nested = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size // (1 + PROBES) + 1, TABLES, dtype=np.int32)),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 1 + PROBES, dtype=np.int32)), pa.array(keys.ravel())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h1", "h2", "id", "copies", "vector")), nested],
                                                 ["h1", "h2", "id", "copies", "vector", "keys"])

    filed = checkpointed(classes.mapInArrow(file, f"h1 long, h2 long, id long, copies long, vector {vector_type}, keys array<array<long>>"))
    found = checkpointed(links(filed.select("id", "copies", "vector", "keys"), threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "root")
    known = filed.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(components, F.col("id") == F.col("node"), "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # Rows without a usable vector keep null hashes and match nothing; a random key keeps them from meeting in one task.
    out = rows.select("id", F.coalesce("h1", F.xxhash64("id")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))
