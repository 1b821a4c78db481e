"""Approximate nearest neighbours by vantage-point trees per shard (operator 6).

The largest inner product becomes the smallest distance when each candidate gets one more component that brings all to
the same length. Every shard is one tree: a vantage point, the candidates split at the median distance to it, and so
on to leaves. Queries visit their home leaf first and then the tree, skipping a child if ``factor`` times the distance
that the triangle inequality guarantees exceeds the worst of the best found so far. Factor one is exact search.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulearn.llm.vectors import usable
from tabulearn.session import checkpointed

SHARD_ROWS, QUERY_ROWS = 32_768, 8_192
LEAST_SHARD, SHARDS = 2_048, 16
LEAF = 64
FACTOR = 6.0
RANK_BITS = 16
NONE = np.iinfo(np.int64).min


class VantageTree:
    """Rows of one shard, ordered so that each node is a range; rows come in ascending id order."""

    def __init__(self, rows: np.ndarray, radius: float, leaf: int = LEAF):
        self.rows, self.radius = rows, radius
        rest = np.sqrt(np.maximum(radius**2 - (rows * rows).sum(axis=1), 0))
        self.points = np.column_stack([rows, rest])
        self.order = np.arange(len(rows))
        self.nodes = []  # (start, end, vantage row, children); a child: (node, nearest, farthest distance to the vantage)
        self.root = self.build(0, len(rows), leaf)

    def build(self, start: int, end: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if end - start <= leaf:
            self.nodes[at] = (start, end, -1, ())
            return at
        inside = self.order[start:end]
        vantage = inside[0]
        d = np.sqrt(((self.points[inside] - self.points[vantage]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        self.order[start:end] = inside[by]
        d, half = d[by], (end - start) // 2
        children = []
        for lo, hi in ((0, half), (half, end - start)):
            # Another vantage point for the child: its farthest row.
            part = self.order[start + lo : start + hi]
            part[[0, -1]] = part[[-1, 0]]
            children.append((self.build(start + lo, start + hi, leaf), d[lo], d[hi - 1]))
        self.nodes[at] = (start, end, vantage, tuple(children))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, int]:
        """Rows of the k nearest of each query (-1: none) except row ``own``, and how many comparisons it took.

        Products are kept as integers of 2**-40 of the largest possible one, with the row behind, so that equal ones
        go to the smaller id whatever the order of visits.
        """
        n = len(queries)
        length = np.sqrt((queries * queries).sum(axis=1))
        scale = 2.0**40 / max(self.radius * length.max(initial=0), 1e-300)
        best = np.full((n, k), NONE)
        worst = np.full(n, np.inf)
        compared = 0
        size2 = self.radius**2 + length**2

        def visit(node, who):
            nonlocal compared
            start, end, _, _ = self.nodes[node]
            rows = self.order[start:end]
            dots = queries[who] @ self.rows[rows].T
            codes = (np.rint(dots * scale).astype(np.int64) << RANK_BITS) + ((1 << RANK_BITS) - 1 - rows)
            codes[rows == own[who][:, None]] = NONE
            both = np.concatenate([best[who], codes], axis=1)
            both = -np.partition(-np.maximum(both, NONE + 1), k - 1, axis=1)[:, :k]
            best[who] = both
            least = both.min(axis=1)
            known = least > NONE + 1
            dot = (least >> RANK_BITS) / scale
            worst[who] = np.where(known, np.sqrt(np.maximum(size2[who] - 2 * dot, 0)), np.inf)
            compared += dots.size

        def distance(vantage, who):
            return np.sqrt(np.maximum(size2[who] - 2 * (queries[who] @ self.rows[vantage]), 0))

        home = np.full(n, -1)
        todo = [(self.root, np.arange(n))] if len(self.rows) else []
        while todo:
            node, who = todo.pop()
            _, _, vantage, children = self.nodes[node]
            if not children:
                home[who] = node
                visit(node, who)
                continue
            d = distance(vantage, who)
            inner = d <= (children[0][2] + children[1][1]) / 2
            todo += [(c[0], who[m]) for c, m in zip(children, (inner, ~inner)) if m.any()]

        todo = [(self.root, np.arange(n))] if len(self.rows) else []
        while todo:
            node, who = todo.pop()
            _, _, vantage, children = self.nodes[node]
            if not children:
                who = who[home[who] != node]
                if len(who):
                    visit(node, who)
                continue
            d = distance(vantage, who)
            for child, low, high in children:
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                go = factor * bound <= worst[who] + 1e-9
                if go.any():
                    todo.append((child, who[go]))
        rows = (1 << RANK_BITS) - 1 - (best & ((1 << RANK_BITS) - 1))
        return np.where(best > NONE + 1, rows, -1), compared


def nearest(df: DataFrame, is_query, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) of the k rows with the largest inner product with each query row.

    Rows that ``is_query`` holds for are searched against all rows but those with their own id; equal scores go to
    the smaller id, and a query with fewer candidates gets all. Vectors that are null, empty, zero, hold null or
    non-finite components, or have another length than most take no part. Rows repeated in full count once. Of equal
    vectors only the k + 1 smallest ids can be among the k nearest, so the others are left out of the trees.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = rows.where(F.size("v") == lengths["size"])
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.select("id", "v").withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).groupBy("v", "id").count().select("id", "v")
    kept = checkpointed(kept)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    about = kept.agg(F.count("*").alias("n"), F.max(norm).alias("radius")).first()
    queries = checkpointed(rows.where("asks").select("id", "v").distinct())
    n_queries = queries.count()
    shards = max(-(-about["n"] // SHARD_ROWS), min(SHARDS, -(-about["n"] // LEAST_SHARD)), 1)
    # Hash shares vary a little; the trees number their rows with 16 bits, twice the size aimed at.
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    radius = float(about["radius"]) * (1 + 1e-12)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    left = kept.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        rows = rows.sort_values("id", kind="stable")
        ids, points = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
        tree = VantageTree(points, radius)
        wanted, vectors = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy())
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        found, _ = tree.search(vectors, np.where(ids[at] == wanted, at, -1), k, factor)
        who, place = np.nonzero(found >= 0)
        hit = found[who, place]
        # The measure itself, each product summed in the same order.
        score = np.concatenate([(vectors[who[c : c + 65536]] * points[hit[c : c + 65536]]).sum(axis=1) for c in range(0, len(who), 65536)] or [np.zeros(0)])
        return pd.DataFrame({"query_id": wanted[who], "id": ids[hit], "score": score})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
