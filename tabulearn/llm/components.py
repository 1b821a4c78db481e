"""Connected components of an edge table by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.session import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and itself.

    ``edges`` has rows a > b. The large round moves the larger neighbours, the small round the smaller ones and the node.
    """
    turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        turned = turned.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Only minima are gathered per node, with partial minima before the shuffle; a node's neighbours never meet in one list.
    least = turned.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = turned.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another one; the component is its smallest node.

    Each round is written to the checkpoint folder. Rounds end when nothing moves: every node then hangs on the
    smallest of its component. The number of rounds grows with the logarithm of the longest chain.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now = checkpointed(now)
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen["n"]:
            break
        mark = seen
        now = checkpointed(star(star(now, True), False))
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
