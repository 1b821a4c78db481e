"""Mixing sources to target weights by capped water-filling (operator 2).

Targets rise in proportion to the weights until a source reaches its cap of ``max_epochs`` times its size; such
sources are clamped and the rest is shared again until none is above. A source is then taken as often as its target
holds it whole, and a seeded part of its documents once more.
"""

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulearn.llm.frames import WORD
from tabulearn.session import checkpointed

BUCKET_ROWS = 2000
PLAN_ROWS = 20_000  # sources, of some hundred bytes each


def ranked(df: DataFrame, *order) -> DataFrame:
    """Adds ``pos``, the place in this order from 0, by ranges; only the counts per range reach the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_row", 33).alias("part")).count().orderBy("part").collect()
    start, before = [], 0
    for r in counts:
        start += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if not counts:
        return placed.withColumn("pos", F.col("_row")).drop("_row")
    first = F.create_map(*start)[F.shiftright("_row", 33)]
    return placed.withColumn("pos", first + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight). One aggregate a round; the level only rises."""
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        full = cap < F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            return sources.withColumn("target", cap)
        new = (budget - (row["held"] or 0.0)) / row["w"]
        if new <= level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * level))
        level = new


def sized(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list:
    """Columns (source, size, mark): words of the text (null: 0), and a seeded hash of id and text that puts a source's rows in order."""
    size = F.coalesce(F.size(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))), F.lit(0))
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(size).cast("long")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    mark = F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]).cast("binary"))
    return [F.col(source_col).alias("source"), size.alias("size"), mark.alias("mark")]


def plan(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, source_size, target, whole, last_mark, last_taken, last_all) per source.

    All documents of a source are taken ``whole`` times, and those before ``last_mark`` in its order once more; of the
    ``last_all`` rows with that mark, which agree in id and text, ``last_taken`` are. Rows of one mark are one row with a
    count, and hash buckets per source keep every window small, however large the source; the result depends on neither.
    """
    rows = checkpointed(df.select(*sized(df, seed, id_col, text_col, source_col)))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = checkpointed(ranked(per_source, F.col("source").asc_nulls_last()))
    total = per_source.agg(F.sum("source_size").alias("words"), F.sum("n").alias("n")).first()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = per_source.withColumn("weight", F.element_at(turn, (F.col("pos") % len(weights) + 1).cast("int")))
    targets = water_fill(sources, share * (total["words"] or 0), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.select(F.col("source").alias("of"), "source_size", F.col("target").cast("double").alias("target"), whole.alias("whole"))

    digits = max(1, min(5, ceil(log2(max(total["n"] or 1, BUCKET_ROWS) / BUCKET_ROWS) / 4)))
    rows = rows.withColumn("bucket", F.substring("mark", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("held").over(run), F.lit(0)))
    buckets = buckets.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    # Only the bucket in which the rest of the target ends needs an order of its rows.
    cut = buckets.where((F.col("before") <= rest) & (F.col("before") + F.col("held") > 0)).select(F.col("of").alias("cut_of"), F.col("bucket").alias("cut"), "before", rest.alias("rest"))
    marks = rows.groupBy("source", "bucket", "mark").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = marks.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    placed = placed.join(cut, F.col("source").eqNullSafe(F.col("cut_of")) & (F.col("bucket") == F.col("cut"))).where("rest > 0")
    # Row j of a mark is taken if its middle word is inside the rest: 2 (before + inside + j size) + size <= 2 rest.
    room = F.col("rest") - F.col("before") - F.col("inside")
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("n")).otherwise(F.lit(0)))
    taken = placed.withColumn("fits", F.least(F.col("n"), fits).cast("long")).where("fits > 0")
    last = taken.groupBy("source").agg(F.max(F.struct("mark", "fits", "n")).alias("last")).select(F.col("source").alias("last_of"), "last")
    found = targets.join(last, F.col("of").eqNullSafe(F.col("last_of")), "left")
    return checkpointed(found.select("of", "source_size", "target", "whole", F.col("last.mark").alias("last_mark"),
                                     F.col("last.fits").alias("last_taken"), F.col("last.n").alias("last_all")))


def repeats(rows: DataFrame) -> DataFrame:
    """Adds how often a row beside its source's plan is taken.

    Where only some of the rows with the last mark fit, these rows are numbered and the first of them taken; they agree
    in id and text, so it doesn't matter which.
    """
    split = F.coalesce((F.col("mark") == F.col("last_mark")) & (F.col("last_taken") < F.col("last_all")), F.lit(False))
    once_more = F.coalesce(F.col("mark") <= F.col("last_mark"), F.lit(False)).cast("int")
    sure = rows.where(~split).withColumn("repeats", F.col("whole") + once_more)
    if rows.where(split).select("mark").isEmpty():
        return sure
    tied = checkpointed(rows.where(split).withColumn("_turn", F.monotonically_increasing_id()))
    tied = ranked(tied, F.col("source"), F.col("_turn"))
    first = tied.groupBy("source").agg(F.min("pos").alias("first")).select(F.col("source").alias("first_of"), "first")
    tied = tied.join(first, F.col("source").eqNullSafe(F.col("first_of")))
    return sure.unionByName(tied.withColumn("repeats", F.col("whole") + (F.col("pos") - F.col("first") < F.col("last_taken")).cast("int")).select(sure.columns))


def with_plan(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows beside their source's plan; a plan of at most ``PLAN_ROWS`` sources goes to every task, so the rows aren't shuffled."""
    small = found.count() <= PLAN_ROWS
    return rows.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("of")))


def mix(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, repeats, taken) per row.

    Sources by code point, null last (null is a source of its own), take the weights in turn. The part that is taken
    once more is the documents in the order of a seeded hash of id and text, as long as their middle word is inside the
    rest of the target, so a source misses its target by half a document at most, also if ids repeat or are null. Rows
    without words count none.
    """
    found = plan(df, weights, share, max_epochs, seed, id_col, text_col, source_col)
    rows = df.select(F.col(id_col).alias("id"), *sized(df, seed, id_col, text_col, source_col))
    rows = repeats(with_plan(rows, found))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_rows(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows themselves, as often as the mix takes each, with their columns."""
    found = plan(df, weights, share, max_epochs, seed, id_col, text_col, source_col)
    rows = df.select(F.struct(*df.columns).alias("row"), *sized(df, seed, id_col, text_col, source_col))
    rows = repeats(with_plan(rows, found)).where("repeats > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "repeats")).alias("turn")).select("row.*")
