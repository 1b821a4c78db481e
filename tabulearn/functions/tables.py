"""Table building blocks: sufficient statistics, salted joins, prefix sums."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(df: DataFrame, keys: list, sums: dict) -> DataFrame:
    """One row per distinct key with summed statistics.

    Rows with equal keys behave alike in every later round, so the rounds work
    on the distinct keys. The sum is partial before the shuffle, so a key
    holding most rows still costs one row per input partition.
    """
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def worth_collapsing(rows: int, distinct: int) -> bool:
    return distinct * 2 <= rows


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def within(df: DataFrame, rows: int, size: int = None) -> bool:
    """Whether a table has at most ``rows`` rows and about ``size`` bytes; one aggregate."""
    def width(field):
        kind = field.dataType.typeName()
        if kind == "string":
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        return F.greatest(F.size(field.name), F.lit(0)) * 8 + 8 if kind == "array" else F.lit(8)

    found = df.agg(F.count("*").alias("n"), F.sum(sum((width(f) for f in df.schema.fields), F.lit(0))).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= (BROADCAST_BYTES if size is None else size)


def keyed_join(big: DataFrame, small: DataFrame, key: str, salt_from: Column, how: str = "inner", salts: int = 16,
               broadcast_rows: int = None) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a large share of the rows.

    ``small`` has one row per key and is cheap to count (written out). Up to
    ``broadcast_rows`` rows and ``BROADCAST_BYTES`` it is copied to every task;
    beyond, ``big`` is spread over salts and ``small`` is repeated once per salt.
    With one salt both are joined as they lie: for keys like tokens, whose rows
    are few beside a task's share, a copy per salt would cost more than it saves.
    A task then holds its part of ``small``; the rows of ``big`` pass by unsorted,
    so a hot key takes no memory.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if within(small, limit):
        return big.join(F.broadcast(small), key, how)
    if salts == 1:
        return big.join(small.hint("shuffle_hash"), key, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def quantile_cuts(df: DataFrame, columns: list, max_distinct: int, buckets: int) -> dict:
    """Cut points for the columns with many distinct values; one aggregate job.

    The cuts only decide how an ordered scan is spread over tasks, so their
    approximation never changes a result.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, shares, buckets * 20).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: sorted({float(v) for v in row[f"q{i}"]})
        for i, c in enumerate(columns)
        if row[f"q{i}"] is not None and row[f"d{i}"] > max_distinct
    }


def bucket_of(value: Column, cuts) -> Column:
    """Number of cut points below the value."""
    if not cuts:
        return F.lit(0)
    from tabulearn.functions.columns import literal_array

    return F.size(F.filter(literal_array(cuts), lambda c: c < value))


def ordered_totals(hist: DataFrame, keys: list, order: str, sums: list, bucketed: bool) -> DataFrame:
    """Running sums (inclusive) and neighbours of each value within its keys.

    ``hist`` has one row per (keys, value). Adds ``c_<s>`` running and
    ``t_<s>`` total sums, ``nxt`` the next value and ``lowest`` the first one.
    With ``bucketed`` the input has a ``bucket`` column that rises with the
    value: running sums are taken over the few buckets first and then inside
    each bucket, so no task holds all values of one key.
    """
    if not bucketed:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return hist.select(
            "*",
            *[F.sum(s).over(upto).alias(f"c_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"t_{s}") for s in sums],
            F.lead(order).over(whole.orderBy(order)).alias("nxt"),
            F.min(order).over(whole).alias("lowest"),
        )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hist.groupBy(*keys, "bucket")
        .agg(F.min(order).alias("_first"), *[F.sum(s).alias(s) for s in sums])
        .select(
            *keys, "bucket",
            *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(f"o_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"t_{s}") for s in sums],
            F.lead("_first").over(whole.orderBy("bucket")).alias("_next_bucket"),
            F.min("_first").over(whole).alias("lowest"),
        )
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = hist.join(offsets, [*keys, "bucket"])
    return joined.select(
        *hist.columns,
        *[(F.sum(s).over(upto) + F.col(f"o_{s}")).alias(f"c_{s}") for s in sums],
        *[f"t_{s}" for s in sums],
        F.coalesce(F.lead(order).over(inside), F.col("_next_bucket")).alias("nxt"),
        "lowest",
    )
