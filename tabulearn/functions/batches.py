"""Arrow-batch helpers: dense vectors in, per-partition sums out."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal-length vectors as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def vector(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def summed(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum a vector statistic over all rows.

    ``part(batch) -> ndarray(size)`` runs on Arrow batches; each partition
    emits one partial vector, which Spark then sums by position.
    """

    def run(batches):
        acc = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                acc += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = (
        df.mapInArrow(run, "v array<double>")
        .select(F.posexplode("v").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


def item_counts(df: DataFrame, keep: list, items: str, out: str, n: str = "n") -> DataFrame:
    """(keep.., out, n): how often each text of the array ``items`` stands in its row."""
    names = [*keep, out, n]

    def run(batches):
        for batch in batches:
            lists = batch.column(items)
            coded = pc.list_flatten(lists).dictionary_encode()
            rows, size = vector(pc.list_parent_indices(lists)).astype(np.int64), max(len(coded.dictionary), 1)
            found = pc.value_counts(pa.array(rows * size + vector(coded.indices).astype(np.int64), pa.int64()))
            at = vector(found.field("values"))
            row = pa.array(at // size)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(row) for c in keep], coded.dictionary.take(pa.array(at % size)), found.field("counts")], names)

    fields = [*df.select(*keep).schema.fields, T.StructField(out, T.StringType()), T.StructField(n, T.LongType())]
    return df.select(*keep, items).mapInArrow(run, T.StructType(fields))


GRAM_LETTERS = 1_000_000  # bytes of words whose n-grams are counted together


def grams_of(words: list, low: int, high: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct n-grams of the words, where each word's begin, and their numbers; a word shorter than ``low`` gives itself once."""
    places, found, ends = {}, [], np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(words):
        for n in range(low, high + 1):
            if len(w) >= n:
                found.extend([places.setdefault(w[j:j + n], len(places)) for j in range(len(w) - n + 1)])
            elif n == low:
                found.append(places.setdefault(w, len(places)))
        ends[i + 1] = len(found)
    return list(places), ends, np.array(found, np.int64)


def gram_counts(df: DataFrame, keep: list, words: str, out: str, low: int, high: int, n: str = "n") -> DataFrame:
    """(keep.., out, n): the n-grams of the array ``words`` of each row, every word with a space on both sides. A distinct word is cut once per block of rows."""
    names = [*keep, out, n]

    def counted(part):
        lists = part.column(words)
        coded = pc.list_flatten(lists).dictionary_encode()
        size = max(len(coded.dictionary), 1)
        pairs, times = np.unique(vector(pc.list_parent_indices(lists)).astype(np.int64) * size + vector(coded.indices), return_counts=True)
        row, word = pairs // size, pairs % size
        grams, ends, at = grams_of([f" {w} " for w in coded.dictionary.to_pylist()], low, high)
        many = (ends[1:] - ends[:-1])[word] if len(word) else np.zeros(0, np.int64)
        within = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        keys = np.repeat(row, many) * max(len(grams), 1) + at[np.repeat(ends[word], many) + within]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.repeat(times, many)[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums, keys = np.add.reduceat(times, first) if len(first) else times, keys[first]
        row, gram = pa.array(keys // max(len(grams), 1)), pa.array(keys % max(len(grams), 1))
        return pa.RecordBatch.from_arrays([*[part.column(c).take(row) for c in keep], pa.array(grams, pa.string()).take(gram), pa.array(sums, pa.int64())], names)

    def run(batches):
        for batch in batches:
            lists = batch.column(words)
            sizes = vector(pc.binary_length(pc.list_flatten(lists))) + 2
            letters = np.bincount(vector(pc.list_parent_indices(lists)).astype(np.int64), sizes, minlength=batch.num_rows).cumsum()
            start = 0
            while start < batch.num_rows:
                before = letters[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(letters, before + GRAM_LETTERS, "right")))
                yield counted(batch.slice(start, stop - start))
                start = stop

    fields = [*df.select(*keep).schema.fields, T.StructField(out, T.StringType()), T.StructField(n, T.LongType())]
    return df.select(*keep, words).mapInArrow(run, T.StructType(fields))
