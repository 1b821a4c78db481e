"""Small helpers shared by the operators of this folder."""

import ctypes
import gc
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(folds)


def thinned(mark: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash falls into a share that holds about twice the wanted rows of ``total``.

    A sample of fixed size is then taken from few rows, however many tasks they come from.
    """
    share = min(1.0, 2 * wanted / max(total, 1))
    return F.lit(True) if share == 1.0 else F.shiftrightunsigned(mark, 1) < F.lit(int(share * 2**63))


def chunks(values, sizes, most: int):
    """Consecutive slices of ``values`` whose sizes add up to about ``most``; a single larger value stands alone."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield values[start:at]
            start, total = at, 0
        total += size
    if start < len(values):
        yield values[start:]


def text_lists(column: pa.Array, most: int):
    """Lists of the texts of consecutive rows with about ``most`` bytes together; null is empty. A batch never becomes strings as a whole."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for rows in chunks(range(len(column)), sizes, most):
        yield column.slice(rows[0], len(rows)).fill_null("").to_pylist()


def blocks(items, most: int):
    """Lists of at most ``most`` items of an iterator."""
    items = iter(items)
    while block := list(islice(items, most)):
        yield block


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without a copy, and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


HELD = {}


def held(call: str, make):
    """What ``make`` gives, once per Python worker for all its tasks of one call. Of all operators only the latest call's is kept."""
    if call not in HELD:
        forget()
        HELD[call] = make()
    return HELD[call]


def forget():
    """Give back what a reused worker holds of earlier operators, to the system where the C library can."""
    HELD.clear()
    trimmed()


def trimmed():
    """Give free memory back to the system where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def given_back(run):
    """A task's function that starts with ``forget`` and ends with it, when its own batches are gone too: idle workers stay small."""
    def whole(batches):
        forget()
        yield from run(batches)
        forget()

    return whole
