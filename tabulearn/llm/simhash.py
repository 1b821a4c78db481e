"""SimHash near-dedup by deletion-variant signatures (operator 4).

A 64-bit fingerprint is cut into so few segments that two fingerprints within the allowed distance agree in one
segment up to a single bit. Each segment is indexed under its one-wildcard variants, which are the segment with one
bit left out; fingerprints that share a variant meet in an equality join and their full distance is verified.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulearn.llm.components import connected_components
from tabulearn.llm.frames import forget
from tabulearn.session import checkpointed

BITS = 64
SEED = 42
SHINGLE_BLOCK = 100_000
BUCKET_PAIRS = 64  # a variant with more fingerprints is compared in blocks
BUCKET_BLOCK = 1024


def fingerprint(text: str, words: int) -> bytes:
    """Eight bytes, most significant first; all zero for a text without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return bytes(8)
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), SHINGLE_BLOCK):
        block = slice(at, at + SHINGLE_BLOCK)
        hashes = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts[block].tolist(), ends[block].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprints(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long) per row; null and empty texts have fingerprint zero."""

    def run(batches):
        forget()
        for batch in batches:
            raw = b"".join([fingerprint(t.as_py() or "", words) for t in batch.column(1)])
            fp = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def segments(distance: int, n: int = None) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` segments, by default the fewest of which one differs in at most one bit."""
    n = n or distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int, n: int = None) -> DataFrame:
    """(key, fp): each segment with each of its bits left out; the key holds the place of the bit as well."""
    keys = []
    for lo, width in segments(distance, n):
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            keep = ((1 << width) - 1) & ~(1 << bit)
            keys.append(part.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.lit((lo + bit) << 50).cast("long")) if width < 50
                        else F.xxhash64(part.bitwiseAND(F.lit(keep).cast("long")), F.lit(lo + bit)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def far_apart(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def forest(left: np.ndarray, right: np.ndarray, distance: int) -> pd.DataFrame:
    """Links that connect what is connected between (and, if they are the same, within) two blocks."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": left[:0].view(np.int64), "b": left[:0].view(np.int64)})
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= distance
    nodes = np.concatenate([left, right])
    label = np.arange(len(nodes))
    of_left, of_right = label[: len(left)], label[len(left) :]
    while True:
        before = label.copy()
        big = len(nodes)
        np.minimum(of_right, np.where(near, of_left[:, None], big).min(axis=0), out=of_right)
        np.minimum(of_left, np.where(near, of_right[None, :], big).min(axis=1), out=of_left)
        label[:] = label[label]
        if (label == before).all():
            break
    apart = nodes != nodes[label]
    return pd.DataFrame({"a": nodes[apart].view(np.int64), "b": nodes[label[apart]].view(np.int64)})


def links(fps: DataFrame, distance: int, n: int = None) -> DataFrame:
    """Edges (a, b) between different fingerprints that leave the same components as all pairs within the distance.

    ``fps`` has distinct values. Variants with few fingerprints give their verified pairs. Larger ones, as groups of
    near copies make them, are cut into blocks; each pair of blocks gives one spanning forest, never its pairs.
    """
    met = variants(fps, distance, n).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    met = checkpointed(met)
    few = met.where(F.col("n") <= BUCKET_PAIRS).select("key", "fp")
    pairs = few.join(few.withColumnRenamed("fp", "other"), "key").where((F.col("fp") < F.col("other")) & (far_apart("fp", "other") <= distance))
    pairs = pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    many = met.where(F.col("n") > BUCKET_PAIRS)
    n_blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    many = many.select("key", "fp", n_blocks.alias("nb"), F.pmod(F.xxhash64("fp"), n_blocks).cast("int").alias("block"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    many = many.select("key", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp, block = rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy()
        return forest(fp[block == rows["i"].iat[0]], fp[block == rows["j"].iat[0]], distance)

    dense = many.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.unionByName(dense)


def near_duplicates(df: DataFrame, words: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    n_segments: int = None) -> DataFrame:
    """(id_col, fingerprint, component_id) per row: 16 hex digits, and the smallest id reachable over links.

    Rows with equal fingerprints are one node. Rows without words have fingerprint zero and are linked like any
    other. Null ids stay in the result and are never the smallest unless a component has no other id. With fewer
    ``n_segments`` than the distance needs, all links up to 2 * n_segments - 1 bits are found and most beyond.
    """
    rows = checkpointed(fingerprints(df, words, id_col, text_col))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = checkpointed(connected_components(links(nodes.select("fp"), distance, n_segments)))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(df: DataFrame, words: int = 4, distance: int = 4, n_segments: int = None, id_col: str = "doc_id", text_col: str = "text",
                  without_id_stay: bool = True) -> DataFrame:
    """The rows that stay, with their columns: of each component the first by id (null last), then by a hash of all columns.

    Rows that agree in all columns are one. With ``without_id_stay``, rows with null ids all stay besides; else they are
    rows like any other. By default all links within the distance are found; shingles are not compared beside the bits.
    """
    # A hash of columns passes over nulls, so it takes their places as well.
    mark = F.xxhash64(*df.columns, F.concat(*[F.col(c).isNull().cast("string") for c in df.columns]))
    key = F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), mark.alias("mark"))
    named = df.select(key.alias("key"), F.col(text_col).alias("text"), F.struct(*df.columns).alias("row"))
    found = near_duplicates(named, words, distance, "key", "text", n_segments)
    stays = found.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("stays")).distinct()
    kept = named.join(stays, F.col("key") == F.col("stays"), "left_semi").select("key", "row").dropDuplicates(["key"])
    if without_id_stay:
        kept = kept.where("not key.without").unionByName(named.where("key.without").select("key", "row"))
    return kept.select("row.*")
