"""Counted tokens packed by document: what each step of a fit over all documents reads.

A block is one row and holds the counts of some documents as compressed arrays, with each of its tokens once. A step
then moves numbers per block and distinct token of the block, not per document and token. Up to ``SENT_NUMBERS`` weights
go to every task; beyond, each block meets the weights of its own tokens, which lie dealt out by token in ``places``.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.batches import vector
from tabulearn.functions.columns import label_code
from tabulearn.session import checkpointed, configured, laid_out, released

SENT_NUMBERS = 4_000_000  # weights that are copied to every task
SLICE_NUMBERS = 100_000  # of a sum over all tokens, added up by one task


def pressed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unpressed(value, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(value.as_buffer(), n * np.dtype(kind).itemsize, codec="zstd"), kind)


class Block:
    """One row as arrays: per count its document ``row``, token ``code``, number ``n`` and class ``c`` (-1: none)."""

    def __init__(self, batch, i: int):
        ends = np.frombuffer(batch.column("ends")[i].as_buffer(), np.int64)
        self.docs, size = len(ends), int(ends[-1])
        self.row = np.repeat(np.arange(self.docs), np.diff(ends, prepend=0))
        self.starts = np.concatenate([[0], ends[:-1]])
        self.code = unpressed(batch.column("codes")[i], size, np.int32)
        self.n = unpressed(batch.column("n")[i], size, np.int32).astype(float)
        self.c = unpressed(batch.column("c")[i], size, np.int16)
        self.batch, self.i = batch, i

    def number(self) -> int:
        return self.batch.column("block")[self.i].as_py()

    def items(self, name: str):
        """An array column of the row; its nulls are kept."""
        column = self.batch.column(name)
        return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[self.i].values

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.column_stack([np.add.reduceat(self.n * w[self.code, j], self.starts) for j in range(w.shape[1])])

    def sums(self, p: np.ndarray, size: int) -> np.ndarray:
        """Per token of the block, its counts times the numbers of their documents."""
        return np.column_stack([np.bincount(self.code, self.n * p[self.row, j], minlength=size) for j in range(p.shape[1])])

    def observed(self, k: int, size: int) -> np.ndarray:
        return np.column_stack([np.bincount(self.code, self.n * (self.c == j), minlength=size) for j in range(k)])


def shares(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def from_lists(column, k: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


@dataclass
class Packed:
    table: DataFrame  # block, ids, tokens, ends, codes, n, c: dealt out by block
    parts: int
    kind: T.DataType  # of the ids
    _places: list = field(default_factory=list)

    def at_home(self, df: DataFrame) -> DataFrame:
        """Written with this many tasks, each row where its token's rows lie."""
        spark = df.sparkSession
        with configured(spark, {"spark.sql.shuffle.partitions": str(self.parts), "spark.sql.adaptive.enabled": "false"}):
            return checkpointed(df)

    def places(self) -> DataFrame:
        """(token, home, place): the tokens of each block, dealt out by token."""
        if not self._places:
            rows = self.table.select(F.col("block").alias("home"), F.posexplode("tokens").alias("place", "token"))
            self._places.append(self.at_home(rows.repartition(self.parts, "token")))
        return self._places[0]

    def tokens(self) -> DataFrame:
        return self.at_home(self.places().groupBy("token").agg(F.count("*").alias("n")).select("token"))

    def of_blocks(self, number) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(number(Block(batch, i))) for i in range(batch.num_rows)], pa.int64())], ["m"])

        return self.table.mapInArrow(run, "m long")

    def largest(self) -> int:
        """The largest sum of a document."""
        return self.of_blocks(lambda b: np.add.reduceat(b.n, b.starts).max()).agg(F.max("m")).first()[0]

    def total(self) -> int:
        return self.of_blocks(lambda b: b.n.sum()).agg(F.sum("m")).first()[0]

    def met(self, weights: DataFrame, k: int, result, schema) -> DataFrame:
        """``result(block, its weights)``, a record batch per block; a token without weights has zeros."""
        sent = self.places().join(weights.select("token", "w").hint("shuffle_hash"), "token").select("home", "place", "w")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return empty
            block = Block(right, 0)
            w = np.zeros((len(block.items("tokens")), k))
            if left.num_rows:
                w[left.column("place").to_numpy()] = from_lists(left.column("w"), k)
            return pa.Table.from_batches([result(block, w)])

        empty = pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, self._arrow(schema))})
        with configured(weights.sparkSession, {"spark.sql.shuffle.partitions": str(self.parts)}):
            return sent.groupBy("home").cogroup(self.table.groupBy("block")).applyInArrow(run, schema)

    @staticmethod
    def _arrow(schema):
        from pyspark.sql.pandas.types import to_arrow_type

        return [to_arrow_type(f.dataType) for f in schema.fields]

    def results(self, weights: DataFrame, k: int, result, schema, small: bool = None) -> DataFrame:
        """``met``, or the same with the weights sent to every task if they are ``small``."""
        if not (weights.count() * k <= SENT_NUMBERS if small is None else small):
            return self.met(weights, k, result, schema)
        found = weights.select("token", "w").toArrow()
        send = weights.sparkSession.sparkContext.broadcast((found["token"].combine_chunks(), from_lists(found["w"], k)))

        def run(batches):
            vocab, all_w = send.value
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(batch, i)
                    at = vector(pc.fill_null(pc.index_in(block.items("tokens"), value_set=vocab), -1)) if len(vocab) else np.full(len(block.items("tokens")), -1)
                    w = np.zeros((len(at), k))
                    w[at >= 0] = all_w[at[at >= 0]]
                    yield result(block, w)

        return self.table.mapInArrow(run, schema)

    def scores(self, weights: DataFrame, k: int, id_col: str) -> DataFrame:
        """(id, jll) of the documents that have counts."""
        schema = T.StructType([T.StructField(id_col, self.kind), T.StructField("jll", T.ArrayType(T.DoubleType()))])
        return self.results(weights, k, lambda block, w: pa.RecordBatch.from_arrays([block.items("ids"), lists(block.scores(w))], [id_col, "jll"]), schema)

    def per_token(self, found: DataFrame, k: int, n: float, out: str) -> DataFrame:
        """Sums of the blocks' (token, m), over ``n``."""
        return found.groupBy("token").agg(F.array(*[F.sum(F.get("m", F.lit(j))) / F.lit(float(n)) for j in range(k)]).alias(out))


TOKEN_SUMS = T.StructType([T.StructField("token", T.StringType()), T.StructField("m", T.ArrayType(T.DoubleType()))])


def token_sums(block: Block, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([block.items("tokens"), lists(sums)], ["token", "m"])


def pack(counts: DataFrame, id_col: str, parts: int, label: str = None, classes: list = ()) -> Packed:
    """Counts (id, token, n, and the label) are read once; ``parts`` says how many tasks hold them."""
    released(counts.sparkSession)  # of what the counting dealt out
    code = F.coalesce(label_code(label, classes), F.lit(-1)) if label else F.lit(-1)
    rows = counts.select(F.col(id_col).alias("id"), "token", F.col("n").cast("int").alias("n"), code.cast("short").alias("c")).repartition(parts, "id")
    kind = rows.schema["id"].dataType

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        ids, tokens = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("id", "token"))
        row, code = vector(ids.indices).astype(np.int64), vector(tokens.indices)
        order = np.argsort(row * len(tokens.dictionary) + code, kind="stable")
        arrays = [pressed(a[order]) for a in (code.astype(np.int32), vector(table.column("n")), vector(table.column("c")))]
        ends = np.bincount(row, minlength=len(ids.dictionary)).cumsum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.ListArray.from_arrays([0, len(ids.dictionary)], ids.dictionary),
             pa.ListArray.from_arrays([0, len(tokens.dictionary)], tokens.dictionary), pa.array([ends.astype(np.int64).tobytes()]), *[pa.array([a]) for a in arrays]],
            ["block", "ids", "tokens", "ends", "codes", "n", "c"])

    shape = f"block long, ids array<{kind.simpleString()}>, tokens array<string>, ends binary, codes binary, n binary, c binary"
    table = checkpointed(rows.mapInArrow(run, shape))
    released(counts.sparkSession)  # the counts as dealt out are larger than the blocks, which are dealt out only now
    table = laid_out(table.repartition(parts, "block"))
    released(counts.sparkSession)
    return Packed(table, parts, kind)


class Held:
    """The blocks beside one vocabulary whose weights go to every task: sums over all documents come back as one array."""

    def __init__(self, packed: Packed, vocab: pa.Array):
        self.vocab, spark = vocab, packed.table.sparkSession
        send = spark.sparkContext.broadcast(vocab)

        def run(batches):
            for batch in batches:
                at = [vector(pc.index_in(Block(batch, i).items("tokens"), value_set=send.value)).astype(np.int32).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *[batch.column(c) for c in ("ends", "codes", "n", "c")]], ["at", "ends", "codes", "n", "c"])

        # A task sends one sum over all tokens, so there are no more tasks than run at once.
        self.table = checkpointed(packed.table.mapInArrow(run, "at binary, ends binary, codes binary, n binary, c binary")).coalesce(spark.sparkContext.defaultParallelism)

    def summed(self, k: int, part) -> np.ndarray:
        """The sum of ``part(block, places of its tokens)`` over all blocks, added up per task and then per slice."""
        size = len(self.vocab)

        def run(batches):
            acc = np.zeros((size, k))
            for batch in batches:
                for i in range(batch.num_rows):
                    at = np.frombuffer(batch.column("at")[i].as_buffer(), np.int32)
                    acc[at] += part(Block(batch, i), at)
            for r, piece in enumerate(np.array_split(acc, -(-size * k // SLICE_NUMBERS))):
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([piece.tobytes()])], ["slice", "sums"])

        def added(pieces: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in pieces.column("sums"))
            return pa.table({"slice": pieces.column("slice").slice(0, 1), "sums": pa.array([total.tobytes()])})

        shape = "slice long, sums binary"
        rows = self.table.mapInArrow(run, shape).groupBy("slice").applyInArrow(added, shape).collect()
        return np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])]).reshape(size, k)
