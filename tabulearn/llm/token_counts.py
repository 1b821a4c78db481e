"""Token counts without encoding everything (operator 8).

Offline, every vocabulary string that can be a whole pre-token is merged once; those that end as one token form the
shortcut set. A pre-token in that set counts one without further work, and only the others are merged.
"""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.llm import bpe
from tabulearn.llm.frames import held


def single_tokens(vocab: bpe.Vocabulary) -> frozenset:
    """Pre-token strings proven to be encoded as exactly one token: merged here, not assumed from the vocabulary."""
    byte_of = {c: b for b, c in enumerate(bpe.byte_letters())}
    ends = vocab.tokens[vocab.letters[256]][len(vocab.tokens[vocab.letters[0]]):]
    splitter = bpe.Splitter(vocab)
    words = []
    for token in vocab.tokens:
        body = token[: -len(ends)] if ends and token.endswith(ends) else "" if ends else token
        if not body or any(c not in byte_of for c in body):
            continue
        try:
            words.append(bytes(byte_of[c] for c in body).decode())
        except UnicodeDecodeError:
            pass
    words = [w for w in words if w not in vocab.special and splitter.find.findall(splitter.clean(w)) == [w]]
    return frozenset(w for w, ids in zip(words, bpe.encode_words(vocab, words)) if len(ids) == 1)


def count_tokens(df: DataFrame, vocab, single, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) per row; null text counts as empty, repeated ids stay separate rows.

    ``vocab`` and ``single`` are broadcasts of a Vocabulary and of its ``single_tokens``.
    """

    call = uuid.uuid4().hex

    def make():
        # The table holds the tokens beyond the first: 0 for the proven words, which are never merged.
        return bpe.Encoder(vocab.value, lambda ids: len(ids) - 1, fixed=[dict.fromkeys(single.value, 0)])

    def run(batches):
        encoder = held(call, make)
        for batch in batches:
            counts = [sum(len(kept) + sum(kept) for (kept,) in lists) for lists in encoder.texts(bpe.texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    counted = df.select(id_col, text_col, size).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
