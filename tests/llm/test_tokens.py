import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulearn.llm import bpe, token_counts
from tabulearn.llm.queries import vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    random.seed(4)
    letters = "aàbcéßZΣς İIıﬁ'stre'llvmd 0१9½ \x1c\x85\u0327\u0301é한ᄀ1ᅡ<|endoftext|>!?—😀👍\u0558\U00010940"
    drawn = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(300)]
    return [None, "", " \n", "a", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "antidis" * 400, "hello world " * 3000, "ΑΣ ΣΑΣ", "don't we'll", *drawn, *drawn[:3]]


def test_words_merge_as_in_the_library(library):
    random.seed(5)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(1, 90))) for _ in range(3000)]
    got = bpe.encode_words(vocabulary(), words)
    assert [list(g) for g in got] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert bpe.encode_words(vocabulary(), [""]) == [()]


def test_encode_decode_and_digests(spark, docs, library):
    t = texts()
    vocab = spark.sparkContext.broadcast(vocabulary())
    df = docs(t)
    want = [library.encode(x or "", add_special_tokens=False).ids for x in t]
    encoded = bpe.encode(df, vocab)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(enumerate(want))
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, vocab).collect()}
    assert decoded == {i: library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(want)}
    for r in bpe.digests(df, vocab).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id].encode()).hexdigest()


def test_counts(spark, docs, library):
    t = texts()
    send = spark.sparkContext.broadcast
    single = token_counts.single_tokens(vocabulary())
    sample = random.Random(1).sample(sorted(single), 300)
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sample)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(t), send(vocabulary()), send(single), 1000).collect()}
    for i, x in enumerate(t):
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 1000)


def test_very_long_text_and_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 40)
    monkeypatch.setattr(bpe, "KNOWN", 30)
    random.seed(6)
    long = " ".join("".join(random.choice("abcdé") for _ in range(random.randint(1, 9))) for _ in range(2000))
    encoder = bpe.Encoder(vocabulary(), lambda ids: ids)
    for t in (long, "", long[:300], "é" + long):
        (lists,) = encoder.texts([t])
        assert [i for (ws,) in lists for w in ws for i in w] == library.encode(t, add_special_tokens=False).ids


def test_empty_table(spark, docs):
    send = spark.sparkContext.broadcast
    empty = docs(["a"]).where("false")
    assert bpe.digests(empty, send(vocabulary())).collect() == []
    assert token_counts.count_tokens(empty, send(vocabulary()), send(frozenset()), 5).collect() == []
