import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.llm import quality as Q
from tabulearn.llm import queries
from tabulearn.llm.frames import crc_fold

WORDS = ["abc", "ÉTÉ", "x", "Ünï", "a$$$", "longer-word", "x", "\U0001f600z"]


def plain_features(text):
    """Buckets of a text one by one, with Python's own integers."""
    def one(h):
        return int(Q.bucket(np.array([h % 2**64], np.uint64))[0])

    step, out, hashes = int(Q.STEP), [], []
    for w in text.encode().split():
        w = w.decode()
        h, power = 0, step
        for c in w:
            h, power = h + ord(c) * power, power * step
        hashes.append(h % 2**64)
        out.append(one(h))
        padded = f" {w} "
        for n in Q.GRAMS:
            for i in range(len(padded) - n + 1):
                h = n
                for c in padded[i : i + n]:
                    h = h * step + ord(c)
                out.append(one(h))
    out += [Q.SAME if a == b else one(a * int(Q.PAIR) + b) for a, b in zip(hashes, hashes[1:])]
    return out


def test_features_equal_a_plain_loop(monkeypatch):
    text = " ".join(WORDS * 3) + " x\tx \n x"
    want = np.bincount(plain_features(text), minlength=Q.BUCKETS)
    assert (Q.feature_counts(text.encode()) == want).all()
    monkeypatch.setattr(Q, "BLOCK_CHARS", 10)
    monkeypatch.setattr(Q, "KNOWN", 4)
    assert (Q.feature_counts(text.encode()) == want).all()
    assert not Q.feature_counts(b" \n ").any()


def test_gradients_equal_differences():
    model = Q.Embeddings([0, 1, 2], dims=4)
    rng = np.random.default_rng(0)
    model.map = rng.normal(size=(4, 3))
    buckets, share = np.array([3, 9, 20]), np.array([0.5, 0.3, 0.1])

    def loss():
        return -np.log(model.softmax(share @ model.vectors[buckets])[1])

    row, out, off = model.gradients(buckets, share, 1)
    for array, at, want in ((model.vectors, (9, 2), 0.3 * row[2]), (model.map, (1, 2), out[1, 2]), (model.bias, (0,), off[0])):
        array[at] += 1e-6
        high = loss()
        array[at] -= 2e-6
        low = loss()
        array[at] += 1e-6
        assert (high - low) / 2e-6 == pytest.approx(want, abs=1e-6)


def test_scores_equal_a_plain_average(spark, docs, monkeypatch):
    model = Q.Embeddings([0, 1])
    model.map = np.random.default_rng(1).normal(size=model.map.shape) * 9
    model.bias = np.array([-1.0, 0.5])
    texts = [" ".join(WORDS * k) for k in (1, 2, 30)] + ["", None, "one", " \t\n"]
    texts.append("x" * 3_000_000 + " " + "word other " * 400)
    got = {r.doc_id: r.score for r in Q.score(docs(texts), spark.sparkContext.broadcast(model)).collect()}
    for i, t in enumerate(texts[:-1]):
        b = plain_features(t or "")
        p = model.softmax(model.vectors[b].sum(axis=0) / (len(b) + Q.PADS))[1]
        assert got[i] == pytest.approx(p, abs=1e-9)
    counts = Q.feature_counts(texts[-1].encode())
    assert got[7] == pytest.approx(model.softmax(counts @ model.vectors / (counts.sum() + Q.PADS))[1], abs=1e-9)
    monkeypatch.setattr(Q, "KNOWN", 3)
    monkeypatch.setattr(Q, "BLOCK_CHARS", 40)
    again = Q.Scorer(model).probabilities([(t or "").encode() for t in texts[:-1]])[:, 1]
    assert again == pytest.approx([got[i] for i in range(len(texts) - 1)], abs=1e-9)


def test_fit_edges(spark, docs):
    texts = ["good text here"] * 5 + ["BAD!! BAD!!"] * 5 + [None, ""]
    df = docs(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, 0])
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)] + [(3, 1), (4, 0), (None, 1), (77, 0), (2, 5)], "doc_id long, quality int")
    model = Q.fit(df, labels, F.lit(True))
    assert model.classes == [0, 1]
    rows = {r.doc_id: r for r in Q.score(df, spark.sparkContext.broadcast(model)).collect()}
    assert len(rows) == 11 and rows[1].score > 0.5 > rows[7].score and rows[7].predicted in (0, 1)
    again = Q.fit(df, labels, F.lit(True))
    assert (again.vectors == model.vectors).all() and (again.map == model.map).all()
    for some in (labels.limit(0), labels.where("quality = 1")):
        prior = Q.fit(df, some, F.lit(True))
        assert Q.score(df, spark.sparkContext.broadcast(prior)).where("score between 0 and 1").count() == 12
    assert Q.score(df.limit(0), spark.sparkContext.broadcast(model)).count() == 0
    assert Q.fit(df.limit(0), labels, F.lit(True)).classes == [0, 1]


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op12_quality(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where(crc_fold(F.col("doc_id"), 5) == 0).collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert all(r.held_out for r in rows) and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.98
