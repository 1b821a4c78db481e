import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulearn.llm import language_id, queries, toxicity, vantage_search
from tabulearn.llm.frames import crc_fold

SMALL = "/root/testdata/sf0.01"


def test_gradients():
    net = language_id.BiGru(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, sizes = language_id.pack([b"hello", b"xy", b"qwertz", b"a"], 10)
    label = np.array([0, 1, 2, 1])

    def loss():
        ahead, behind, _, _ = net.states(x, sizes)
        known = np.arange(len(x))[:, None] < sizes
        return -(np.log(net.probabilities(ahead, behind)[:, np.arange(4), label]) * known).sum() / known.sum()

    grads, rng = net.gradients(x, sizes, label), np.random.default_rng(0)
    for name, w in net.w.items():
        i = tuple(rng.integers(0, d) for d in w.shape)
        i = (ord("e"), i[1]) if name.endswith("E") else i
        old, e = w[i], 1e-3
        w[i] = old + e
        up = loss()
        w[i] = old - e
        down = loss()
        w[i] = old
        assert grads[name][i] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-6)


def test_language_held_out(spark):
    got = queries.op5_language_id(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    assert len(got) == len(truth)
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out))
    both = got.merge(truth, on="doc_id")
    assert both.score.between(0, 1).all() and set(both.lang_pred) <= {*truth.lang.dropna(), "und"}
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.95


def test_language_edges(spark, docs):
    net = language_id.BiGru(["de", "en"]).train([[b"und", b"die"], [b"the", b"and"]], steps=60)
    send = spark.sparkContext.broadcast(net)
    long = "the " * 5000 + "x" * 5000
    df = docs([None, "", " ", "12 !?", "the and the", "und die", long, "the and the"], ids=[0, 1, 2, 3, 4, 5, 6, 4])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(df, send).collect()]
    assert len(got) == 8
    of = {i: (lang, s) for i, lang, s in got}
    assert all(of[i] == ("und", 0.0) for i in range(4))
    assert of[4][0] == of[6][0] == "en" and of[5][0] == "de" and 0.5 < of[4][1] <= 1
    kept = language_id.accepted(df, send, 0.1)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 5, 6]
    nothing = language_id.fit(df.where("false"), F.lit(True))
    assert nothing.languages == [] and language_id.predict(df, spark.sparkContext.broadcast(nothing)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(df.where("false"), send).collect() == []


def test_words_in_small_blocks(monkeypatch):
    net = language_id.BiGru(["de", "en"])
    text = " ".join(random.Random(1).choice(["the", "und", "x" * 60, "é"]) for _ in range(900))
    ((_, whole),) = language_id.Tagger(net).label([text])
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 100)
    monkeypatch.setattr(language_id, "KNOWN", 8)
    assert list(language_id.Tagger(net).label([text, "the"]))[0][1] == pytest.approx(whole, rel=1e-5)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    lexicon = ["scum", "idiot", "clown", "disgusting", "worthless", "moron", "a", "abcde"]
    trie = toxicity.Trie(lexicon)
    for _ in range(3000):
        w = list(rng.choice(lexicon))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "i"])
        w = "".join(w)
        within = [d for t in lexicon if (d := edit_distance(w, t)) <= toxicity.edits_allowed(t)]
        assert trie.distance(w) == min(within, default=-1), w


def test_branches_found_by_shortened_forms_miss_nothing(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("aeinstéß", k=rng.randint(1, 12)))
    lexicon = sorted({word() for _ in range(150)} | {"a", "ab"})
    trie, near = toxicity.Trie(lexicon), toxicity.Neighbours(lexicon)
    words = sorted({word() for _ in range(1500)} | set(lexicon) | {w[1:] + "x" for w in lexicon} | {w[:-1] for w in lexicon if len(w) > 1} | {"x" * 500})
    monkeypatch.setattr(toxicity, "FORMS", 999)
    some = near.pairs(words)
    for w in words:
        assert trie.distance(w) == min((d for t in some.get(w, ()) if (d := trie.along(w, t)) >= 0), default=-1), w
    assert toxicity.Neighbours([]).pairs(words) == {} and near.pairs([]) == {}


def test_hits_equal_plain_edit_distance(spark, docs):
    """Counts of hits over whole texts, from every word against every lexicon word; also one very long word."""
    rng = random.Random(8)
    terms = ["stupid", "idiot", "disgusting", "scum"]
    lexicon = toxicity.Lexicon(terms)
    texts = []
    for _ in range(60):
        words = rng.choices(["alpha", "stupid", "stpid", "disgustng", "dizgusstin", "idiom", "scumm", "scum", "idddiot"], k=rng.randint(1, 30))
        texts.append(" ".join(words))
    texts += ["x" * 3_000_000 + " stupid", "stupid" * 400_000]
    got = toxicity.featured(docs(texts), spark.sparkContext.broadcast(lexicon), "doc_id").collect()
    for r in got:
        counts, total = [0, 0], 0
        for w in texts[r.doc_id].split():
            total += 1
            if len(w) > 100:
                continue
            short = toxicity.RUNS.sub(r"\1", w)
            best = [min((d for t in terms if (d := edit_distance(v, t)) <= toxicity.edits_allowed(t)), default=-1) for v in (w, short)]
            edits = best[0] if best[0] >= 0 or short == w else best[1] + 1 if best[1] >= 0 else -1
            if edits >= 0:
                counts[edits > 0] += 1
        assert r.x == pytest.approx([np.log1p(counts[0]), np.log1p(counts[1]), 0.0, np.log1p(100 * sum(counts) / total)])


def test_context_and_misspelling():
    lexicon = toxicity.Lexicon(["stupid", "disgusting", "idiot"], ["vequ"])
    x = toxicity.Scorer(lexicon).features(["you stupld man", 'he said "stupid" again', "Stuuuupid!", "vequaire", "", "a st*pid idiot", "stupid " * 50])
    assert x[0].argmax() == 3 and x[0][1] > 0 and x[0][0] == 0
    assert x[1][2] > 0 and x[1][0] == 0 and x[1][3] == 0
    assert x[2][1] > 0 and x[3][0] > 0 and not x[4].any()
    assert x[5][0] > 0 and x[5][1] > 0 and x[6][0] == pytest.approx(np.log(51))


def test_toxicity_held_out(spark):
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    out = got[got.held_out].merge(truth, on="doc_id")
    assert out[out.toxic == 1].predicted.mean() > 0.85 and out[out.toxic == 0].predicted.mean() < 0.02


def test_toxicity_edges(spark, docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(20)) + (" vile" if i % 4 == 0 else "") for i in range(80)]
    df = docs(texts + [None, "", "vile " * 20000, texts[0]], ids=[*range(83), 0])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (81, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, labels, crc_fold(F.col("doc_id"), 4) != 2)
    assert "vile" in lexicon.words
    got = {r.doc_id: r for r in toxicity.score(df, spark.sparkContext.broadcast(lexicon)).collect()}
    assert got[0].predicted == 1 and got[82].predicted == 1 and got[1].predicted == 0 and got[80].predicted == got[81].predicted == 0
    none = toxicity.fit(df, labels.where("false"), F.lit(True))
    assert toxicity.score(df, spark.sparkContext.broadcast(none)).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_of_rare_terms_and_copies(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvz") for _ in range(7))
    plain, rare = [word() for _ in range(40)], [word() for _ in range(60)]
    texts = [" ".join(rng.choices(plain, k=20)) + (f" {rare[i % 60]}" if i < 600 else "") for i in range(1200)]
    df = docs(texts + [texts[0] + " copied"] * 30)
    labels = spark.createDataFrame([(i, int(i < 600 or i >= 1200)) for i in range(1230)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, labels, F.lit(True))
    assert all(lexicon.kind(w) == 1 for w in rare) and lexicon.kind("copied") == 0
    got = {r.doc_id: r.predicted for r in toxicity.score(df, spark.sparkContext.broadcast(lexicon)).collect()}
    assert all(got[i] == (i < 600) for i in range(1200))


def brute_nearest(ids, x, asked, k):
    out = {}
    for q in asked:
        s = x @ x[ids.index(q)]
        order = sorted((-round(float(s[j]), 12), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vantage_search, "LEAST_SHARD", 60)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]  # many equal vectors
    x[200:210] *= 3
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] * 8, [1.0]]
    table = spark.createDataFrame(rows + [(1000 + 20 * i, v, 0) for i, v in enumerate(odd)] + rows[40:60], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {}
    for r in vantage_search.nearest(table, F.col("vec_id") % 20 == 0, k=20, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute_nearest(list(range(300)), x.astype(float), range(0, 300, 20), 20)
    assert {q: [v for _, v in r] for q, r in got.items()} == want
    assert all([k for k, _ in r] == list(range(1, 21)) for r in got.values())


def test_few_candidates_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vantage_search.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert vantage_search.nearest(table.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_recall(spark):
    got = queries.op6_vantage_search(spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.tolist()
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    hits = sum(len(set(want[q]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.95
