import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabulearn.llm import components, lattice_dedup, simhash, suffix_dedup


def smallest_reachable(ids, near):
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            return [ids[i] for i in label]
        label = new


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (900, 901), (901, 900)]
    random.shuffle(pairs)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {900: 900, 901: 900}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    random.seed(8)
    base = [" ".join(random.choice("a B cc Dé eee f\u00a0g h".split(" ")) + str(random.randint(0, 40)) for _ in range(120)) for _ in range(6)]
    out = [None, "", " \t\n", "one", "one two three", *base]
    for b in base:
        words = b.split(" ")
        for _ in range(12):
            w = list(words)
            w[random.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + out[5:8]


def check_simhash(spark, docs, words=4, distance=4):
    texts = near_texts()
    fps = [plain_fingerprint(t, words) for t in texts]
    v = np.array(fps, np.uint64)
    want = smallest_reachable(list(range(len(texts))), np.bitwise_count(v[:, None] ^ v) <= distance)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(texts), words, distance).collect()}
    assert got == {i: (format(f, "016x"), c) for i, (f, c) in enumerate(zip(fps, want))}
    return want


def test_simhash_equals_brute_force(spark, docs):
    assert len(set(check_simhash(spark, docs))) < len(near_texts()) - 5


def test_simhash_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 2)
    monkeypatch.setattr(simhash, "BUCKET_BLOCK", 4)
    check_simhash(spark, docs)


def test_segments_hold_the_distance():
    for distance in range(0, 9):
        cut = simhash.segments(distance)
        assert sum(w for _, w in cut) == 64 and 2 * len(cut) > distance
    rng = np.random.default_rng(0)
    assert len(simhash.forest(rng.integers(0, 2**63, 5).astype(np.uint64), np.zeros(0, np.uint64), 4)) == 0


def test_one_per_group_keeps_rows(spark, docs):
    texts = near_texts()
    ids = [*range(len(texts) - 2), None, None]
    df = docs(texts, ids=ids)
    kept = simhash.one_per_group(df, words=4, distance=4, n_segments=3)
    assert kept.columns == df.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 4, 4).where("doc_id is not null").collect()}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(groups.values())) and got.count(None) == 2
    twice = df.unionByName(df)
    assert sorted(r.doc_id for r in simhash.one_per_group(twice, 4, 4, 3).where("doc_id is not null").collect()) == sorted(set(groups.values()))
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_pipeline_takes_the_contract_of_the_operator(spark, monkeypatch):
    # In each of two segments two bits differ; of three, one differs in a single bit.
    fps = spark.createDataFrame([(0,), (sum(1 << b for b in (1, 5, 33, 50)),)], "fp long")
    assert simhash.links(fps, 4, 2).count() == 0
    asked = {}
    monkeypatch.setattr(simhash, "near_duplicates", lambda df, words, distance, id_col, text_col, n: asked.update(w=words, d=distance, n=n) or df.select(id_col, F.col(id_col).alias("component_id")))
    corpus_pipeline.near_copies(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert (asked["w"], asked["d"]) == (4, 4) and simhash.links(fps, asked["d"], asked["n"]).count() > 0


def test_one_per_group_of_repeated_and_null_ids(spark, docs):
    a, b, c = near_texts()[5:8]
    df = docs([a, b, a + " x", c, c, c + " y"], ids=[1, 1, 2, None, None, None])
    kept = [(r.doc_id, r.text[:40]) for r in simhash.one_per_group(df, 4, 9, without_id_stay=False).collect()]
    assert sorted(kept, key=str) == sorted([(1, a[:40]), (1, b[:40]), (None, c[:40])], key=str)


def without_repeats(texts, span):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - span + 1):
            if counts[b[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def repeated_texts():
    random.seed(3)
    words = ["".join(random.choice("abcdeé \n") for _ in range(random.randint(1, 7))) for _ in range(300)]
    draw = lambda n: " ".join(random.choice(words) for _ in range(n))
    passages = [draw(random.randint(30, 120)) for _ in range(8)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "ab" * 300, "Queon " * 100, "q" + "Queon " * 90, draw(2000), "\x00" * 300, "a\x00" * 250, draw(100)[:200] * 3]
    for _ in range(60):
        t = draw(random.randint(0, 250))
        for _ in range(random.randint(0, 2)):
            p = random.choice(passages)
            p = p[random.randint(0, len(p) // 2) :]
            t = t[: len(t) // 2] + p + t[len(t) // 2 :]
        texts.append(t)
    return texts + texts[14:17]


def check_repeats(spark, docs):
    texts = repeated_texts()
    want = without_repeats(texts, 200)
    df = docs(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {i: w[:4] for i, w in enumerate(want)}
    return df, texts, want


def test_suffix_dedup_equals_brute_force(spark, docs):
    df, texts, want = check_repeats(spark, docs)
    clean = suffix_dedup.cleaned_rows(df)
    assert clean.columns == df.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {i: None if t is None else w[4] for i, (t, w) in enumerate(zip(texts, want))}


def test_suffix_dedup_of_very_common_passages(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    check_repeats(spark, docs)


def test_parse_in_tiles():
    rng = np.random.default_rng(1)
    flat = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 150, 400, 3000, 5000])
    constants = suffix_dedup.mixing_constants(suffix_dedup.TILE + 208)

    def owned():
        starts = {}
        for doc, at, low, high, key in suffix_dedup.triggers(flat, offsets, 200, constants):
            for d, a, lo, hi, k in zip(doc, at, low, high, key):
                for b in range(lo, hi + 1):
                    assert (d, a - b) not in starts
                    starts[int(d), int(a - b)] = (int(a), int(k))
        return starts

    whole = owned()
    assert set(whole) == {(d, s) for d in range(5) for s in range(offsets[d + 1] - offsets[d] - 199)}
    suffix_dedup.TILE, kept = 700, suffix_dedup.TILE
    try:
        assert owned() == whole
    finally:
        suffix_dedup.TILE = kept


def test_suffix_dedup_of_repeated_ids_and_nothing(spark, docs):
    a, b = "".join(map(chr, range(48, 123))) * 3, "".join(map(chr, range(122, 47, -1))) * 3
    df = docs([a[:210], b[:205], a[:210], "z"], ids=[1, 1, 1, None])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(1, 0), (205, 0), (210, 210), (210, 210)]
    assert suffix_dedup.remove_repeats(df.where("false")).collect() == []


def test_suffix_dedup_of_many_equal_rows(spark, docs):
    random.seed(6)
    text = "".join(random.choice("abcdefgh") for _ in range(3000))
    texts = [text] * 40 + [text[1000:1400] + "z" * 100, "short", "short"]
    df = docs(texts, ids=[None] * 20 + [5] * 20 + [1, None, None])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted(w[:4] for w in without_repeats(texts, 200))
    assert suffix_dedup.with_spans(df, 200, "doc_id", "text").agg(F.max(F.size("spans"))).first()[0] < 100


def test_hot_keys_are_counted_by_places(spark, docs, monkeypatch):
    random.seed(7)
    draw = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    line = draw(190)
    texts = ["".join(draw(100) + line for _ in range(20)) for _ in range(4)] + [draw(300) * 2]
    real, most = suffix_dedup.repeated_starts, 10

    def bounded(group, *rest):
        assert np.unique(group, return_counts=True)[1].max() <= most
        return real(group, *rest)

    monkeypatch.setattr(suffix_dedup, "HOT", most)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", bounded)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(texts)).collect()}
    assert got == {i: w[:4] for i, w in enumerate(without_repeats(texts, 200))}


def test_lattice_points():
    rng = np.random.default_rng(0)
    short = lattice_dedup.shortest_vectors()
    assert len(short) == 240 and np.allclose((short**2).sum(axis=1), 2)
    x = rng.normal(size=(500, 8)) * 2
    near = lattice_dedup.nearest_point(x)
    best = ((x - near) ** 2).sum(axis=1)
    assert (best <= ((x[:, None] - (near[:, None] + short)) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string, n string, id string, keys string").repartition(3)


def check_lattice(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range(12):
            rows.append([float(x) for x in centre + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.3])])
    rows += rows[:5] + [[2 * x for x in rows[7]]]
    table = [(i, v, i % 2 if i < 100 else 0, "k", "n", "i", "s") for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    table += [(1000 + i, v, 0, "", "", "", "") for i, v in enumerate(odd)] + [(2000, rows[0], None, "", "", "", "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(vectors(spark, table)).collect()}
    x = np.float32(rows).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([t[2] for t in table[: len(rows)]])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = smallest_reachable(list(range(len(rows))), near)
    assert near.sum() > 200
    assert {i: got[i] for i in range(len(rows))} == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(rows))}
    assert all(got[i] == (0, i, True) for i in [*range(1000, 1007), 2000])


def test_lattice_dedup_equals_brute_force(spark):
    check_lattice(spark)
    assert lattice_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_lattice_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 3)
    check_lattice(spark)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    zero = np.zeros(len(u), np.int64)
    a, b = (lattice_dedup.cell_keys(z, zero, lattice_dedup.TABLES, lattice_dedup.PROBES, lattice_dedup.SPACING) for z in (u, v))
    met = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
    assert met.mean() > 0.995


def test_columns_are_long(spark, docs):
    assert dict(simhash.near_duplicates(docs(["a"])).dtypes)["component_id"] == "bigint"
    assert dict(suffix_dedup.remove_repeats(docs(["a"])).select(F.col("n_spans")).dtypes)["n_spans"] == "bigint"


def test_a_task_gives_back_its_memory_when_it_ends(monkeypatch):
    from tabulearn.llm import frames

    seen = []
    monkeypatch.setattr(frames, "forget", lambda: seen.append("forget"))
    run = frames.given_back(lambda batches: (b + 1 for b in batches))
    for b in run([1, 2]):
        seen.append(b)
    assert seen == ["forget", 2, 3, "forget"]
