import types

import pyarrow as pa

import corpus_pipeline
from tabulearn.llm import bpe, frames, language_id, mixing, simhash, suffix_dedup
from tabulearn.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_dedup", "mixing", "bpe"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SMALL).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    language, single, clean, mixed, tokens = tables[1:]
    assert all(t.columns == docs.columns and t.dtypes == docs.dtypes for t in tables[1:5])
    assert language.count() >= 0.98 * docs.count()
    groups = simhash.near_duplicates(language, 4, 4)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups.collect()})
    # Brute force: components of all pairs of fingerprints within four bits.
    found = {r.doc_id: int(r.fingerprint, 16) for r in groups.collect()}
    name = {i: i for i in found}
    for _ in found:
        near = {i: min(name[j] for j in found if (found[i] ^ found[j]).bit_count() <= 4) for i in found}
        if near == name:
            break
        name = near
    assert {r.doc_id for r in single.collect()} == {i for i in found if name[i] == i}
    removed = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(single).collect()}
    assert {r.doc_id for r in clean.collect()} == set(removed)
    assert all(abs(len(r.text.encode()) - removed[r.doc_id]) <= 12 and r.n_chars == len(r.text) for r in clean.collect())
    taken = {r.doc_id: r.repeats for r in mixing.mix(clean).collect() if r.repeats}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    assert tokens.count() == mixed.count() and tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert language_id.UNKNOWN == "und" and bpe.WIDTHS


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_keep_no_words_after_a_task(monkeypatch):
    words = " ".join(f"w{i}ord" for i in range(3000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [words, None]})
    made, runs = [], []

    class Frame:
        schema = {"doc_id": types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            runs.append(run)

    for module, name in ((language_id, "Tagger"), (bpe, "digest_encoder")):
        make = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, make=make: made.append(make(*args)) or made[-1])
    net = types.SimpleNamespace(value=language_id.BiGru(["de", "en"]))
    vocab = types.SimpleNamespace(value=vocabulary())
    language_id.accepted(Frame(), net)
    language_id.predict(Frame(), net)
    bpe.digests(Frame(), vocab)
    for run in runs:
        assert sum(b.num_rows for b in run(iter([batch]))) >= 1
    *taggers, encoder = made
    assert len(taggers) == 2 and not any(kept in taggers for kept in frames.HELD.values())
    assert len(encoder.known[0]) == len(encoder.fixed[0]) and not encoder.old[0]


def test_batches_become_strings_in_parts():
    column = pa.array(["ab", None, "c" * 9, "", "d", "ü" * 4])
    parts = list(frames.text_lists(column, 10))
    assert parts == [["ab", ""], ["c" * 9, "", "d"], ["ü" * 4]]
    assert list(frames.text_lists(pa.array([], pa.string()), 10)) == []
