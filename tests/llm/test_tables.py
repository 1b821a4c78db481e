import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabulearn.llm import mixing, queries, url_filter
from compare import difference, duck

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.SQL[name]) is None


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.SQL) <= set(entry.oracle_sql())


def test_mixing_by_hand(spark, docs):
    texts = ["w " * 10] * 10 + ["w " * 10] * 10 + [None, "", "a b"]
    sources = ["b"] * 10 + ["a"] * 10 + [None, None, None]
    df = docs(texts, sources=sources)
    rows = mixing.mix(df, weights=(5, 2, 1)).collect()
    # a: weight 5, b: 2, null: 1; 303 words wanted; a stops at 200, null at 4, b has the rest.
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert targets[None] == (2, 4.0) and targets["a"] == (100, 200.0) and targets["b"] == (100, 99.0)
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.repeats
    assert taken["a"] == 200 and abs(taken["b"] - 99) <= 5 and taken[None] == 4
    again = mixing.mix(df.repartition(7), weights=(5, 2, 1)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    whole = mixing.mixed_rows(df)
    assert whole.columns == df.columns
    counts = {r.doc_id: r["count"] for r in whole.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.repeats for r in rows if r.repeats}


def plain_mix(rows, weights, share, max_epochs, seed=7):
    """(target, words taken) per source by the definition, row by row, for (id, text, source)."""
    import hashlib

    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (budget - sum(max_epochs * size[s] for s in full)) / max(sum(weight[s] for s in rest), 1e-300)
        over = {s for s in rest if weight[s] * level > max_epochs * size[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in order:
        target = max_epochs * size[s] if s in full else weight[s] * level
        whole = int(target // size[s]) if size[s] else 0
        rest, before, taken = target - whole * size[s], 0, whole * size[s]
        mine = sorted((hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest(), len((t or "").split())) for i, t, of in rows if of == s)
        for _, n in mine:
            if rest > 0 and 2 * before + n <= 2 * rest:
                taken += n
            before += n
        out[s] = (target, taken)
    return out


@pytest.mark.parametrize("case", ["null ids", "one id", "equal rows", "mixed sizes"])
def test_mixing_with_ties(docs, case):
    """Targets are met within half a document whatever ids repeat, as in the row-wise definition."""
    rng = random.Random(case)
    n = 120
    ids = {"null ids": [None] * n, "one id": [5] * n, "equal rows": [None] * n, "mixed sizes": [rng.choice([None, 1, 2, i]) for i in range(n)]}[case]
    texts = ["w " * 10 if case == "equal rows" else " ".join(rng.choices("abc", k=10 if case != "mixed sizes" else rng.randint(0, 30))) for _ in range(n)]
    sources = [rng.choice("ab") if case != "one id" else "a" for _ in range(n)]
    df = docs(texts, ids=ids, sources=sources)
    want = plain_mix(list(zip(ids, texts, sources)), (5, 2, 1), 1.45, 2.0)
    rows = mixing.mix(df, weights=(5, 2, 1), share=1.45).collect()
    assert len(rows) == n
    for s, (target, taken) in want.items():
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target) and sum(r.taken for r in mine) == taken
        assert abs(taken - target) <= max(r.size for r in mine) / 2 and all(r.taken <= 2 * r.size for r in mine)
    assert mixing.mixed_rows(df, weights=(5, 2, 1), share=1.45).count() == sum(r.repeats for r in rows)


def test_mixing_of_nothing(spark, docs):
    df = docs(["a"])
    assert mixing.mix(df.where("false")).collect() == []
    (row,) = mixing.mix(docs([None])).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(50)] + [(None,)], "s string").repartition(5)
    got = [r.s for r in mixing.ranked(df, F.col("s").asc_nulls_last()).orderBy("pos").collect()]
    assert got == sorted(f"s{i}" for i in range(50)) + [None]


def plain_judge(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls_against_plain_rules(spark, monkeypatch):
    rng = random.Random(7)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "ample.com", "net", "x.net", "example.comx", "", "EXAMPLE.com", "ex-ample.com", "é.net", "b.example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/es/1", "/fr/?q=/en/", "#/en/", "/en/#x", "?a=://b"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "://", "a://b://c/d"] + ["http://www.example.com/en/hot"] * 300
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
             ("example.com", "/", "block"), ("example.com", "/", "allow"), ("b.example.com", "/en/a/b", "block"), ("b.example.com", "", "allow"), ("com", "/en/a/b", "block")]
    pages = spark.createDataFrame([(i, u, "k", "v") for i, u in enumerate(urls)], "page_id long, url string, key string, verdict string").repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table).collect()}
    assert got == {i: plain_judge(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.where("false"), table).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, table.where("false"), "block").collect()} == {"block"}
