"""The registered queries of this folder and their SQL twins."""

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulearn.llm import (
    bpe, collocations, language_id, lattice_dedup, mixing, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter, vantage_search,
    zone_clustering)
from tabulearn.llm.frames import crc_fold, table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
MIX_SEED = 7
CENTROIDS, CLUSTER_ROUNDS, CLUSTER_SEED = 40, 5, 2
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@cache
def vocabulary(name: str = TOKENIZER) -> bpe.Vocabulary:
    return bpe.Vocabulary.load(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), spark.sparkContext.broadcast(vocabulary()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs, crc_fold(F.col("doc_id"), 5) != 0)
    found = language_id.predict(docs, spark.sparkContext.broadcast(net))
    return found.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op6_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, spark.sparkContext.broadcast(lexicon), threshold=0.3)
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    send = spark.sparkContext.broadcast
    single = token_counts.single_tokens(vocabulary())
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), send(vocabulary()), send(single), TOKEN_LIMIT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), span=200)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, default="allow")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, most_words=4, inside=80, top=2000)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, spark.sparkContext.broadcast(model), threshold=0.3)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_zone_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zone_clustering.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=CLUSTER_ROUNDS, seed=CLUSTER_SEED)
    return found.drop("compared")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_lattice_dedup": op3_lattice_dedup,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_vantage_search": op6_vantage_search,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_zone_clustering": op13_zone_clustering,
}

MIXING_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS mark
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 2.0 * sum(size) AS cap,
         CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
rounds AS (
  SELECT 1 AS k, CAST(0.0 AS DOUBLE) AS level, CAST((SELECT 1.5 * sum(source_size) / sum(weight) FROM sources) AS DOUBLE) AS nxt
  UNION ALL
  SELECT k + 1, nxt, CAST((SELECT (1.5 * (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) FILTER (cap < weight * r.nxt), 0))
                           / nullif(sum(weight) FILTER (NOT cap < weight * r.nxt), 0) FROM sources) AS DOUBLE)
  FROM rounds r WHERE nxt > level AND k < 1000),
settled AS (SELECT arg_max(coalesce(nxt, level), k) AS level, bool_or(nxt IS NULL) AS all_full FROM rounds),
targets AS (
  SELECT source, source_size, CASE WHEN all_full THEN cap ELSE least(cap, weight * level) END AS target FROM sources, settled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

URL_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + """),
cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
fits AS (
  SELECT s.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM split s LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

COLLOCATION_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS spot FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
phrases AS MATERIALIZED (
  SELECT lang, k, array_to_string(words[spot:spot + k - 1], ' ') AS phrase, count(*) AS f, any_value(words[spot:spot + k - 1]) AS words
  FROM places GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f, c.words, p.f AS l, r.f AS r, p.k AS cut, CAST((2000000::HUGEINT * c.f) // (p.f + r.f) AS BIGINT) AS score
  FROM phrases c JOIN phrases p ON p.lang = c.lang AND p.k < c.k AND p.phrase = array_to_string(c.words[1:p.k], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.k = c.k - p.k AND r.phrase = array_to_string(c.words[p.k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ones AS (
  SELECT DISTINCT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, m, f
  FROM (SELECT lang, words, k, f, m, unnest(range(1, k - m + 2)) AS i FROM phrases, (SELECT unnest([2, 3]) AS m) WHERE k > m)),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = s.lang AND i.phrase = s.phrase AND i.m = s.k AND 100 * i.f >= 80 * s.f))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) <= 2000
"""


def clustering_sql() -> str:
    """The rounds unrolled; vectors, centroids and sums in long form."""
    far = """
{name} AS MATERIALIZED (
  SELECT vec_id, c AS cluster, d AS distance FROM (
    SELECT vec_id, c, sum((x.v - y.v) * (x.v - y.v)) AS d FROM parts x JOIN {centroids} y USING (axis) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    steps = [f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS axis, unnest(v) AS v FROM vectors),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS axis, unnest(v) AS v FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id)) - 1 AS c FROM vectors) WHERE c < {CENTROIDS})"""]
    for k in range(CLUSTER_ROUNDS):
        steps.append(far.format(name=f"a{k}", centroids=f"c{k}"))
        steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT o.c, o.axis, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, o.v) AS v FROM c{k} o LEFT JOIN (
    SELECT cluster AS c, axis, sum(v) AS s, count(*) AS n FROM a{k} JOIN parts USING (vec_id) GROUP BY ALL) m ON m.c = o.c AND m.axis = o.axis)""")
    last = f"c{CLUSTER_ROUNDS}"
    steps.append(far.format(name="final", centroids=last))
    return ",".join(steps) + f""",
named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY axis)) AS centroid_sha256 FROM {last} GROUP BY c)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM final JOIN named ON c = cluster"""


SQL = {"op2_mixing": MIXING_SQL, "op10_url_filter": URL_SQL, "op11_collocations": COLLOCATION_SQL, "op13_zone_clustering": clustering_sql()}
