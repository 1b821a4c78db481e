"""Labels, thresholds, tokens, splits, folds, scaling."""

import itertools

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.batches import gram_counts, item_counts
from tabulearn.functions.columns import (
    distinct_labels, feature_array, label_code, literal_array, plus_minus)
from tabulearn.functions.tables import BROADCAST_ROWS, within
from tabulearn.session import checkpointed, configured, laid_out, parts_of

# A word is a run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
TEXT_BYTES = 8_000_000  # of text whose words one task counts


def encode_labels(df: DataFrame, label: str, out: str = "code", signed: str = None) -> DataFrame:
    """Sorted distinct classes to 0..C-1, and to -1/+1 when ``signed`` names a column."""
    classes = distinct_labels(df, label)
    df = df.withColumn(out, label_code(label, classes))
    return df.withColumn(signed, plus_minus(label, classes)) if signed else df


def binarize(df: DataFrame, columns: list, threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(c) > F.lit(threshold)).cast("int") for c in columns})


def add_bias(df: DataFrame, out: str = "bias") -> DataFrame:
    return df.withColumn(out, F.lit(1.0))


def impute_mean(df: DataFrame, columns: list, missing: float = 0.0, include_missing: bool = True) -> DataFrame:
    """Replace ``missing`` by the column mean; the mean counts those rows too by default."""
    def source(c):
        return F.col(c) if include_missing else F.when(F.col(c) != missing, F.col(c))

    means = df.agg(*[F.avg(source(c)).alias(c) for c in columns]).first()
    return df.withColumns(
        {c: F.when(F.col(c) == missing, F.lit(means[c])).otherwise(F.col(c)) for c in columns})


def standardize(df: DataFrame, columns: list, fit_on: DataFrame = None) -> DataFrame:
    """(x - mean) / population deviation of the training table; constant columns become 0."""
    stats = (fit_on if fit_on is not None else df).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({
        c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def split_by_key(df: DataFrame, key: str, parts: int, holdout: int = 0):
    """(train, validation): the validation rows have key mod parts = holdout; a null key is never held out."""
    held = F.coalesce(F.pmod(F.col(key), F.lit(parts)) == holdout, F.lit(False))
    return df.filter(~held), df.filter(held)


def random_split(df: DataFrame, share: float, seed: int):
    held, rest = df.randomSplit([share, 1.0 - share], seed=seed)
    return rest, held


def text_parts(df: DataFrame, text: str, each: int = None) -> int:
    """Tasks for the words of the texts, by their bytes: what a task holds doesn't grow with the table."""
    return parts_of(df.sparkSession, df.agg(F.sum(F.octet_length(text))).first()[0] or 0, each or TEXT_BYTES)


def distinct_ids(df: DataFrame, key: str) -> bool:
    """Whether each row has an id of its own; reads the ids alone."""
    return df.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()


def word_counts(df: DataFrame, keep: list, text: str, parts: int = None) -> DataFrame:
    """(keep.., token, n) for every row's words; ``keep`` starts with the row's id.

    Rows with ids of their own count their words each by itself, a batch of rows
    at once; rows that share an id are counted together.
    """
    # Dealt out by id once: the counts below then need no shuffle of the words.
    dealt = df.select(*keep, text).repartition(parts or text_parts(df, text), keep[0])
    words = dealt.select(*keep, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("_words"))
    if distinct_ids(df, keep[0]):
        return item_counts(words, keep, "_words", "token")
    return words.select(*keep, F.explode("_words").alias("token")).groupBy(*keep, "token").agg(F.count("*").alias("n"))


def frequent_tokens(counts: DataFrame, min_df: int, parts: int) -> DataFrame:
    """Keep the tokens found in at least ``min_df`` documents.

    ``counts`` has one row per (document, token), so the row count is the
    document frequency. The counts are written out first: the texts are cut
    once, and the join sees counted rows (the optimizer would otherwise move it
    below the count). The vocabulary may grow with the texts, so its tasks stay as
    many as asked for: adaptive execution would put them together by their bytes.
    A small vocabulary goes to every task; else the counts are dealt out by token,
    where a task gets a row per document of a hot token and passes them by its
    part of the vocabulary, which lies there already, without sorting them.
    """
    if min_df <= 1:
        return counts
    counts = checkpointed(counts)
    with configured(counts.sparkSession, {"spark.sql.shuffle.partitions": str(parts)}):
        vocab = laid_out(counts.groupBy("token").agg(F.count("*").alias("_df")).filter(F.col("_df") >= min_df).select("token"))
    if within(vocab, BROADCAST_ROWS):
        return counts.join(F.broadcast(vocab), "token", "left_semi")
    # Not a semi-join: the optimizer would put it before the dealing out and deal twice. Tokens are distinct in ``vocab``.
    return counts.repartition(parts, "token").join(vocab.hint("shuffle_hash"), "token")


def bag_of_words(df: DataFrame, id_col: str, text: str, keep: list = (), min_df: int = 1) -> DataFrame:
    parts = text_parts(df, text)
    return frequent_tokens(word_counts(df, [id_col, *keep], text, parts), min_df, parts)


def char_ngrams(df: DataFrame, id_col: str, text: str, low: int = 1, high: int = 3,
                keep: list = (), min_df: int = 1) -> DataFrame:
    """Character n-grams inside words padded by one space on each side.

    A padded word shorter than n gives itself once.
    """
    def of_size(word, n):
        size = F.length(word)
        whole = F.array(word) if n == low else F.array().cast("array<string>")
        starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
        return F.when(size >= n, F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))).otherwise(whole)

    def grams(word):
        return F.concat(*[of_size(word, n) for n in range(low, high + 1)])

    # Rows with ids of their own count their n-grams in blocks, where a distinct word is cut once. Else count the
    # words first: n-grams are then cut once per distinct word of a document.
    # The texts are dealt out by id once, which serves both counts; a word has some n-grams of each size.
    parts = text_parts(df, text, TEXT_BYTES // (high - low + 1))
    dealt = df.select(id_col, *keep, text).repartition(parts, id_col).select(id_col, *keep, F.split(F.lower(text), r"\s+").alias("_words"))
    if distinct_ids(df, id_col):
        filled = dealt.withColumn("_words", F.filter("_words", lambda w: w != ""))
        return frequent_tokens(gram_counts(filled, [id_col, *keep], "_words", "token", low, high), min_df, parts)
    words = (
        dealt.select(id_col, *keep, F.explode("_words").alias("_w")).filter(F.col("_w") != "")
        .groupBy(id_col, *keep, "_w").agg(F.count("*").alias("n")))
    counts = (
        words.select(id_col, *keep, "n", F.explode(grams(F.concat(F.lit(" "), "_w", F.lit(" ")))).alias("token"))
        .groupBy(id_col, *keep, "token").agg(F.sum("n").alias("n")))
    return frequent_tokens(counts, min_df, parts)


def pca(df: DataFrame, features, k: int, out: str = "pc") -> DataFrame:
    """Projection of the centred rows on the top components; each has its largest loading positive."""
    vec = df.withColumn("_v", array_to_vector(feature_array(features)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    loadings = model.pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    centre = vec.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray() @ loadings
    off = F.zip_with(vector_to_array("_p"), literal_array(centre), lambda a, c: a - c)
    return model.transform(vec).withColumn(out, F.zip_with(off, literal_array(signs), lambda a, s: a * s)).drop("_v", "_p")


def cross_validate(df: DataFrame, fit, score, key: str, folds: int) -> list:
    """[(fold, score)]: ``fit(train)`` gives a model, ``score(model, held)`` a number."""
    out = []
    for fold in range(folds):
        train, held = split_by_key(df, key, folds, fold)
        out.append((fold, score(fit(train), held)))
    return out


def grid_search(df: DataFrame, fit, score, grid: dict, key: str, folds: int) -> list:
    """[(parameters, mean score)] over all combinations, best first."""
    names = sorted(grid)
    results = []
    for values in itertools.product(*[grid[n] for n in names]):
        params = dict(zip(names, values))
        scores = [s for _, s in cross_validate(df, lambda t: fit(t, **params), score, key, folds)]
        results.append((params, sum(scores) / len(scores)))
    return sorted(results, key=lambda r: -r[1])
