"""The registered queries: every operator bound to the given tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import distinct_labels
from tabulearn.functions.tables import keyed_join
from tabulearn.operators import (
    boosting, dual_svm, grids, kernels, linear, maxent, metrics, mixture, naive_bayes, neighbors, node_tables, prep, quasi_newton, sequence, splits, streams, token_blocks, trees, wide_pca)
from tabulearn.plans import settings as S
from tabulearn.session import checkpointed, configured, laid_out
from tabulearn.sources import models
from tabulearn.sources import text as lines
from tabulearn.sources.tables import read_table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rooted(nodes: DataFrame) -> DataFrame:
    """Parent 0 for the root, so that the column holds no nulls."""
    return nodes.withColumn("parent_id", F.coalesce("parent_id", F.lit(0).cast("long")))


def rounded(df: DataFrame, **digits) -> DataFrame:
    """Round the named columns; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("upper", (F.col("label") >= 5).cast("int"))


LINE = ["l_orderkey", "l_linenumber"]


# ---- preparation and sources ----

@query
def label_encode(spark, d):
    df = prep.encode_labels(lineitem(spark, d), "l_returnflag", "code")
    return prep.encode_labels(df, "l_linestatus", "status_code", signed="signed").select(
        *LINE, "l_returnflag", "code", "status_code", "signed")


@query
def standardize(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    return rounded(prep.standardize(lineitem(spark, d), cols).select(*LINE, *cols), **{c: 6 for c in cols})


@query
def impute_mean(spark, d):
    cols = ["l_discount", "l_tax"]
    return rounded(prep.impute_mean(lineitem(spark, d), cols).select(*LINE, *cols), **{c: 8 for c in cols})


@query
def binarize(spark, d):
    cols = ["l_discount", "l_tax"]
    return prep.binarize(lineitem(spark, d), cols, 0.04).select(*LINE, *cols)


@query
def bias_feature(spark, d):
    return prep.add_bias(lineitem(spark, d)).select(*LINE, *S.X3, "bias")


@query
def mask_rows(spark, d):
    df = lineitem(spark, d)
    return df.filter((F.col("l_returnflag") == "A") | (F.col("l_returnflag") == "R")).filter(
        F.col("l_quantity") <= 25).select(*LINE, "l_returnflag", "l_quantity")


@query
def split_by_key(spark, d):
    train, held = prep.split_by_key(lineitem(spark, d), "l_orderkey", 10)
    return train.select(*LINE, F.lit("train").alias("part")).unionByName(held.select(*LINE, F.lit("held").alias("part")))


@query
def bag_of_words(spark, d):
    return prep.bag_of_words(table(spark, d, "documents"), "doc_id", "text", min_df=5)


@query
def char_ngrams(spark, d):
    return prep.char_ngrams(table(spark, d, "documents"), "doc_id", "text", 1, 3, min_df=3)


@query
def pca_projection(spark, d):
    df = prep.pca(table(spark, d, "embeddings"), "embedding", 2)
    return df.select("vec_id", F.round(F.get("pc", F.lit(0)), 6).alias("pc1"), F.round(F.get("pc", F.lit(1)), 6).alias("pc2"))


@query
def tsv_source(spark, d):
    rows = lineitem(spark, d).select(*LINE, F.concat_ws("\t", *[F.col(c).cast("string") for c in [*S.X3, "l_extendedprice"]]).alias("value"))
    return lines.parse_labeled_tsv(rows, 3, keep=LINE)


@query
def whitespace_source(spark, d):
    rows = lineitem(spark, d).select(*LINE, F.concat_ws("  ", *[F.col(c).cast("string") for c in [*S.X3, "l_extendedprice"]]).alias("value"))
    cols = ["f0", "f1", "f2", "label"]
    return rounded(prep.impute_mean(lines.parse_labeled_ws(rows, 3, keep=LINE), cols), **{c: 8 for c in cols})


@query
def bad_lines(spark, d):
    """Lines with a field missing or a word in it stand beside those that fit, counted per line number."""
    fields = [F.col(c).cast("string") for c in [*S.X3, "l_extendedprice"]]
    short = F.concat_ws("\t", *fields[:3])
    worded = F.concat_ws("\t", fields[0], F.lit("n/a"), *fields[2:])
    value = F.when(F.col("l_orderkey") % 7 == 0, short).when(F.col("l_orderkey") % 11 == 0, worded).otherwise(F.concat_ws("\t", *fields))
    rows = lines.parse_labeled_tsv(lineitem(spark, d).select("l_linenumber", value.alias("value")), 3, keep=["l_linenumber"], bad="line")
    out = rows.groupBy("l_linenumber").agg(F.count("line").alias("bad"), F.count("label").alias("good"), F.count_if(F.size(F.split("line", "\t")) == 3).alias("short"), F.sum("f0").alias("quantity"))
    return rounded(out, quantity=4)


@query
def pixel_source(spark, d):
    pixels = F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 1000), F.lit(256)).cast("string"))
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.concat_ws(",", F.col("label").cast("string"), F.array_join(pixels, ",")).alias("value"))
    return rounded(lines.parse_labeled_pixels(rows, keep=["vec_id"]).select(
        "vec_id", "label", F.posexplode("pixels").alias("pos", "pixel")), pixel=8)


@query
def text_source(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.concat(F.lit("class_"), "lang"), "text").alias("value"))
    return lines.parse_labeled_text(rows, keep=["doc_id"]).select(
        "doc_id", "label", F.length("text").cast("long").alias("chars"), F.md5(F.col("text")).alias("digest"))


@query
def yes_no_source(spark, d):
    labelled = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").join(labelled, "doc_id")
    rows = docs.select("doc_id", F.concat_ws(" ", F.when(F.col("quality") == 1, "yes").otherwise("no"), "text").alias("value"))
    return lines.parse_labeled_text(rows, keep=["doc_id"], yes_no=True).select(
        "doc_id", "label", F.length("text").cast("long").alias("chars"))


# ---- naive Bayes ----

def gnb_model(df):
    return naive_bayes.gaussian_nb_fit(df, S.X4, "l_returnflag")


@query
def gnb_params(spark, d):
    out = gnb_model(lineitem(spark, d)).params(spark).withColumn("deviation", F.sqrt("var")).drop("var")
    return rounded(out, prior=8, mean=6, deviation=7)


@query
def gnb_log_proba(spark, d):
    df = lineitem(spark, d)
    out = gnb_model(df).predict_log_proba(df.select(*LINE, *S.X4), LINE)
    return rounded(out, jll=5, log_proba=6, proba=7)


@query
def gnb_predict(spark, d):
    df = lineitem(spark, d)
    return gnb_model(df).predict(df).select(*LINE, "l_returnflag", "prediction")


@query
def gnb_accuracy(spark, d):
    df = lineitem(spark, d)
    return rounded(metrics.accuracy(gnb_model(df).predict(df), "l_returnflag", "prediction"), accuracy=8, error_rate=8)


@query
def cv_gnb(spark, d):
    return rounded(naive_bayes.gaussian_nb_cross_validate(lineitem(spark, d), S.X4, "l_returnflag", "l_orderkey", 5), accuracy=8)


def word_table(spark, d, once=False):
    """The labelled documents and their word counts, tokenised once and written out.

    With ``once`` a single step reads the counts: it meets them where they are
    dealt out, and the counts of frequent tokens needn't be written out again.
    """
    docs = table(spark, d, "documents")
    counts = prep.bag_of_words(docs, "doc_id", "text", keep=["lang"], min_df=2)
    return docs.select("doc_id", "lang"), counts if once else laid_out(counts)


@query
def mnb_params(spark, d):
    docs, counts = word_table(spark, d, once=True)
    return rounded(naive_bayes.multinomial_nb_fit(docs, counts, "lang").log_prob(), log_prob=6)


@query
def mnb_log_proba(spark, d):
    docs, counts = word_table(spark, d)
    out = naive_bayes.multinomial_nb_fit(docs, counts, "lang").predict_log_proba(docs, counts, "doc_id")
    return rounded(out, jll=4, log_proba=4, proba=6)


@query
def mnb_predict(spark, d):
    docs, counts = word_table(spark, d)
    return naive_bayes.multinomial_nb_fit(docs, counts, "lang").predict(docs, counts, "doc_id")


LABEL_ROWS = 2_000_000  # labels of two numbers each that are copied to every task


def quality_model(spark, d, once=False):
    """Documents, word counts and the model of the labels; ``once`` as above, when the fit alone reads the counts."""
    labelled = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents")
    counts = prep.bag_of_words(docs, "doc_id", "text", min_df=2)
    counts = counts if once else laid_out(counts)
    parts = prep.text_parts(docs, "text") if once else counts.rdd.getNumPartitions()
    docs = docs.select("doc_id")
    # Tasks stay as many as the counts have, and large labels meet counts that pass by unsorted: neither grows with the tables.
    with configured(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        seen = keyed_join(counts, labelled, "doc_id", F.col("doc_id"), salts=1, broadcast_rows=LABEL_ROWS)
        model = naive_bayes.bernoulli_nb_fit(labelled, seen, "quality")
    return docs, counts, model


@query
def bnb_params(spark, d):
    return rounded(quality_model(spark, d, once=True)[2].log_prob(), log_prob=6)


@query
def bnb_log_proba(spark, d):
    docs, counts, model = quality_model(spark, d)
    return rounded(model.predict_log_proba(docs, counts, "doc_id"), jll=4, log_proba=4, proba=6)


@query
def bnb_predict(spark, d):
    docs, counts, model = quality_model(spark, d)
    return model.predict(docs, counts, "doc_id")


# ---- neighbours ----

@query
def knn_neighbors(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(neighbors.knn_join(e, e, "vec_id", "vec_id", "embedding", 5, skip_same_id=True), distance=6)


@query
def knn_predict(spark, d):
    e = table(spark, d, "embeddings")
    near = neighbors.knn_join(e, e, "vec_id", "vec_id", "embedding", 5, skip_same_id=True)
    return neighbors.knn_predict(near, e, "vec_id", "vec_id", "label")


# ---- trees ----

@query
def node_impurity(spark, d):
    df = lineitem(spark, d)
    out = splits.node_impurity(df, "l_linenumber", "l_returnflag", distinct_labels(df, "l_returnflag"), "l_extendedprice")
    return rounded(out, gini=8, entropy=8, mean=4, variance=1)


@query
def split_candidates(spark, d):
    return splits.split_candidates(lineitem(spark, d), [*S.X3, "l_linenumber"])


@query
def best_split_regression(spark, d):
    out = splits.best_split(lineitem(spark, d), S.X3, "l_extendedprice", node="l_linenumber")
    return out.select("node", "feature", "point", F.round("gain", 7).alias("gain"))


@query
def best_split_continuous(spark, d):
    out = splits.best_split(lineitem(spark, d), ["l_extendedprice"], "l_quantity", node="l_linenumber")
    return out.select("node", "feature", F.round("point", 4).alias("point"), F.round("gain", 7).alias("gain"))


@query
def best_split_gini(spark, d):
    out = splits.best_split(lineitem(spark, d), S.X3, "l_returnflag", "gini", node="l_linenumber", edges=True)
    return out.select("node", "feature", "point", F.round("gain", 7).alias("gain"))


@query
def best_split_entropy(spark, d):
    out = splits.best_split(lineitem(spark, d), S.X3, "l_returnflag", "entropy", node="l_linenumber", edges=True)
    return out.select("node", "feature", "point", F.round("gain", 7).alias("gain"))


def price_tree(df, depth=2):
    return trees.tree_regress_fit(df, S.X3, "l_extendedprice", max_depth=depth)


@query
def tree_regress(spark, d):
    return rounded(rooted(price_tree(lineitem(spark, d)).table(spark).drop("label")), impurity=1, value=4)


@query
def tree_regress_predict(spark, d):
    df = lineitem(spark, d)
    return rounded(price_tree(df).predict(df).select(*LINE, "prediction"), prediction=4)


@query
def tree_regress_score(spark, d):
    df = lineitem(spark, d)
    scored = price_tree(df).predict(df)
    return rounded(scored.agg(metrics.r2_of("l_extendedprice", "prediction").alias("r2"),
                              metrics.mse_of("l_extendedprice", "prediction").alias("mse")), r2=8, mse=1)


@query
def tree_classify(spark, d):
    t = trees.tree_classify_fit(lineitem(spark, d), S.X3, "l_linestatus", max_depth=2)
    return rounded(rooted(t.table(spark)), impurity=8)


@query
def tree_classify_entropy(spark, d):
    t = trees.tree_classify_fit(lineitem(spark, d), S.X3, "l_returnflag", criterion="entropy", max_depth=2)
    return rounded(rooted(t.table(spark)), impurity=8)


@query
def tree_classify_predict(spark, d):
    df = lineitem(spark, d)
    t = trees.tree_classify_fit(df, S.X3, "l_returnflag", max_depth=2)
    return t.predict(df).select(*LINE, "l_returnflag", "prediction")


@query
def tree_edges(spark, d):
    return rounded(rooted(price_tree(lineitem(spark, d)).edges(spark).drop("label")), impurity=1, value=4)


def pruned(spark, d):
    train, held = prep.split_by_key(lineitem(spark, d), "l_orderkey", 10)
    return trees.prune_sequence(price_tree(train, 3)), held


@query
def prune_sequence(spark, d):
    return rounded(trees.sequence_table(spark, pruned(spark, d)[0]), alpha=-3, cost=-4)


@query
def prune_select(spark, d):
    steps, held = pruned(spark, d)
    scores, best = trees.select_subtree(steps, held, "l_extendedprice")
    rows = [(k, float(r2), len(steps[k][1].leaves()), steps[k][1] is best) for k, _, r2 in scores]
    return rounded(spark.createDataFrame(rows, "step int, r2 double, leaves int, chosen boolean"), r2=8)


def shown(found, spark):
    return rounded(found.table(spark), score=8)


@query
def tree_regress_grid(spark, d):
    """R2 of every depth and smallest node on the rows that each of three folds holds out."""
    grid = {"max_depth": S.GRID_DEPTHS, "min_samples": S.GRID_SAMPLES}
    return shown(grids.tree_regress_grid(lineitem(spark, d), S.X3, "l_extendedprice", grid, "l_orderkey", S.GRID_FOLDS), spark)


@query
def tree_classify_grid(spark, d):
    """Share of held rows with their own flag, for both criteria and every depth."""
    grid = {"criterion": ["gini", "entropy"], "max_depth": S.GRID_DEPTHS}
    return shown(grids.tree_classify_grid(lineitem(spark, d), S.X3, "l_returnflag", grid, "l_orderkey", S.GRID_FOLDS), spark)


@query
def stump_grid(spark, d):
    """R2 on the held rows after one, two and three rounds of boosted stumps."""
    rounds = list(range(1, S.ROUNDS + 1))
    return shown(grids.stump_grid(lineitem(spark, d), S.X3, "l_extendedprice", rounds, "l_orderkey", S.GRID_FOLDS), spark)


# ---- boosting ----

def price_stumps(df):
    return boosting.stump_regress_fit(df, S.X3, "l_extendedprice", S.ROUNDS)


@query
def stump_regress(spark, d):
    return rounded(price_stumps(lineitem(spark, d)).table(spark), left_output=4, right_output=4)


@query
def stump_regress_predict(spark, d):
    df = lineitem(spark, d)
    return rounded(price_stumps(df).predict(df).select(*LINE, "prediction"), prediction=4)


@query
def staged_r2(spark, d):
    df = lineitem(spark, d)
    return rounded(boosting.staged_r2(price_stumps(df), df, "l_extendedprice"), r2=8)


def status_ada(df):
    return boosting.adaboost_fit(df, S.X3, "l_linestatus", S.ROUNDS)


@query
def adaboost_rounds(spark, d):
    return rounded(status_ada(lineitem(spark, d)).table(spark), error=8, alpha=7)


@query
def adaboost_score(spark, d):
    df = lineitem(spark, d)
    return rounded(status_ada(df).decision_function(df).select(*LINE, "score"), score=7)


@query
def adaboost_predict(spark, d):
    df = lineitem(spark, d)
    return status_ada(df).predict(df).select(*LINE, "l_linestatus", "prediction")


@query
def adaboost_staged_error(spark, d):
    df = lineitem(spark, d)
    return rounded(boosting.staged_error(status_ada(df), df, "l_linestatus"), error_rate=8)


@query
def adaboost_roc(spark, d):
    df = lineitem(spark, d)
    scored = rounded(status_ada(df).decision_function(df), score=7)
    return rounded(metrics.roc_points(scored, F.col("l_linestatus") == "O", "score"), threshold=7, tpr=8, fpr=8)


@query
def adaboost_auc(spark, d):
    df = lineitem(spark, d)
    scored = rounded(status_ada(df).decision_function(df), score=7)
    return rounded(metrics.auc(scored, F.col("l_linestatus") == "O", "score"), auc=8)


@query
def price_roc(spark, d):
    return rounded(metrics.roc_points(lineitem(spark, d), F.col("l_linestatus") == "O", "l_quantity"), tpr=8, fpr=8)


def price_boost(df):
    return boosting.boosted_trees_fit(df, S.X3, "l_extendedprice", 2, max_depth=2)


@query
def boosted_trees(spark, d):
    return rounded(rooted(price_boost(lineitem(spark, d)).table(spark).drop("label")), impurity=1, value=4)


@query
def boosted_trees_predict(spark, d):
    df = lineitem(spark, d)
    return rounded(price_boost(df).predict(df).select(*LINE, "prediction"), prediction=4)


@query
def gbdt_gradient(spark, d):
    df = prep.encode_labels(lineitem(spark, d), "l_linestatus", "code", signed="y")
    return rounded(df.select(*LINE, boosting.negative_gradient(F.col("y"), F.col("l_tax")).alias("gradient")), gradient=8)


def status_gbdt(df):
    return boosting.gbdt_fit(df, S.X3, "l_linestatus", 2, S.GBDT_RATE, max_depth=2)


@query
def gbdt_leaves(spark, d):
    out = status_gbdt(lineitem(spark, d)).table(spark).filter(F.col("feature").isNull())
    return rounded(out.select("round", "node_id", "samples", "value"), value=7)


@query
def gbdt_proba(spark, d):
    df = lineitem(spark, d)
    return rounded(status_gbdt(df).predict_proba(df).select(*LINE, "proba"), proba=8)


@query
def gbdt_predict(spark, d):
    df = lineitem(spark, d)
    return status_gbdt(df).predict(df).select(*LINE, "prediction")


# ---- linear models ----

def upper_logit(e, **options):
    return linear.logistic_fit(e, "embedding", "upper", S.LOGIT_RATE, S.LOGIT_DECAY, S.LOGIT_C, S.STEPS, **options)


@query
def logistic_weights(spark, d):
    return rounded(upper_logit(embeddings(spark, d)).table(spark), weight=7)


@query
def logistic_gradient(spark, d):
    e = embeddings(spark, d)
    g = linear.logistic_gradient(e, "embedding", "upper", [[0.0]] * 64 + [[0.5]])
    rows = [(i, float(v)) for i, v in enumerate(g.ravel())]
    return rounded(spark.createDataFrame(rows, "feature int, gradient double"), gradient=6)


@query
def logistic_predict(spark, d):
    e = embeddings(spark, d)
    return upper_logit(e).predict(e).select("vec_id", "prediction")


@query
def logistic_minibatch(spark, d):
    e = embeddings(spark, d)
    return rounded(upper_logit(e, solver="minibatch", id_col="vec_id", batch_share=S.BATCH_SHARE).table(spark), weight=7)


def label_logit(e):
    return linear.logistic_fit(e, "embedding", "label", S.LOGIT_RATE, S.LOGIT_DECAY, S.LOGIT_C, S.STEPS)


@query
def logistic_ovr(spark, d):
    return rounded(label_logit(embeddings(spark, d)).table(spark), weight=7)


@query
def logistic_ovr_predict(spark, d):
    e = embeddings(spark, d)
    return label_logit(e).predict(e).select("vec_id", "prediction")


@query
def perceptron_batch(spark, d):
    p = linear.perceptron_fit(embeddings(spark, d), "embedding", "upper", max_epochs=S.STEPS)
    return rounded(p.table(spark), weight=6)


@query
def perceptron_mistakes(spark, d):
    p = linear.perceptron_fit(embeddings(spark, d), "embedding", "upper", max_epochs=S.STEPS)
    return spark.createDataFrame(p.updates, "epoch int, mistakes int")


@query
def perceptron_predict(spark, d):
    e = embeddings(spark, d)
    return linear.perceptron_fit(e, "embedding", "upper", max_epochs=S.STEPS).predict(e).select("vec_id", "prediction")


@query
def perceptron_dual(spark, d):
    p = linear.perceptron_dual_fit(embeddings(spark, d), "embedding", "upper", "vec_id", max_updates=S.UPDATES)
    return spark.createDataFrame(p.updates, "vec_id long, alpha double")


def order_extremes(spark, d):
    """Per order the largest quantity, discount and tax as centred whole numbers, and on which side of a plane they lie."""
    rows = lineitem(spark, d).groupBy("l_orderkey").agg(
        (F.max("l_quantity") - 25).alias("x1"), (F.round(F.max("l_discount") * 100) - 5).alias("x2"), (F.round(F.max("l_tax") * 100) - 4).alias("x3"))
    side = sum((F.lit(a) * F.col(c) for a, c in zip(S.PLANE[:3], ["x1", "x2", "x3"])), F.lit(S.PLANE[3]))
    return rows.withColumn("side", F.when(side > 0, 1).otherwise(0))


@query
def perceptron_dual_converged(spark, d):
    """All updates until no row is wrong: how often each order was taken."""
    p = linear.perceptron_dual_fit(order_extremes(spark, d), ["x1", "x2", "x3"], "side", "l_orderkey", max_updates=1_000_000)
    return spark.createDataFrame(p.updates, "l_orderkey long, alpha double").withColumn("converged", F.lit(p.converged))


@query
def perceptron_dual_replayed(spark, d):
    """The same with blocks far smaller than the table, and whether the passes are far fewer than the updates."""
    p = linear.perceptron_dual_fit(order_extremes(spark, d), ["x1", "x2", "x3"], "side", "l_orderkey", max_updates=1_000_000, block=512)
    few = F.lit(p.jobs * 10 < sum(a for _, a in p.updates))
    return spark.createDataFrame(p.updates, "l_orderkey long, alpha double").withColumn("few_passes", few)


# ---- maximum entropy ----

@query
def maxent_expectations(spark, d):
    docs, counts = word_table(spark, d)
    classes = distinct_labels(docs, "lang")
    out = maxent.expectations(docs, counts, "lang", classes).select(
        "token", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("label"), "e")).alias("r"))
    return rounded(out.select("token", F.col("r.label").alias("label"), F.col("r.e").alias("expectation")), expectation=8)


def lang_maxent(docs, counts):
    return maxent.maxent_fit(docs, counts, "doc_id", "lang", max_iter=2, eps=0.0)


def whole_maxent(docs, counts):
    """All steps that the method allows: one moves a weight by little on long documents, so an ``eps`` on that would end the fit at once."""
    return maxent.maxent_fit(docs, counts, "doc_id", "lang", eps=0.0)


def word_blocks(spark, d):
    """The labelled documents, and their word counts packed by document for a fit and its predictions."""
    docs, counts = word_table(spark, d, once=True)
    parts = prep.text_parts(table(spark, d, "documents"), "text")
    return docs, token_blocks.pack(counts, "doc_id", parts, "lang", distinct_labels(docs, "lang"))


@query
def maxent_iis(spark, d):
    return rounded(lang_maxent(*word_blocks(spark, d)).table(), weight=9)


@query
def maxent_proba(spark, d):
    docs, counts = word_blocks(spark, d)
    return rounded(lang_maxent(docs, counts).predict_proba(docs, counts, "doc_id"), proba=7)


@query
def maxent_predict(spark, d):
    docs, counts = word_blocks(spark, d)
    return lang_maxent(docs, counts).predict(docs, counts, "doc_id")


@query
def maxent_lbfgs(spark, d):
    classes, w = maxent.maxent_fit_lbfgs(embeddings(spark, d), "embedding", "label", max_iter=100, reg_param=0.01)
    rows = [(int(c), f, float(v)) for c, row in zip(classes, w) for f, v in enumerate(row)]
    return spark.createDataFrame(rows, "label int, feature int, weight double")


@query
def maxent_newton(spark, d):
    """Weights after two quasi-Newton steps on the token table."""
    docs, counts = word_blocks(spark, d)
    return rounded(quasi_newton.token_newton_fit(docs, counts, "doc_id", "lang", max_iter=2, eps=0.0).table(), weight=6)


@query
def maxent_newton_salted(spark, d):
    """The same with more tokens than are sent to every task."""
    docs, counts = word_blocks(spark, d)
    return rounded(quasi_newton.token_newton_fit(docs, counts, "doc_id", "lang", max_iter=2, eps=0.0, broadcast_rows=0).table(), weight=6)


@query
def maxent_newton_converged(spark, d):
    """A fit to its end: whether the gradient is under eps, each step lowered the loss, and how many documents get their own label."""
    docs, counts = word_blocks(spark, d)
    fit = quasi_newton.token_newton_fit(docs, counts, "doc_id", "lang")
    losses = [s[1] for s in fit.steps]
    right = fit.predict(docs, counts, "doc_id").join(docs, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("lang")).cast("double")).alias("right"))
    return right.select("n", F.lit(fit.converged).alias("converged"), F.lit(fit.steps[-1][2] < 1e-2).alias("small_gradient"),
                        F.lit(all(a > b for a, b in zip(losses, losses[1:]))).alias("falling"), (F.col("right") > 0.95).alias("fits"))


# ---- kernels ----

def support_table(e):
    """Per label the row with the smallest norm, as a small support table."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    pick = F.min(F.struct(F.round(norm, 9).alias("norm"), "vec_id", "embedding")).alias("r")
    return e.groupBy("label").agg(pick).select(
        F.col("r.vec_id").alias("sv_id"), F.col("r.embedding").alias("embedding"),
        F.when(F.col("label") >= 5, 1.0).otherwise(-1.0).alias("y"), F.lit(S.SV_ALPHA).alias("alpha"))


@query
def kernel_pairs(spark, d):
    e = embeddings(spark, d)
    sv = support_table(e)
    ids = F.array(*[F.lit(r["sv_id"]).cast("long") for r in sv.select("sv_id").orderBy("sv_id").collect()])
    out = kernels.kernel_rows(e, sv, "vec_id", "embedding", "rbf", S.SIGMA)
    return rounded(out.select("vec_id", F.explode(F.arrays_zip(ids.alias("sv_id"), "kernel")).alias("r")).select(
        "vec_id", F.col("r.sv_id").alias("sv_id"), F.col("r.kernel").alias("kernel")), kernel=8)


def svm_scored(e, kind="rbf", **options):
    signed = e.withColumn("y", F.when(F.col("upper") == 1, 1.0).otherwise(-1.0))
    return kernels.decision_function(signed, support_table(e), S.SV_B, "vec_id", "embedding", keep=["y"], kind=kind,
                                     sigma=S.SIGMA, **options)


@query
def svm_decision(spark, d):
    return rounded(svm_scored(embeddings(spark, d)), score=7)


@query
def svm_decision_linear(spark, d):
    return rounded(svm_scored(embeddings(spark, d), "linear"), score=7)


@query
def svm_predict(spark, d):
    return kernels.kernel_predict(svm_scored(embeddings(spark, d)), [0, 1]).select("vec_id", "prediction")


@query
def svm_kkt(spark, d):
    e = embeddings(spark, d)
    return rounded(kernels.kkt_violations(svm_scored(e), support_table(e), "vec_id", "y"), score=7, error=7)


@query
def svm_weights(spark, d):
    return rounded(kernels.weights_from_support(support_table(embeddings(spark, d)), "embedding"), weight=7)


@query
def svm_linear(spark, d):
    return rounded(kernels.svm_linear_fit(embeddings(spark, d), "embedding", "upper", C=S.SVM_C, max_iter=S.STEPS).table(spark), weight=7)


@query
def svm_rbf(spark, d):
    e = embeddings(spark, d)
    return kernels.svm_rbf_fit(e, "embedding", "upper", sigma=S.SIGMA, n_components=64, seed=7, max_iter=10).predict(e).select(
        "vec_id", "prediction")


def svm_dual(e, kind, **options):
    fit = dual_svm.dual_linear_fit if kind == "linear" else dual_svm.dual_rbf_fit
    return fit(e, "embedding", "upper", "vec_id", C=S.SVM_C, **options)


def svm_dual_scored(e, fit, kind):
    signed = e.withColumn("y", F.when(F.col("upper") == 1, 1.0).otherwise(-1.0)).withColumnRenamed("embedding", "x")
    return kernels.decision_function(signed, fit.support, fit.b, "vec_id", "x", keep=["y"], kind=kind, sigma=S.SIGMA)


def svm_dual_report(spark, d, kind):
    """A fit to its duality gap, and whether primal and dual value follow again from its table of multipliers."""
    e = embeddings(spark, d)
    fit = svm_dual(e, kind)
    hinge = F.sum(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("y") * F.col("score")))
    scored = svm_dual_scored(e, fit, kind).join(fit.support.select(F.col("sv_id").alias("vec_id"), "alpha"), "vec_id", "left").agg(
        F.count("*").alias("n"), hinge.alias("hinge"), F.sum("alpha").alias("alphas"), F.sum(F.col("alpha") * F.col("y") * F.col("score")).alias("square"))
    feasible = (fit.support.agg(F.max("alpha")).first()[0] or 0.0) <= S.SVM_C
    primal = F.col("square") / 2 + S.SVM_C * F.col("hinge")
    gap = primal - (F.col("alphas") - F.col("square") / 2)
    return scored.select(
        "n", F.lit(fit.converged).alias("converged"), F.lit(feasible).alias("feasible"), (F.abs(primal / fit.primal - 1) < 1e-7).alias("same_value"), (gap <= 1.01e-3 * primal).alias("small_gap"))


@query
def svm_dual_linear(spark, d):
    return svm_dual_report(spark, d, "linear")


@query
def svm_dual_rbf(spark, d):
    return svm_dual_report(spark, d, "rbf")


@query
def svm_dual_kkt(spark, d):
    """Rows that break optimality by 0.05 after a fit to a gap of a millionth, which allows half of that, and whether each class has rows on its side."""
    e = embeddings(spark, d)
    fit = svm_dual(e, "rbf", tol=1e-6)
    scored = svm_dual_scored(e, fit, "rbf")
    broken = kernels.kkt_violations(scored, fit.support, "vec_id", "y", C=S.SVM_C, tol=0.05).select("vec_id", F.lit(1).alias("broken"))
    return scored.join(broken, "vec_id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))


@query
def svm_dual_weights(spark, d):
    """The linear fit's weights from its multipliers, as far as they differ from the ones it kept."""
    e = embeddings(spark, d)
    fit = svm_dual(e, "linear")
    kept = F.get(F.array(*[F.lit(float(v)) for v in fit.w]), F.col("feature"))
    return kernels.weights_from_support(fit.support, "x").select("feature", (F.round(F.abs(F.col("weight") - kept), 6) + F.lit(0.0)).alias("off"))


# ---- mixtures ----

def purchase_trials(spark, d):
    tosses = table(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("hit"))
    return mixture.coin_trials(tosses, "user_id", "hit")


def purchase_coins(trials):
    return mixture.coin_em_fit(trials, "heads", "n", *S.COIN_START, eps=0.0, max_iter=S.STEPS)


@query
def coin_em(spark, d):
    return rounded(purchase_coins(purchase_trials(spark, d)).table(spark), theta_a=8, theta_b=8)


@query
def coin_responsibilities(spark, d):
    trials = purchase_trials(spark, d)
    return rounded(purchase_coins(trials).responsibilities(trials, "heads", "n"), share_a=7, share_b=7)


def value_mixture(df):
    return mixture.gmm_fit(df, "value", mixture.MixtureModel(*S.GMM_START), eps=0.0, max_iter=S.STEPS)


@query
def gmm_fit(spark, d):
    return rounded(value_mixture(table(spark, d, "events")).table(spark), alpha=8, mu=6, sigma_square=4)


@query
def gmm_responsibilities(spark, d):
    df = table(spark, d, "events")
    return rounded(value_mixture(df).responsibilities(df, "value", ["event_id"]), responsibility=7)


# ---- sequences ----

def event_runs(spark, d):
    return sequence.pack_sequences(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type", S.SYMBOLS)


def hmm_start():
    return sequence.HmmParams.of(S.SYMBOLS, S.HMM_START, S.HMM_TRANS, S.HMM_EMIT)


def by_event(df):
    return df.withColumnsRenamed({"seq": "user_id", "row_id": "event_id"})


@query
def hmm_forward(spark, d):
    return rounded(by_event(sequence.forward_table(event_runs(spark, d), hmm_start())), log_alpha=6)


@query
def hmm_backward(spark, d):
    return rounded(by_event(sequence.backward_table(event_runs(spark, d), hmm_start())), log_beta=6)


@query
def hmm_likelihood(spark, d):
    runs = event_runs(spark, d)
    ahead = sequence.log_likelihood(runs, hmm_start()).withColumnRenamed("log_likelihood", "forward")
    back = sequence.backward_log_likelihood(runs, hmm_start()).withColumnRenamed("log_likelihood", "backward")
    return rounded(by_event(ahead.join(back, "seq")), forward=6, backward=6)


@query
def hmm_baum_welch(spark, d):
    p, _, _ = sequence.hmm_fit(event_runs(spark, d), hmm_start(), eps=0.0, max_iter=1)
    return rounded(p.table(spark).withColumn("i", F.coalesce("i", F.lit(-1))), p=8)


@query
def hmm_viterbi(spark, d):
    return by_event(sequence.hmm_decode(event_runs(spark, d), hmm_start()))


# ---- models written by one session and read by another ----

def reread(spark, model):
    """A new session, and the model as that session reads it."""
    folder = models.scratch_folder(spark)
    models.save_model(spark, model, folder)
    fresh = spark.newSession()
    return fresh, models.load_model(fresh, folder, models.NAMES[type(model)])


@query
def reread_gnb(spark, d):
    fresh, model = reread(spark, gnb_model(lineitem(spark, d)))
    return model.predict(lineitem(fresh, d)).select(*LINE, "l_returnflag", "prediction")


@query
def reread_mnb(spark, d):
    fresh, model = reread(spark, naive_bayes.multinomial_nb_fit(*word_table(spark, d, once=True), "lang"))
    return model.predict(*word_table(fresh, d, once=True), "doc_id")


@query
def reread_bnb(spark, d):
    fresh, model = reread(spark, quality_model(spark, d, once=True)[2])
    docs = table(fresh, d, "documents")
    return model.predict(docs.select("doc_id"), prep.bag_of_words(docs, "doc_id", "text", min_df=2), "doc_id")


@query
def reread_tree(spark, d):
    fresh, model = reread(spark, trees.tree_classify_fit(lineitem(spark, d), S.X3, "l_returnflag", max_depth=2))
    return model.predict(lineitem(fresh, d)).select(*LINE, "l_returnflag", "prediction")


@query
def reread_node_tree(spark, d):
    fresh, model = reread(spark, node_tables.tree_table_fit(lineitem(spark, d), S.X3, "l_extendedprice", max_depth=2, small_rows=100))
    return rounded(model.predict(lineitem(fresh, d)).select(*LINE, "prediction"), prediction=4)


@query
def reread_stumps(spark, d):
    fresh, model = reread(spark, price_stumps(lineitem(spark, d)))
    return rounded(model.predict(lineitem(fresh, d)).select(*LINE, "prediction"), prediction=4)


@query
def reread_adaboost(spark, d):
    fresh, model = reread(spark, status_ada(lineitem(spark, d)))
    return rounded(model.decision_function(lineitem(fresh, d)).select(*LINE, "score"), score=7)


@query
def reread_gbdt(spark, d):
    fresh, model = reread(spark, status_gbdt(lineitem(spark, d)))
    return rounded(model.predict_proba(lineitem(fresh, d)).select(*LINE, "proba"), proba=8)


@query
def reread_logistic(spark, d):
    fresh, model = reread(spark, label_logit(embeddings(spark, d)))
    return model.predict(embeddings(fresh, d)).select("vec_id", "prediction")


@query
def reread_perceptron(spark, d):
    fresh, model = reread(spark, linear.perceptron_fit(embeddings(spark, d), "embedding", "upper", max_epochs=S.STEPS))
    return model.predict(embeddings(fresh, d)).select("vec_id", "prediction")


@query
def reread_maxent(spark, d):
    fresh, model = reread(spark, whole_maxent(*word_blocks(spark, d)))
    return model.predict(*word_blocks(fresh, d), "doc_id")


@query
def reread_svm(spark, d):
    """The largest difference that reading the multipliers back makes to a row's score."""
    fit = svm_dual(embeddings(spark, d), "linear")
    fresh, model = reread(spark, fit)
    before = svm_dual_scored(embeddings(spark, d), fit, "linear").select("vec_id", F.col("score").alias("was"))
    after = svm_dual_scored(embeddings(fresh, d), model, "linear").select("vec_id", "score")
    off = F.abs(F.col("score") - F.col("was"))
    return after.join(before, "vec_id").agg(F.count("*").alias("n"), (F.round(F.max(off), 8) + F.lit(0.0)).alias("off"))


@query
def reread_coins(spark, d):
    fresh, model = reread(spark, purchase_coins(purchase_trials(spark, d)))
    return rounded(model.responsibilities(purchase_trials(fresh, d), "heads", "n"), share_a=7, share_b=7)


@query
def reread_mixture(spark, d):
    fresh, model = reread(spark, value_mixture(table(spark, d, "events")))
    return rounded(model.responsibilities(table(fresh, d, "events"), "value", ["event_id"]), responsibility=7)


@query
def reread_hmm(spark, d):
    fresh, model = reread(spark, hmm_start())
    return by_event(sequence.hmm_decode(event_runs(fresh, d), model))


# ---- token models on streams ----

def streamed(spark, d, model, **options):
    """The predictions of a stream over the documents' files, read back when it has ended."""
    folder = models.scratch_folder(spark)
    docs = table(spark, d, "documents").schema
    # As a pattern the path may name a folder of files or a single file.
    stream = spark.readStream.schema(docs).parquet(f"{d}/documents.parque[t]")
    streams.write_predictions(model, stream, "doc_id", "text", f"{folder}/out", f"{folder}/log", **options).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "prediction")


@query
def stream_mnb(spark, d):
    return streamed(spark, d, naive_bayes.multinomial_nb_fit(*word_table(spark, d), "lang"))


@query
def stream_mnb_joined(spark, d):
    """The same with a model that isn't sent to every task."""
    return streamed(spark, d, naive_bayes.multinomial_nb_fit(*word_table(spark, d), "lang"), broadcast_rows=0)


@query
def stream_bnb(spark, d):
    return streamed(spark, d, quality_model(spark, d)[2])


@query
def stream_maxent(spark, d):
    return streamed(spark, d, whole_maxent(*word_blocks(spark, d)))


# ---- whole fits, and the other side of each switch that depends on the size ----

def suppliers(spark, d):
    """Targets over nine decades, and a label of three classes."""
    size = F.pow(F.lit(10.0), (F.col("s_suppkey") % 10).cast("double"))
    return table(spark, d, "supplier").withColumn("wide", size + F.col("s_nationkey")).withColumn("third", F.col("s_nationkey") % 3)


@query
def tree_regress_full(spark, d):
    df = suppliers(spark, d)
    return trees.tree_regress_fit(df, ["s_acctbal"], "s_nationkey").predict(df).select("s_suppkey", F.round("prediction", 8).alias("prediction"))


@query
def tree_regress_wide(spark, d):
    df = suppliers(spark, d)
    return trees.tree_regress_fit(df, ["s_acctbal"], "wide").predict(df).select("s_suppkey", F.round("prediction", 4).alias("prediction"))


@query
def tree_classify_full(spark, d):
    df = suppliers(spark, d)
    return trees.tree_classify_fit(df, ["s_acctbal"], "third").predict(df).select("s_suppkey", "prediction")


@query
def tree_table_full(spark, d):
    """A tree on a continuous feature, grown to the end, with its nodes in a table."""
    df = lineitem(spark, d)
    tree = node_tables.tree_table_fit(df, ["l_extendedprice"], "l_quantity")
    return rounded(tree.predict(df).select(*LINE, "l_extendedprice", "prediction"), prediction=8)


@query
def tree_table_costs(spark, d):
    """Loss of the whole table and of all leaves of the full tree."""
    tree = node_tables.tree_table_fit(lineitem(spark, d), ["l_extendedprice"], "l_quantity")
    return rounded(node_tables.subtree_costs(tree).where("node = 1").select("loss", "cost"), loss=2, cost=2)


@query
def tree_table_predict(spark, d):
    """Nodes split level by level as rows, two levels over many rows."""
    df = lineitem(spark, d)
    tree = node_tables.tree_table_fit(df, S.X3, "l_extendedprice", max_depth=2, small_rows=100)
    return rounded(tree.predict(df).select(*LINE, "prediction"), prediction=4)


@query
def tree_table_classify(spark, d):
    df = lineitem(spark, d)
    tree = node_tables.tree_table_classify_fit(df, S.X3, "l_returnflag", max_depth=2, small_rows=100)
    return tree.predict(df).select(*LINE, "l_returnflag", "prediction")


@query
def gbdt_full(spark, d):
    """Gradient boosting with trees of any depth: two rounds on a continuous feature."""
    df = lineitem(spark, d)
    model = node_tables.gbdt_table_fit(df, ["l_extendedprice"], "l_linestatus", n_estimators=2, learning_rate=S.GBDT_RATE)
    return rounded(model.score(df).select(*LINE, "l_extendedprice", "score"), score=6)


@query
def split_by_null_key(spark, d):
    keyed = lineitem(spark, d).select(*LINE, F.nullif(F.col("l_orderkey"), F.col("l_orderkey") - F.col("l_orderkey") % 7).alias("key"))
    train, held = prep.split_by_key(keyed, "key", 10)
    return train.select(*LINE, F.lit("train").alias("part")).unionByName(held.select(*LINE, F.lit("held").alias("part")))


@query
def pca_centre(spark, d):
    df = prep.pca(table(spark, d, "embeddings"), "embedding", 2)
    pc = [F.get("pc", F.lit(i)) for i in range(2)]
    names = ["mean1", "mean2", "cross"]
    return df.agg(F.count("*").alias("n"), *[(F.round(F.avg(v), 9) + F.lit(0.0)).alias(n) for n, v in zip(names, [*pc, pc[0] * pc[1]])])


@query
def pca_wide(spark, d):
    """Block iteration to its end on the embeddings: whether it gives the coordinates of the exact axes."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    fit = wide_pca.wide_pca_fit(e, "embedding", 2)
    exact = prep.pca(e, "embedding", 2).select("vec_id", F.col("pc").alias("exact"))
    off = F.array_max(F.zip_with("pc", "exact", lambda a, b: F.abs(a - b)))
    return fit.project(e).join(exact, "vec_id").agg(
        F.count("*").alias("n"), F.lit(fit.converged).alias("converged"), (F.max(off) < 1e-5).alias("agrees"))


@query
def pca_wide_words(spark, d):
    """Components of all documents over 5,000 columns of hashed words: variances and the means and products of coordinates."""
    words = F.split(F.lower("text"), r"\s+")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(S.WIDE)).cast("int"))
    docs = checkpointed(table(spark, d, "documents").select("doc_id", places.alias("at")))
    fit = wide_pca.wide_pca_fit(docs, "at", 2, tol=1e-6, wide=S.WIDE)
    pc = [F.get("pc", F.lit(i)) for i in range(2)]
    moments = fit.project(docs).agg(F.count("*").alias("n"), *[F.avg(v).alias(m) for v, m in zip([*pc, pc[0] * pc[1]], ["m1", "m2", "cross"])],
                                     *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(pc)])
    scale = float(fit.variances[0])
    small = [F.abs(F.col(c)) < 1e-6 * (1 + scale) for c in ("m1", "m2", "cross")]
    return moments.select("n", F.lit(fit.converged).alias("converged"), (small[0] & small[1]).alias("centred"), small[2].alias("uncorrelated"),
                          (F.greatest(*[F.abs(F.col(f"v{i}") - F.lit(float(v))) for i, v in enumerate(fit.variances)]) < 1e-6 * (1 + scale)).alias("variances"))


@query
def best_split_bucketed(spark, d):
    out = splits.best_split(lineitem(spark, d), ["l_extendedprice"], "l_quantity", node="l_linenumber", max_distinct=1000, buckets=16)
    return out.select("node", "feature", F.round("point", 4).alias("point"), F.round("gain", 7).alias("gain"))


@query
def price_roc_bucketed(spark, d):
    out = metrics.roc_points(lineitem(spark, d), F.col("l_linestatus") == "O", "l_quantity", max_distinct=10, buckets=8)
    return rounded(out, tpr=8, fpr=8)


@query
def boosted_trees_uncollapsed(spark, d):
    """Rows as they are, and the score written out every round."""
    df = lineitem(spark, d)
    model = boosting.boosted_trees_fit(df, S.X3, "l_extendedprice", 2, max_depth=2, collapse_rows=False, checkpoint_every=1)
    return rounded(rooted(model.table(spark).drop("label")), impurity=1, value=4)


@query
def svm_decision_tiled(spark, d):
    return rounded(svm_scored(embeddings(spark, d), tile_rows=64, max_inline=0), score=7)


def split_runs(spark, d):
    """Every sequence in several runs and partitions."""
    return sequence.pack_sequences(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type", S.SYMBOLS,
                                   max_run=16, partitions=4)


@query
def hmm_forward_split(spark, d):
    return rounded(by_event(sequence.forward_table(split_runs(spark, d), hmm_start())), log_alpha=6)


@query
def hmm_backward_split(spark, d):
    return rounded(by_event(sequence.backward_table(split_runs(spark, d), hmm_start())), log_beta=6)


@query
def hmm_baum_welch_split(spark, d):
    p, _, _ = sequence.hmm_fit(split_runs(spark, d), hmm_start(), eps=0.0, max_iter=1)
    return rounded(p.table(spark).withColumn("i", F.coalesce("i", F.lit(-1))), p=8)


@query
def hmm_viterbi_split(spark, d):
    return by_event(sequence.hmm_decode(split_runs(spark, d), hmm_start()))


@query
def hmm_impossible(spark, d):
    """Days on which an event happens that no state emits have the logarithm of zero."""
    emit = [[0.0 if s == "error" else v for s, v in zip(S.SYMBOLS, row)] for row in S.HMM_EMIT]
    p = sequence.HmmParams.of(S.SYMBOLS, S.HMM_START, S.HMM_TRANS, emit)
    days = table(spark, d, "events").withColumn("day", F.col("user_id") * 1000 + F.dayofyear("ts"))
    runs = sequence.pack_sequences(days, "day", ["ts", "event_id"], "event_id", "event_type", S.SYMBOLS)
    return rounded(sequence.log_likelihood(runs, p).withColumnRenamed("seq", "day"), log_likelihood=6)


@query
def coin_em_converged(spark, d):
    """Every step of a fit that ends by itself, and whether it had converged there."""
    fit = mixture.coin_em_fit(purchase_trials(spark, d), "heads", "n", *S.COIN_START)
    steps = fit.table(spark).withColumn("converged", (F.col("step") == fit.iterations) & F.lit(fit.converged))
    return rounded(steps, theta_a=8, theta_b=8)
