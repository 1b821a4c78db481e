"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Each query is run to the
end (all rows produced); ``jobs`` counts the Spark jobs it took.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "gnb_params", "gnb_predict", "cv_gnb", "bag_of_words", "char_ngrams", "mnb_params", "mnb_predict", "bnb_predict",
    "knn_neighbors", "knn_predict", "best_split_regression", "best_split_continuous", "tree_regress", "tree_classify_predict",
    "prune_select", "stump_regress", "adaboost_rounds", "adaboost_auc", "boosted_trees", "gbdt_proba",
    "logistic_ovr", "perceptron_batch", "maxent_iis", "svm_decision", "svm_linear", "coin_em", "gmm_fit",
    "hmm_likelihood", "hmm_baum_welch", "hmm_viterbi",
]


def main():
    from tabulearn.plans.catalog import QUERIES
    from tabulearn.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=8, memory="12g", name="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    tracker = spark.sparkContext.statusTracker()
    times, jobs = {}, {}
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "jobs": jobs, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
