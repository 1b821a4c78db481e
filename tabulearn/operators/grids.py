"""Grid search over trees and boosted stumps: the folds grow in the same jobs, the parameters are read off them.

Limits only end a branch sooner. The tree of a lower depth, of larger nodes or
of less pure ones is the loosest tree cut back, and a model of k rounds is the
first k rounds of the longest one. So every fold is fit once, and the number of
jobs depends neither on the folds nor on the parameters.

A row is held out of one fold and trains the others; inside its task it is
repeated once per model it trains, with the fold as a key of the histogram. The
training sums are added up and not taken as total minus fold: a held row far
from the others would leave no digits of the difference.
"""

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import distinct_labels, literal_array
from tabulearn.operators.boosting import CHECKPOINT_EVERY, Stump, running_sums, stump_column
from tabulearn.operators.splits import ClassCounts, Variance, best_splits, centred, prepare
from tabulearn.operators.trees import Node, _impure, _top, descend, grow_forest
from tabulearn.session import checkpointed

# What a tree's fit takes where the grid doesn't name it.
LIMITS = {"max_depth": None, "min_samples": 2, "min_impurity": 0.0}


@dataclass
class GridScores:
    """``scores``: (parameters, fold, score or None), in the order of the grid."""

    names: list
    scores: list

    def means(self) -> list:
        """[(parameters, mean score)], best first; the grid's order decides a tie.

        A fold without held rows, or whose held targets are all equal, has no score and doesn't count.
        """
        by = {}
        for params, _, score in self.scores:
            by.setdefault(tuple(params[n] for n in self.names), []).append(score)
        out = []
        for values, scores in by.items():
            known = [s for s in scores if s is not None]
            out.append((dict(zip(self.names, values)), sum(known) / len(known) if known else None))
        return sorted(out, key=lambda r: float("inf") if r[1] is None else -round(r[1], 12))

    @property
    def best(self) -> dict:
        return self.means()[0][0]

    def table(self, spark) -> DataFrame:
        """One row per parameters and fold; a limit that isn't set is null."""
        kinds = {"max_depth": "int", "min_samples": "double", "min_impurity": "double", "criterion": "string", "n_estimators": "int"}
        rows = [(*[float(p[n]) if kinds[n] == "double" else p[n] for n in self.names], f, s) for p, f, s in self.scores]
        return spark.createDataFrame(rows, ", ".join([*[f"{n} {kinds[n]}" for n in self.names], "fold int", "score double"]))


def _fold(key: str, folds: int, features: list):
    if folds < 2:
        raise ValueError("need at least two folds")
    clash = set(features) & {"_fold", "leaf", *[f"_score{t}" for t in range(folds)]}
    if clash:
        raise ValueError(f"rename feature columns {sorted(clash)}")
    return F.pmod(F.col(key), F.lit(folds)).cast("int").alias("_fold")


def _trains(fold: int):
    """Rows with a null key train every fold."""
    return F.coalesce(F.col("_fold") != fold, F.lit(True))


def _combinations(grid: dict, known) -> tuple[list, list]:
    unknown = set(grid) - set(known)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if any(not list(v) for v in grid.values()):
        raise ValueError("a parameter without values")
    names = list(grid)
    return names, [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def _loosest(combinations: list) -> dict:
    limits = [LIMITS | {k: v for k, v in c.items() if k in LIMITS} for c in combinations]
    depths = [p["max_depth"] for p in limits]
    return {"max_depth": None if None in depths else max(depths),
            "min_samples": min(p["min_samples"] for p in limits), "min_impurity": min(p["min_impurity"] for p in limits)}


def _end(nodes: dict, leaf: int, params: dict) -> int:
    """Where a row that ends in ``leaf`` of the loosest tree ends under these limits."""
    limits = LIMITS | params
    depth = leaf.bit_length() - 1
    for k in range(depth):
        node = nodes[leaf >> (depth - k)]
        if k == limits["max_depth"] or node.size < limits["min_samples"] or not _impure(node, limits["min_impurity"]):
            return node.id
    return leaf


def _forest(data, features, sums, criterion, folds, limits, edges):
    table = data.table

    def rows_at(places):
        inside = [F.when(_trains(t), descend(features, forest[t], at, "long")) for t, at in places.items()]
        return table.withColumn("node", F.explode(F.array_compact(F.array(*inside))))

    squares = criterion is Variance
    everywhere = table.withColumn("node", F.explode(F.array_compact(F.array(*[F.when(_trains(t), F.lit(t)) for t in range(folds)]))))
    if squares:
        roots = everywhere.groupBy("node").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    else:
        roots = everywhere.groupBy("node").agg(*[F.sum(s).alias(s) for s in sums])
    found = {r["node"]: r.asDict() for r in roots.collect()}
    if len(found) < folds:
        raise ValueError("no rows to learn from in some fold")
    forest = []
    for t in range(folds):
        stats = found[t] | ({"s": 0.0, "q": 0.0} if squares else {})
        forest.append({1: Node(1, stats, criterion.number(stats), criterion.size(stats), mean=stats.get("m"))})
    grow_forest(forest, rows_at, features, sums, criterion, data.cuts, edges=edges, **limits)
    return forest


def _held(data, features, forest, of_leaf):
    """The held rows with ``leaf``, the place of their leaf in the tree that they didn't train, grouped by it."""
    order = [sorted(i for i, n in nodes.items() if n.is_leaf) for nodes in forest]
    leaf = F.coalesce(*[F.when(F.col("_fold") == t, descend(features, nodes, {i: k for k, i in enumerate(order[t])}, "long"))
                        for t, nodes in enumerate(forest)])
    rows = of_leaf(data.table.withColumn("leaf", leaf).filter(F.col("leaf").isNotNull()), order)
    out = [[] for _ in forest]
    for r in rows.collect():
        out[r["_fold"]].append((order[r["_fold"]][r["leaf"]], r))
    return out


def tree_regress_grid(df: DataFrame, features: list, target: str, grid: dict, key: str, folds: int, edges: bool = True, **options) -> GridScores:
    """R2 on the held rows for all combinations of max_depth, min_samples and min_impurity (None: no depth limit).

    The row's fold is ``key`` mod ``folds``; a null key trains every fold and is never held out.
    """
    names, combinations = _combinations(grid, LIMITS)
    data = prepare(df, features, [_fold(key, folds, features)], {"n": F.lit(1.0)}, target=target, **options)
    forest = _forest(data, features, ["n", "s", "q"], Variance, folds, _loosest(combinations), edges)

    def of_leaf(rows, order):
        means = F.coalesce(*[F.when(F.col("_fold") == t, F.get(literal_array([forest[t][i].mean for i in ids]), F.col("leaf").cast("int")))
                             for t, ids in enumerate(order)])
        return centred(rows, means).groupBy("_fold", "leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))

    scores = {}
    for t, leaves in enumerate(_held(data, features, forest, of_leaf)):
        nodes = forest[t]
        # Per leaf: rows, their mean and their squared deviations from it.
        parts = [(i, r["n"], nodes[i].mean + r["s"] / r["n"], max(r["q"] - r["s"] ** 2 / r["n"], 0.0)) for i, r in leaves]
        n = sum(p[1] for p in parts)
        mean = sum(p[1] * p[2] for p in parts) / n if n else 0.0
        spread = sum(d + k * (m - mean) ** 2 for _, k, m, d in parts)
        for c, params in enumerate(combinations):
            error = sum(d + k * (m - nodes[_end(nodes, i, params)].mean) ** 2 for i, k, m, d in parts)
            scores[c, t] = 1.0 - error / spread if spread > 0 else None
    data.release()
    return GridScores(names, [(p, t, scores[c, t]) for c, p in enumerate(combinations) for t in range(folds)])


def tree_classify_grid(df: DataFrame, features: list, label: str, grid: dict, key: str, folds: int, edges: bool = True, **options) -> GridScores:
    """Share of held rows with their own label, as ``tree_regress_grid``; the grid may also name criterion (gini, entropy).

    Each criterion grows its own trees.
    """
    names, combinations = _combinations(grid, [*LIMITS, "criterion"])
    classes = distinct_labels(df, label)
    counts = [f"k{i}" for i in range(len(classes))]
    stats = {k: F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0) for k, c in zip(counts, classes)}
    data = prepare(df, features, [_fold(key, folds, features)], stats, **options)
    scores = {}
    for kind in dict.fromkeys(p.get("criterion", "gini") for p in combinations):
        chosen = [(c, {k: v for k, v in p.items() if k != "criterion"}) for c, p in enumerate(combinations) if p.get("criterion", "gini") == kind]
        forest = _forest(data, features, counts, ClassCounts(kind, len(classes)), folds, _loosest([p for _, p in chosen]), edges)
        held = _held(data, features, forest, lambda rows, _: rows.groupBy("_fold", "leaf").agg(*[F.sum(k).alias(k) for k in counts]))
        for t, leaves in enumerate(held):
            nodes, n = forest[t], sum(r[k] for _, r in leaves for k in counts)
            for c, params in chosen:
                right = 0.0
                for i, r in leaves:
                    node = nodes[_end(nodes, i, params)]
                    right += r[counts[_top([node.stats[k] for k in counts])]]
                scores[c, t] = right / n if n else None
    data.release()
    return GridScores(names, [(p, t, scores[c, t]) for c, p in enumerate(combinations) for t in range(folds)])


def stump_grid(df: DataFrame, features: list, target: str, n_estimators: list, key: str, folds: int,
               checkpoint_every: int = CHECKPOINT_EVERY, **options) -> GridScores:
    """R2 on the held rows of boosted stumps after each of these numbers of rounds; one job a round for all folds.

    A fold that no split improves any more keeps its last score.
    """
    names, combinations = _combinations({"n_estimators": n_estimators}, ["n_estimators"])
    if min(n_estimators) < 1:
        raise ValueError("n_estimators must be at least 1")
    data = prepare(df, features, [_fold(key, folds, features)], {"n": F.lit(1.0)}, target=target, **options)
    sizes = {r["_fold"]: r for r in data.table.groupBy("_fold").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m")).collect()}
    start = []
    for t in range(folds):
        rest = [r for f, r in sizes.items() if f != t]
        if not rest:
            raise ValueError("no rows to learn from in some fold")
        start.append(sum(r["n"] * r["m"] for r in rest) / sum(r["n"] for r in rest))
    table, scores = data.table, [F.lit(float(m)) for m in start]
    stumps, going = [[] for _ in range(folds)], list(range(folds))
    for done in range(1, max(n_estimators) + 1):
        trained = F.array_compact(F.array(*[
            F.when(_trains(t), F.struct(F.lit(t).alias("node"), (F.col("m") - scores[t]).alias("m"))) for t in going]))
        rows = table.withColumn("_r", F.explode(trained)).select(*features, "n", "w", "_r.node", "_r.m")
        found = best_splits(centred(rows, F.lit(0.0)), features, Variance, ["n", "s", "q"], data.cuts).collect()
        going = sorted(r["node"] for r in found)
        for r in found:
            stump = Stump(r["feature"], r["point"], r["c_s"] / r["c_n"], (r["t_s"] - r["c_s"]) / (r["t_n"] - r["c_n"]))
            stumps[r["node"]].append(stump)
            scores[r["node"]] = scores[r["node"]] + stump_column(features, stump)
        if not going:
            break
        if done % checkpoint_every == 0:
            table = checkpointed(table.select(*data.table.columns, *[s.alias(f"_score{t}") for t, s in enumerate(scores)]))
            scores = [F.col(f"_score{t}") for t in range(folds)]
    stages = [running_sums([F.lit(float(m)), *[stump_column(features, s) for s in stumps[t]]]) for t, m in enumerate(start)]
    mine = F.coalesce(*[F.when(F.col("_fold") == t, s) for t, s in enumerate(stages)])
    mean = F.coalesce(*[F.when(F.col("_fold") == t, F.lit(float(sizes[t]["m"]))) for t in range(folds) if t in sizes], F.lit(0.0))
    off, away = F.col("m") - F.col("staged"), F.col("m") - mean
    # A stage's errors are summed before the shuffle: one partial row per fold, round and task.
    sums = (
        data.table.select("_fold", "n", "m", "w", F.posexplode(mine).alias("stage", "staged")).groupBy("_fold", "stage")
        .agg(F.sum(F.col("w") + F.col("n") * off * off).alias("error"), F.sum(F.col("w") + F.col("n") * away * away).alias("spread")))
    found = {(r["_fold"], r["stage"]): r for r in sums.collect()}
    data.release()

    def score(rounds, t):
        r = found.get((t, min(rounds, len(stumps[t]))))
        return 1.0 - r["error"] / r["spread"] if r is not None and r["spread"] > 0 else None

    return GridScores(names, [(p, t, score(p["n_estimators"], t)) for p in combinations for t in range(folds)])
