"""Classification and regression trees grown one level per job, and their pruning.

The model is a dictionary of nodes under heap numbers (children of n are 2n
and 2n + 1) of any size; in tables the nodes of a tree too deep for 63 bits are
numbered in that order instead. Nothing about a row is stored between levels:
its node is a function of the features and the splits found so far.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulearn.functions.columns import distinct_labels, label_array, literal_array, required
from tabulearn.operators.prep import split_by_key
from tabulearn.operators.splits import ClassCounts, Variance, best_splits, centred, prepare

INLINE_NODES = 64
HELD_NODES = 4096  # of a tree in the driver; one that may get more has its nodes in a table
# A child's loss below this share of its sum of squares around its parent's mean is taken again around its own.
CANCELLED = 1e-6


@dataclass
class Node:
    id: int
    stats: dict
    loss: float
    size: float
    feature: int = None
    point: float = None
    mean: float = None

    @property
    def is_leaf(self):
        return self.feature is None


def descend(features: list, nodes: dict, values: dict, kind: str = "double") -> Column:
    """The value of the node a row ends in; a node without a value gives null.

    Small trees become nested CASE WHEN. Larger ones walk arrays of splits,
    so the expression does not grow with the tree.
    """
    if len(nodes) <= INLINE_NODES:
        def inline(i):
            node = nodes[i]
            if node.is_leaf:
                return F.lit(values.get(i)).cast(kind)
            return F.when(F.col(features[node.feature]) <= F.lit(node.point), inline(2 * i)).otherwise(inline(2 * i + 1))

        return inline(1)
    order = sorted(nodes)
    at = {n: i for i, n in enumerate(order)}
    depth = max(n.bit_length() for n in order) - 1
    split_feature = literal_array([-1 if nodes[n].is_leaf else nodes[n].feature for n in order], "int")
    split_at = literal_array([0.0 if nodes[n].is_leaf else nodes[n].point for n in order])
    left = literal_array([0 if nodes[n].is_leaf else at[2 * n] for n in order], "int")
    xs = F.array(*[F.col(f).cast("double") for f in features])

    def step(i, _):
        feature = F.get(split_feature, i)
        child = F.when(F.get(xs, feature) <= F.get(split_at, i), F.get(left, i)).otherwise(F.get(left, i) + 1)
        return F.when(feature < 0, i).otherwise(child)

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)
    element = "double" if kind == "double" else "bigint"
    blank = F.get(literal_array([0 if values.get(n) is None else 1 for n in order], "int"), leaf)
    value = F.get(literal_array([values.get(n) or 0 for n in order], element), leaf)
    return F.when(blank == 1, value.cast(kind))


@dataclass
class Tree:
    features: list
    nodes: dict
    values: dict
    classes: list = None
    shift: float = 0.0

    def leaves(self):
        return [n for n in self.nodes.values() if n.is_leaf]

    def numbers(self) -> dict:
        """Node numbers that fit a long: the heap numbers, or the place in their order."""
        order = sorted(self.nodes)
        return {i: i for i in order} if order[-1] < 2**63 else {i: k + 1 for k, i in enumerate(order)}

    def node_column(self) -> Column:
        number = self.numbers()
        return descend(self.features, self.nodes, {n.id: number[n.id] for n in self.leaves()}, "long")

    def value_column(self) -> Column:
        return descend(self.features, self.nodes, {n.id: self.values[n.id] for n in self.leaves()})

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Mean of the leaf, or the label with most rows in it (first class on ties)."""
        if self.classes is None:
            return df.withColumn(out, self.value_column())
        best = {n.id: _top(self.values[n.id]) for n in self.leaves()}
        return df.withColumn(out, F.get(label_array(self.classes), descend(self.features, self.nodes, best, "int")))

    def value_of(self, node_id):
        v = self.values[node_id]
        return float(v) if self.classes is None else float(max(v))

    def label_of(self, node_id):
        return None if self.classes is None else str(self.classes[_top(self.values[node_id])])

    def table(self, spark) -> DataFrame:
        """One row per node, breadth first."""
        return self._rows(spark).drop("below")

    def _rows(self, spark) -> DataFrame:
        number = self.numbers()
        rows = [(number[n.id], number.get(n.id // 2), None if n.is_leaf else self.features[n.feature], n.point,
                 n.loss / n.size, int(round(n.size)), self.value_of(n.id), self.label_of(n.id),
                 n.id % 2 == 0)
                for n in sorted(self.nodes.values(), key=lambda n: n.id)]
        return spark.createDataFrame(
            rows, "node_id long, parent_id long, feature string, split_point double, impurity double,"
                  " samples long, value double, label string, below boolean")

    def edges(self, spark) -> DataFrame:
        """Each node with its rule and the branch that leads to it."""
        nodes = self._rows(spark)
        rule = F.when(F.col("p.feature").isNotNull(),
                      F.concat(F.col("p.feature"), F.when(F.col("c.below"), F.lit(" <= ")).otherwise(F.lit(" > "))))
        return (
            nodes.alias("c").join(nodes.alias("p"), F.col("c.parent_id") == F.col("p.node_id"), "left")
            .select("c.node_id", "c.parent_id", F.col("c.below").alias("branch_true"), rule.alias("rule"),
                    F.col("p.split_point").alias("rule_point"), "c.impurity", "c.samples", "c.value", "c.label"))


def _top(counts):
    return max(range(len(counts)), key=lambda i: (counts[i], -i))


def grow(table: DataFrame, features: list, sums: list, criterion, root: dict, cuts: dict = None,
         max_depth: int = None, min_samples: float = 2, min_impurity: float = 0.0, edges: bool = False) -> dict:
    """Grow all open nodes of a level with one job; returns the nodes by heap number.

    A node stays a leaf when it has under ``min_samples`` rows, its impurity is
    at most ``min_impurity``, it is at ``max_depth``, or no split improves it.
    For least squares the table has n, m, w and the level's sums are taken
    around each node's own mean; nodes whose loss that leaves uncertain get it
    from one more job, and those of equal targets are known by minimum and maximum.
    """
    nodes = {1: _node(1, root, criterion)}
    if criterion is Variance:
        nodes[1].mean = root["m"]

    def rows_at(places):
        return table.withColumn("node", descend(features, nodes, places[0], "long")).filter(F.col("node").isNotNull())

    grow_forest([nodes], rows_at, features, sums, criterion, cuts, max_depth, min_samples, min_impurity, edges)
    return nodes


def grow_forest(forest: list, rows_at, features: list, sums: list, criterion, cuts: dict = None, max_depth: int = None,
                min_samples: float = 2, min_impurity: float = 0.0, edges: bool = False) -> None:
    """Grow several trees from their roots, one level of all of them with one job.

    ``rows_at({tree: {heap number: place}})`` gives the training rows in these
    nodes with ``node``, the node's place; a row may stand in nodes of several trees.
    """
    squares = criterion is Variance
    level, depth = [(t, 1) for t in range(len(forest))], 0
    if squares:
        _measure(rows_at, forest, level)
    while max_depth is None or depth < max_depth:
        open_ids = [(t, i) for t, i in level if forest[t][i].size >= min_samples and _impure(forest[t][i], min_impurity)]
        if not open_ids:
            break
        rows = _in_nodes(rows_at, forest, open_ids, squares)
        level, unsure = [], []
        for r in best_splits(rows, features, criterion, sums, cuts, edges).collect():
            t, i = open_ids[r["node"]]
            nodes, node = forest[t], forest[t][i]
            node.feature, node.point = r["feature"], r["point"]
            left = {s: r[f"c_{s}"] for s in sums}
            right = {s: r[f"t_{s}"] - r[f"c_{s}"] for s in sums}
            for child, stats in ((2 * i, left), (2 * i + 1, right)):
                nodes[child] = _node(child, stats, criterion)
                level.append((t, child))
                if squares:
                    nodes[child].mean = node.mean + stats["s"] / stats["n"]
                    if nodes[child].loss <= CANCELLED * stats["q"]:
                        unsure.append((t, child))
        if unsure:
            _measure(rows_at, forest, sorted(unsure))
        level.sort()
        depth += 1


def _in_nodes(rows_at, forest, ids, squares):
    """The rows of these nodes with ``node``, the node's place in the list."""
    places = {}
    for k, (t, i) in enumerate(ids):
        places.setdefault(t, {})[i] = k
    rows = rows_at(places)
    return centred(rows, F.get(literal_array([forest[t][i].mean for t, i in ids]), F.col("node").cast("int"))) if squares else rows


def _measure(rows_at, forest, ids):
    """Mean and loss of these nodes from their rows; exactly zero if all targets are equal."""
    found = _in_nodes(rows_at, forest, ids, True).groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.min("m").alias("low"), F.max("m").alias("high"), F.max("w").alias("w"))
    for r in found.collect():
        t, i = ids[r["node"]]
        node = forest[t][i]
        if r["low"] == r["high"] and r["w"] == 0:
            node.mean, node.loss = r["low"], 0.0
        else:
            node.loss, node.mean = max(r["q"] - r["s"] ** 2 / r["n"], 0.0), node.mean + r["s"] / r["n"]


def _node(i, stats, criterion):
    return Node(i, stats, criterion.number(stats), criterion.size(stats))


def _impure(node, min_impurity):
    return node.loss > 0 and node.loss / node.size > min_impurity


def prepare_regression(df: DataFrame, features: list, target: str, **options):
    """Training table with n, m and w of the target, whose totals hold the start of a root node; returns (training, mean)."""
    data = prepare(df, features, [], {"n": F.lit(1.0)}, target=target, **options)
    data.totals |= {"s": 0.0, "q": 0.0}
    return data, data.totals["m"]


def _may_hold(data, max_depth: int, held: int) -> bool:
    """Whether the tree has at most ``held`` nodes, by its depth or the number of distinct feature vectors."""
    return held is None or 2 * data.distinct <= held or max_depth is not None and max_depth < held.bit_length() - 1


def tree_regress_fit(df: DataFrame, features: list, target: str, max_depth: int = None, min_samples: int = 2,
                     edges: bool = True, held: int = HELD_NODES, **options):
    """Least-squares tree; without ``max_depth`` it grows until its leaves are pure or cannot be improved.

    A ``Tree``, or a ``NodeTree`` if it may get more than ``held`` nodes; None: always a ``Tree``.
    """
    data, mean = prepare_regression(df, features, target, **options)
    if _may_hold(data, max_depth, held):
        nodes = grow(data.table, features, ["n", "s", "q"], Variance, data.totals, data.cuts, max_depth, min_samples, edges=edges)
        tree = Tree(list(features), nodes, {i: n.mean for i, n in nodes.items()}, shift=mean)
    else:
        from tabulearn.operators import node_tables

        rule = node_tables.Rule(list(features), Variance, ["n", "s", "q"], max_depth=max_depth, min_samples=min_samples, edges=edges)
        tree = node_tables.grow_tables(data.table, rule, mean, data.cuts)
    data.release()
    return tree


def tree_classify_fit(df: DataFrame, features: list, label: str, criterion: str = "gini", min_samples: int = 2,
                      min_impurity: float = 0.0, max_depth: int = None, edges: bool = True, held: int = HELD_NODES, **options):
    """Gini or entropy tree; leaf values are the class counts. A ``NodeTree``, which keeps the label, beyond ``held`` nodes."""
    classes = distinct_labels(df, label)
    rule = ClassCounts(criterion, len(classes))
    stats = {k: F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0) for k, c in zip(rule.names, classes)}
    data = prepare(df, features, [], stats, **options)
    if _may_hold(data, max_depth, held):
        nodes = grow(data.table, features, data.sums, rule, data.totals, data.cuts, max_depth, min_samples, min_impurity, edges)
        tree = Tree(list(features), nodes, {i: [n.stats[k] for k in rule.names] for i, n in nodes.items()}, classes)
    else:
        from tabulearn.operators import node_tables

        tables = node_tables.Rule(list(features), rule, rule.names, len(classes), False, max_depth, min_samples, min_impurity, edges)
        tree = node_tables.grow_tables(data.table, tables, 0.0, data.cuts)
        tree.classes = classes
    data.release()
    return tree


def prune_sequence(tree: Tree) -> list:
    """Weakest-link sequence: [(alpha, subtree)], the whole tree first, the root alone last.

    Each step cuts the inner node with the smallest (C(t) - C(T_t)) / (leaves - 1),
    recomputed after every cut; the lowest node number wins a tie.
    """
    steps = [(0.0, tree)]
    nodes = tree.nodes
    while not nodes[1].is_leaf:
        below = {}
        for i in sorted(nodes, reverse=True):
            n = nodes[i]
            if n.is_leaf:
                below[i] = (n.loss, 1)
            else:
                below[i] = tuple(a + b for a, b in zip(below[2 * i], below[2 * i + 1]))
        links = [((n.loss - below[i][0]) / (below[i][1] - 1), i) for i, n in nodes.items() if not n.is_leaf]
        lowest = min(g for g, _ in links)
        cut = min(i for g, i in links if g <= lowest * (1 + 1e-9))
        nodes = _cut(nodes, cut)
        steps.append((lowest, Tree(tree.features, nodes, tree.values, tree.classes, tree.shift)))
    return steps


def _cut(nodes, at):
    kept = {}
    for i, n in nodes.items():
        above = i
        while above > at:
            above //= 2
        if i == at:
            kept[i] = Node(n.id, n.stats, n.loss, n.size, mean=n.mean)
        elif above != at:
            kept[i] = n
    return kept


def sequence_table(spark, steps: list) -> DataFrame:
    rows = [(k, float(a), len(t.leaves()), float(sum(n.loss for n in t.leaves()))) for k, (a, t) in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, alpha double, leaves int, cost double")


def select_subtree(steps: list, validation: DataFrame, target: str):
    """(scores, best tree): R2 of every subtree on the validation rows, from one job.

    The rows are summed per leaf of the whole tree; every subtree's error
    follows from those sums.
    """
    whole = steps[0][1]
    shift = whole.shift
    y = F.col(target).cast("double") - F.lit(shift)
    rows = (
        validation.select(whole.node_column().alias("leaf"), y.alias("y"))
        .groupBy("leaf").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
        .collect())
    n = sum(r["n"] for r in rows)
    if not n:
        raise ValueError("no validation rows")
    spread = sum(r["q"] for r in rows) - sum(r["s"] for r in rows) ** 2 / n
    scores, heap = [], {k: i for i, k in whole.numbers().items()}
    for k, (alpha, tree) in enumerate(steps):
        error = 0.0
        for r in rows:
            leaf = heap[r["leaf"]]
            while leaf not in tree.nodes:
                leaf //= 2
            v = tree.values[leaf] - shift
            error += r["q"] - 2 * v * r["s"] + r["n"] * v * v
        scores.append((k, alpha, 1.0 - error / spread if spread > 0 else None))
    best = max(scores, key=lambda s: (round(s[2], 12) if s[2] is not None else 0.0, s[1], s[0]))
    return scores, steps[best[0]][1]


def tree_fit_pruned(df: DataFrame, features: list, target: str, key: str, parts: int = 10, **options) -> Tree:
    """Grow on the training share, prune, keep the subtree best on the held share."""
    train, held = split_by_key(df, key, parts)
    _, best = select_subtree(prune_sequence(tree_regress_fit(train, features, target, **{"held": None} | options)), held, target)
    return best
