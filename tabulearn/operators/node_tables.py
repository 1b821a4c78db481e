"""Trees whose nodes are a table: fully grown trees without a node in the driver.

The node is a column of the training rows, written out per level. Nodes with more than ``small_rows`` training rows are
split level by level, all at once: the best split of each is a row that the training rows join by node number. A node
that has become small is finished inside one task, by the same rules, and is one row of the model that holds its whole
subtree in arrays; splits that cut off a few rows at a time, as noise brings them, then cost no level of jobs. A prediction joins the rows to the levels of large nodes and then, once, to their subtree.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.columns import distinct_labels, label_array, plus_minus
from tabulearn.functions.tables import keyed_join
from tabulearn.operators.boosting import negative_gradient
from tabulearn.operators.splits import IMPROVES, TIE_DIGITS, ClassCounts, Variance, best_splits, centred, prepare
from tabulearn.operators.trees import prepare_regression
from tabulearn.session import checkpointed

SMALL_ROWS = 1 << 20  # of some numbers each, so some tens of megabytes in a task
CELLS = 1 << 18  # rows of small nodes that are looked at together
WALKED = 200_000  # rows that meet a subtree at once
SUBTREE = "node long, feature array<int>, point array<double>, left array<int>, value array<double>, size array<double>, loss array<double>"


@dataclass
class Rule:
    """What is summed and when a node stays a leaf; ``classes`` is None for least squares, ``h`` if leaves take Newton steps."""

    features: list
    criterion: object
    sums: list
    classes: int = None
    newton: bool = False
    max_depth: int = None
    min_samples: float = 2
    min_impurity: float = 0.0
    edges: bool = True
    small_rows: int = SMALL_ROWS


def losses(rule: Rule, sums: np.ndarray) -> np.ndarray:
    """Loss of each row of sums: (n, s, q) or counts per class."""
    if rule.classes is None:
        n, s, q = sums.T
        return np.maximum(q - np.divide(s * s, n, out=np.zeros_like(s), where=n > 0), 0.0)
    n = sums.sum(axis=1, keepdims=True)
    share = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
    if rule.criterion.kind == "gini":
        return n[:, 0] * (1.0 - (share**2).sum(axis=1)) * (n[:, 0] > 0)
    return np.maximum(-(share * np.log2(share + 1e-9)).sum(axis=1), 0.0) * n[:, 0]


def best_of_nodes(rule: Rule, x: np.ndarray, orders: list, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray, whole: np.ndarray):
    """(feature, point) of the best split of each node, feature -1 if none improves it. Ties as in ``best_splits``.

    A node's rows stand from its start on in each of ``orders``, in the order of that feature. Nodes of about the same
    size are laid out as the rows of a matrix, so that running sums never pass from one node into the next.
    """
    feature, point = np.full(len(starts), -1, np.int32), np.zeros(len(starts))
    widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
    for width in np.unique(widths):
        alike = np.flatnonzero(widths == width)
        for nodes in np.array_split(alike, min(len(alike), -(-len(alike) * int(width) // CELLS))):
            at = np.arange(max(sizes[nodes].max(), 2))
            held = at < sizes[nodes, None]
            places = np.where(held, starts[nodes, None] + at, starts[nodes, None])
            best, me = np.full(len(nodes), -np.inf), np.arange(len(nodes))
            for j, order in enumerate(orders):
                rows = order[places]
                v = x[rows, j]
                gap = (v[:, 1:] != v[:, :-1]) & held[:, 1:]
                sides = np.where(held[..., None], sums[rows], 0.0).cumsum(axis=1)
                total = sides[:, -1:].copy()
                left = sides[:, :-1][gap]
                of = np.nonzero(gap)[0]
                share = np.full(gap.shape, -np.inf)
                share[gap] = 1.0 - (losses(rule, left) + losses(rule, total[of, 0] - left)) / whole[nodes][of]
                gain = np.where(share > IMPROVES, np.round(share, TIE_DIGITS), -np.inf)
                i = gain.argmax(axis=1)
                won = np.flatnonzero(gain[me, i] > best)
                i, first = i[won], gap[won].argmax(axis=1)
                low, high = v[won, i], v[won, i + 1]
                best[won], feature[nodes[won]] = gain[won, i], j
                point[nodes[won]] = np.where(first == i, low, (low + high) / 2.0) if rule.edges else (low + high) / 2.0
    return feature, point


def grow_rows(rule: Rule, x: np.ndarray, stats: dict, depth: int) -> dict:
    """The subtree over some rows as lists, breadth first; children stand side by side, ``left`` of a leaf is -1.

    All nodes of a level are split together.
    """
    out = {k: [] for k in ("feature", "point", "left", "value", "size", "loss")}
    orders = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
    counts = None if rule.classes is None else np.column_stack([stats[k] for k in rule.sums])
    starts, sizes, seen = np.zeros(1, np.int64), np.array([len(x)]), 0
    around = np.zeros((len(x), 3))
    while len(starts):
        rows = orders[0]
        if rule.classes is None:
            n, m, w = (stats[k][rows] for k in ("n", "m", "w"))
            mean = np.add.reduceat(n * m, starts) / np.add.reduceat(n, starts)
            off = m - np.repeat(mean, sizes)
            around[rows, 0], around[rows, 1], around[rows, 2] = n, n * off, w + n * off * off
            sums = around
            pure = (np.minimum.reduceat(m, starts) == np.maximum.reduceat(m, starts)) & (np.maximum.reduceat(w, starts) == 0)
            total = np.add.reduceat(sums[rows], starts, axis=0)
            size = total[:, 0]
            value = np.add.reduceat(n * m, starts) / (np.add.reduceat(stats["h"][rows], starts) + 1e-9) if rule.newton else np.where(pure, m[starts], mean)
        else:
            sums = counts
            total = np.add.reduceat(sums[rows], starts, axis=0)
            size, value, pure = total.sum(axis=1), total.argmax(axis=1).astype(float), (total > 0).sum(axis=1) <= 1
        loss = np.where(pure, 0.0, losses(rule, total))
        feature, point = np.full(len(starts), -1, np.int32), np.zeros(len(starts))
        if rule.max_depth is None or depth < rule.max_depth:
            can = np.flatnonzero((loss > 0) & (loss / size > rule.min_impurity) & (size >= rule.min_samples))
            feature[can], point[can] = best_of_nodes(rule, x, orders, sums, starts[can], sizes[can], loss[can])
        split = feature >= 0
        seen += len(starts)
        left = np.where(split, seen + 2 * (np.cumsum(split) - 1), -1)
        for k, v in (("feature", feature), ("point", point), ("left", left), ("value", value), ("size", size), ("loss", loss)):
            out[k].append(v)
        # Rows of split nodes move to their child, in the same order within it.
        inner = np.repeat(split, sizes)
        node = np.repeat(np.cumsum(split) - 1, sizes)[inner]
        rows, feature, point = rows[inner], feature[split], point[split]
        below = np.zeros(len(x), bool)
        below[rows] = x[rows, feature[node]] <= point[node]
        whole = sizes[split]
        begin = np.cumsum(whole) - whole
        lower = np.add.reduceat(below[rows].astype(np.int64), begin) if len(begin) else begin
        starts, sizes = np.column_stack([begin, begin + lower]).ravel(), np.column_stack([lower, whole - lower]).ravel()
        for j, order in enumerate(orders):
            order = order[inner]
            under = below[order]
            ahead = np.cumsum(under) - under  # rows below before this one, in all nodes
            ahead -= ahead[begin][node]
            place = np.arange(len(order)) - begin[node]
            moved = np.empty_like(order)
            moved[begin[node] + np.where(under, ahead, lower[node] + place - ahead)] = order
            orders[j] = moved
        depth += 1
    return {k: np.concatenate(v) for k, v in out.items()}


def root() -> Column:
    """The number 1, in a form the optimizer doesn't see through: a join on a constant would lose its key."""
    return (F.monotonically_increasing_id() >= 0).cast("long")


@dataclass
class NodeTree:
    """``levels``: per level of large nodes a table (node, feature, point, left); ``ends``: subtrees by the node they start at."""

    features: list
    levels: list
    ends: DataFrame
    classes: list = None

    def leaf(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the value of the leaf each row ends in; null where a feature is null."""
        rows = df.withColumns({"_node": root(), "_xs": F.array(*[F.col(f).cast("double") for f in self.features]), "_turn": F.monotonically_increasing_id()})
        for level in self.levels:
            names = level.select(F.col("node").alias("_node"), F.col("feature").alias("_f"), F.col("point").alias("_p"), F.col("left").alias("_l"))
            rows = keyed_join(rows, names, "_node", F.col("_turn"), "left")
            over = (F.get("_xs", F.col("_f")) > F.col("_p")).cast("long")
            rows = rows.withColumn("_node", F.when(F.col("_f").isNull(), F.col("_node")).otherwise(F.col("_l") + F.coalesce(over, F.lit(0)))).drop("_f", "_p", "_l")
        rows = checkpointed(rows) if self.levels else rows
        # Rows meet their subtree in groups of bounded size, however many end in one subtree.
        spread = rows.groupBy("_node").agg(F.ceil(F.count("*") / WALKED).cast("long").alias("_spread"))
        spread = checkpointed(spread)
        rows = keyed_join(rows, spread, "_node", F.col("_turn")).withColumn("_part", F.pmod(F.xxhash64("_turn"), F.col("_spread"))).drop("_spread", "_turn")
        ends = self.ends.select(F.col("node").alias("_node"), "feature", "point", "left", "value").join(spread, "_node")
        ends = ends.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_spread") - 1))).drop("_spread")

        def walk(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                end = pa.nulls(left.num_rows, pa.float64())
            else:
                tree = {k: np.asarray(right.column(k).combine_chunks().flatten()) for k in ("feature", "point", "left", "value")}
                xs = left.column("_xs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(left.num_rows, -1)
                at, going = np.zeros(len(xs), np.int64), np.arange(len(xs))
                while len(going):
                    here = at[going]
                    inner = tree["left"][here] >= 0
                    going, here = going[inner], here[inner]
                    at[going] = tree["left"][here] + (xs[going, tree["feature"][here]] > tree["point"][here])
                end = pa.array(tree["value"][at], mask=np.isnan(xs).any(axis=1))
            return left.drop_columns(["_node", "_xs", "_part"]).append_column(out, end)

        return rows.groupBy("_node", "_part").cogroup(ends.groupBy("_node", "_part")).applyInArrow(walk, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.classes is None:
            return self.leaf(df, out)
        return self.leaf(df, "_c").withColumn(out, F.get(label_array(self.classes), F.col("_c").cast("int"))).drop("_c")

    def table(self) -> DataFrame:
        """(node, place, parent_node, parent_place, feature, split_point, impurity, samples, value), one row per node of the tree.

        Large nodes have place 0 and their own number; inside a subtree a node is known by the subtree's number and its place.
        """
        names = F.array(*[F.lit(f) for f in self.features])
        flat = self.ends.select("node", F.posexplode(F.arrays_zip("feature", "point", "left", "value", "size", "loss")).alias("place", "r"), "left")
        parent = F.array_position(F.col("left"), F.when(F.col("place") % 2 == 1, F.col("place")).otherwise(F.col("place") - 1)).cast("int") - 1
        out = flat.select("node", "place", F.when(F.col("place") > 0, F.col("node")).alias("parent_node"), F.when(F.col("place") > 0, parent).alias("parent_place"),
                          F.get(names, F.col("r.feature")).alias("feature"), F.when(F.col("r.left") >= 0, F.col("r.point")).alias("split_point"),
                          (F.col("r.loss") / F.col("r.size")).alias("impurity"), F.col("r.size").alias("samples"), F.col("r.value").alias("value"))
        up = None
        for level in self.levels:
            nodes = level.select("node", F.lit(0).alias("place"), F.lit(None).cast("long").alias("parent_node"), F.lit(None).cast("int").alias("parent_place"),
                                 F.get(names, F.col("feature")).alias("feature"), F.col("point").alias("split_point"), "impurity", "samples", "value")
            out = out.unionByName(nodes)
            kids = level.select(F.explode(F.array("left", F.col("left") + 1)).alias("node"), F.lit(0).alias("place"), F.col("node").alias("above"))
            up = kids if up is None else up.unionByName(kids)
        if up is None:
            return out
        joined = out.join(up, ["node", "place"], "left")
        return joined.withColumns({"parent_node": F.coalesce("parent_node", "above"), "parent_place": F.coalesce("parent_place", F.when(F.col("above").isNotNull(), F.lit(0)))}).drop("above")


def measured(rows: DataFrame, rule: Rule) -> DataFrame:
    """(node, rows, n, mean or value, loss, pure..) of every node present, around the mean its rows carry."""
    if rule.classes is None:
        around = centred(rows, F.col("mean"))
        sums = around.groupBy("node").agg(
            F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.first("mean").alias("mean"),
            F.min("m").alias("low"), F.max("m").alias("high"), F.max("w").alias("w"), (F.sum("h") if rule.newton else F.lit(0.0)).alias("h"))
        pure = (F.col("low") == F.col("high")) & (F.col("w") == 0)
        mean = F.when(pure, F.col("low")).otherwise(F.col("mean") + F.col("s") / F.col("n"))
        loss = F.when(pure, F.lit(0.0)).otherwise(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)))
        value = (F.col("mean") * F.col("n") + F.col("s")) / (F.col("h") + 1e-9) if rule.newton else mean
        return sums.select("node", "rows", F.col("n").alias("samples"), mean.alias("centre"), value.alias("value"), loss.alias("loss"))
    sums = rows.groupBy("node").agg(F.count("*").alias("rows"), *[F.sum(k).alias(k) for k in rule.sums])
    counts = F.array(*rule.sums)
    samples = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    loss = F.when(F.size(F.filter(counts, lambda v: v > 0)) <= 1, F.lit(0.0)).otherwise(rule.criterion.loss(F.col))
    return sums.select("node", "rows", samples.alias("samples"), F.lit(0.0).alias("centre"),
                       (F.array_position(counts, F.array_max(counts)) - 1).cast("double").alias("value"), loss.alias("loss"))


def numbered(df: DataFrame, column: str, start: int) -> tuple[DataFrame, int]:
    """Adds ``left``: start + 2 * the row's place in the order of ``column``; only counts per range reach the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("_row", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_row", 33).alias("part")).count().orderBy("part").collect()
    first, before = [], 0
    for r in counts:
        first += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if not before:
        return placed.withColumn("left", F.lit(0).cast("long")).drop("_row"), 0
    place = F.create_map(*first)[F.shiftright("_row", 33)] + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("left", (F.lit(start) + 2 * place).cast("long")).drop("_row"), before


def grow_tables(rows: DataFrame, rule: Rule, start: float, cuts: dict) -> NodeTree:
    """``rows`` has the features and n, m, w (and h), or counts per class. Each level is written out."""
    features = rule.features
    stats = (["n", "m", "w"] + (["h"] if rule.newton else [])) if rule.classes is None else rule.sums
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], *stats, root().alias("node"), F.lit(float(start)).alias("mean"))
    levels, ends, depth, next_node = [], None, 0, 2

    def finish(part: DataFrame, depth: int) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            tree = grow_rows(rule, group[features].to_numpy(), {k: group[k].to_numpy() for k in stats}, depth)
            return pd.DataFrame({"node": [group["node"].iat[0]], **{k: [v] for k, v in tree.items()}})

        return part.groupBy("node").applyInPandas(run, SUBTREE)

    while True:
        nodes = checkpointed(measured(rows, rule))
        here = nodes.select("node", (F.col("rows") > rule.small_rows).alias("large"), F.col("centre").alias("_centre"))
        counts = nodes.agg(F.count("*").alias("all"), F.sum((F.col("rows") > rule.small_rows).cast("int")).alias("large")).first()
        if not counts["large"]:
            small, rows = rows, None
        else:
            rows = keyed_join(rows, here, "node", F.xxhash64(*features, *stats)).withColumn("mean", F.col("_centre")).drop("_centre")
            rows = checkpointed(rows)
            small, rows = rows.where("not large"), rows.where("large").drop("large")
        ended = finish(small, depth)
        if rows is not None:
            open_nodes = nodes.where((F.col("rows") > rule.small_rows) & (F.col("loss") > 0) & (F.col("loss") / F.col("samples") > rule.min_impurity)
                                     & (F.col("samples") >= rule.min_samples) & F.lit(rule.max_depth is None or depth < rule.max_depth))
            table = centred(rows, F.col("mean")) if rule.classes is None else rows
            table = keyed_join(table, open_nodes.select("node"), "node", F.xxhash64(*features, *stats))
            found = best_splits(table, features, rule.criterion, rule.sums, cuts, rule.edges)
            found, n = numbered(found, "node", next_node)
            split = found.join(nodes.withColumnRenamed("loss", "own_loss"), "node")
            if rule.classes is None:
                split = split.withColumns({"mean_l": F.col("centre") + F.col("c_s") / F.col("c_n"), "mean_r": F.col("centre") + (F.col("t_s") - F.col("c_s")) / (F.col("t_n") - F.col("c_n"))})
            else:
                split = split.withColumns({"mean_l": F.lit(0.0), "mean_r": F.lit(0.0)})
            split = checkpointed(split.select("node", "feature", "point", "left", (F.col("own_loss") / F.col("samples")).alias("impurity"), "samples", "value", "mean_l", "mean_r"))
            # Large nodes without a split are leaves; they come from the nodes' own sums, never from their rows.
            alone = nodes.where(F.col("rows") > rule.small_rows).join(split.select("node"), "node", "left_anti")
            one = {"feature": F.lit(-1), "point": F.lit(0.0), "left": F.lit(-1), "value": F.col("value"), "size": F.col("samples"), "loss": F.col("loss")}
            ended = ended.unionByName(alone.select("node", *[F.array(c).alias(k) for k, c in one.items()]))
        ended = checkpointed(ended)
        ends = ended if ends is None else ends.unionByName(ended)
        if rows is None or not n:
            return NodeTree(features, levels, checkpointed(ends) if len(levels) > 1 else ends)
        levels.append(split.drop("mean_l", "mean_r"))
        moves = split.select("node", F.col("feature").alias("_f"), F.col("point").alias("_p"), F.col("left").alias("_l"), "mean_l", "mean_r")
        over = F.get(F.array(*features), F.col("_f")) > F.col("_p")
        rows = keyed_join(rows, moves, "node", F.xxhash64(*features, *stats))
        rows = rows.select(*features, *stats, (F.col("_l") + over.cast("long")).alias("node"), F.when(over, F.col("mean_r")).otherwise(F.col("mean_l")).alias("mean"))
        next_node += 2 * n
        depth += 1


def tree_table_fit(df: DataFrame, features: list, target: str, max_depth: int = None, min_samples: float = 2, edges: bool = True,
                   small_rows: int = SMALL_ROWS, **options) -> NodeTree:
    """Least-squares tree; without ``max_depth`` it grows until its leaves are pure or cannot be improved."""
    data, mean = prepare_regression(df, features, target, **options)
    rule = Rule(list(features), Variance, ["n", "s", "q"], max_depth=max_depth, min_samples=min_samples, edges=edges, small_rows=small_rows)
    tree = grow_tables(data.table, rule, mean, data.cuts)
    data.release()
    return tree


def tree_table_classify_fit(df: DataFrame, features: list, label: str, criterion: str = "gini", max_depth: int = None, min_samples: float = 2,
                            min_impurity: float = 0.0, edges: bool = True, small_rows: int = SMALL_ROWS, **options) -> NodeTree:
    """Gini or entropy tree; a leaf answers the label with most rows in it, the first class on ties."""
    classes = distinct_labels(df, label)
    count = ClassCounts(criterion, len(classes))
    stats = {k: F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0) for k, c in zip(count.names, classes)}
    data = prepare(df, features, [], stats, **options)
    rule = Rule(list(features), count, count.names, len(classes), False, max_depth, min_samples, min_impurity, edges, small_rows)
    tree = grow_tables(data.table, rule, 0.0, data.cuts)
    data.release()
    tree.classes = classes
    return tree


@dataclass
class NodeEnsemble:
    features: list
    trees: list
    start: float
    rate: float
    classes: list

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """start + rate * sum of the trees' leaves."""
        rows = df.withColumn(out, F.lit(float(self.start)))
        for t in self.trees:
            rows = t.leaf(rows, "_leaf").withColumn(out, F.col(out) + F.lit(self.rate) * F.col("_leaf")).drop("_leaf")
        return rows

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        low, high = self.classes
        return self.score(df, "_score").withColumn(out, F.when(F.col("_score") >= 0, F.lit(high)).otherwise(F.lit(low))).drop("_score")


def gbdt_table_fit(df: DataFrame, features: list, label: str, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = None,
                   edges: bool = False, small_rows: int = SMALL_ROWS, **options) -> NodeEnsemble:
    """Trees on the logistic gradient, at any depth; each leaf takes one Newton step. Starts from the mean of the -1/+1 labels.

    The score is a column of the training rows, written out every round.
    """
    classes = distinct_labels(df, label)
    data = prepare(df, features, [plus_minus(label, classes).alias("_y")], {"n": F.lit(1.0)}, **options)
    start = data.table.agg((F.sum(F.col("_y") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    rule = Rule(list(features), Variance, ["n", "s", "q"], newton=True, max_depth=max_depth, edges=edges, small_rows=small_rows)
    state, trees = data.table.withColumn("_score", F.lit(float(start))), []
    for i in range(n_estimators):
        r = negative_gradient(F.col("_y"), F.col("_score"))
        rows = state.select(*features, "n", r.alias("m")).select(
            *features, "n", "m", F.lit(0.0).alias("w"), (F.col("n") * F.abs("m") * (F.lit(1.0) - F.abs("m"))).alias("h"))
        tree = grow_tables(rows, rule, 0.0, data.cuts)
        trees.append(tree)
        if i + 1 < n_estimators:
            scored = tree.leaf(state, "_leaf").withColumn("_score", F.col("_score") + F.lit(learning_rate) * F.col("_leaf")).drop("_leaf")
            state = checkpointed(scored)
    data.release()
    return NodeEnsemble(list(features), trees, start, learning_rate, classes)


def subtree_costs(tree: NodeTree) -> DataFrame:
    """(node, loss, leaves, cost, link) of every large node and of each subtree's start: bottom-up, one join a level.

    ``cost`` is the loss of all leaves below, ``link`` what a leaf less costs: (loss - cost) / (leaves - 1), null for a leaf.
    """
    def sums(which):
        inner = F.transform(F.arrays_zip(F.col("left").alias("l"), F.col(which).alias("v")), lambda r: F.when(r["l"] < 0, r["v"]).otherwise(F.lit(0.0)))
        return F.aggregate(inner, F.lit(0.0), lambda a, v: a + v)

    below = tree.ends.withColumn("one", F.transform("left", lambda l: F.lit(1.0))).select(
        "node", F.get("loss", F.lit(0)).alias("loss"), sums("one").cast("long").alias("leaves"), sums("loss").alias("cost"))
    out = below
    for level in reversed(tree.levels):
        kids = level.select("node", (F.col("impurity") * F.col("samples")).alias("loss"), F.explode(F.array("left", F.col("left") + 1)).alias("kid"))
        joined = kids.join(below.select(F.col("node").alias("kid"), "leaves", "cost"), "kid")
        up = checkpointed(joined.groupBy("node").agg(F.first("loss").alias("loss"), F.sum("leaves").alias("leaves"), F.sum("cost").alias("cost")))
        below, out = up.unionByName(below), out.unionByName(up)
    return out.withColumn("link", (F.col("loss") - F.col("cost")) / F.nullif(F.col("leaves") - 1, F.lit(0)))
