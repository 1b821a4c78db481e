"""Fitted models as folders of Parquet tables: written by one session, read by another.

``values`` has one row per number, text or list of them, known by its place in
the model; its root row names the kind of the model. ``nodes`` has one row per
node of the trees that the model holds itself. What a model holds as a table
(token weights, support vectors, levels of large trees) is written as one,
below ``tables``, and checked against the columns its kind asks for when read.
``values`` is written last, so a folder that has it is whole.
"""

import dataclasses
import datetime
import decimal
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulearn.operators import boosting, dual_svm, kernels, linear, maxent, mixture, naive_bayes, node_tables, quasi_newton, sequence, trees, wide_pca
from tabulearn.session import ensure_checkpoint_dir

KINDS = {
    "gaussian_nb": naive_bayes.GaussianModel, "token_nb": naive_bayes.CountModel,
    "tree": trees.Tree, "tree_ensemble": boosting.TreeEnsemble, "gradient_boosted": boosting.GradientBoosted,
    "stump": boosting.Stump, "stump_regressor": boosting.StumpRegressor,
    "weighted_stump": boosting.WeightedStump, "adaboost": boosting.AdaBoost,
    "node_tree": node_tables.NodeTree, "node_ensemble": node_tables.NodeEnsemble,
    "logistic": linear.LogisticModel, "perceptron": linear.Perceptron,
    "maxent": maxent.MaxentModel, "maxent_newton": quasi_newton.Fit,
    "svm_primal": kernels.LinearSvm, "svm_dual": dual_svm.DualModel,
    "coins": mixture.CoinModel, "gaussian_mixture": mixture.MixtureModel, "hmm": sequence.HmmParams,
    "wide_pca": wide_pca.WidePca,
}
NAMES = {cls: kind for kind, cls in KINDS.items()}

# Columns that the tables of a kind must have; further ones are kept as they are.
COLUMNS = {
    ("token_nb", "tokens"): {"token": "string", "log_prob": "array<double>", "weight": "array<double>"},
    ("maxent", "weights"): {"token": "string", "w": "array<double>"},
    ("maxent_newton", "weights"): {"token": "string", "w": "array<double>"},
    ("svm_dual", "support"): {"x": "array<double>", "y": "double", "alpha": "double"},
    ("node_tree", "levels"): {"node": "bigint", "feature": "int", "point": "double", "left": "bigint"},
    ("node_tree", "ends"): {"node": "bigint", "feature": "array<int>", "point": "array<double>", "left": "array<int>", "value": "array<double>"},
}
VALUES = "place string, kind string, texts array<string>, numbers array<double>, shape array<int>"
NODES = "place string, id string, stats map<string,double>, loss double, size double, feature int, point double, mean double"

# How a scalar is written as text and read back; floats are kept as numbers.
SCALARS = {
    "bool": (bool, str, lambda t: t == "True"), "int": (int, str, int), "str": (str, str, str),
    "timestamp": (datetime.datetime, datetime.datetime.isoformat, datetime.datetime.fromisoformat),
    "date": (datetime.date, datetime.date.isoformat, datetime.date.fromisoformat), "decimal": (decimal.Decimal, str, decimal.Decimal),
}


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


def _scalar(value):
    """The name of a scalar's type, or None."""
    if isinstance(value, float):
        return "float"
    return next((name for name, (cls, _, _) in SCALARS.items() if isinstance(value, cls)), None)


def _fields(model) -> dict:
    if dataclasses.is_dataclass(model):
        return {f.name: getattr(model, f.name) for f in dataclasses.fields(model)}
    return dict(vars(model))


class _Parts:
    def __init__(self):
        self.values, self.nodes, self.tables = [], [], {}

    def row(self, place, kind, texts=None, numbers=None, shape=None):
        self.values.append((place, kind, texts, numbers, shape))

    def add(self, place: str, value):
        value = _plain(value)
        scalar = _scalar(value)
        if value is None:
            self.row(place, "none")
        elif scalar == "float":
            self.row(place, "float", numbers=[value])
        elif scalar:
            self.row(place, scalar, [SCALARS[scalar][1](value)])
        elif type(value) in NAMES:
            fields = _fields(value)
            self.row(place, f"model {NAMES[type(value)]}", list(fields))
            for name, part in fields.items():
                self.add(f"{place}/{name}", part)
        elif isinstance(value, DataFrame):
            self.row(place, "table")
            self.tables[place] = value
        elif isinstance(value, np.ndarray):
            self.row(place, "array", numbers=value.astype(float).ravel().tolist(), shape=list(value.shape))
        elif isinstance(value, dict) and value and all(isinstance(v, trees.Node) for v in value.values()):
            self.row(place, "nodes")
            for n in value.values():
                self.nodes.append((place, str(n.id), {k: float(v) for k, v in n.stats.items() if v is not None}, n.loss, n.size, n.feature, n.point, n.mean))
        elif isinstance(value, dict):
            self.row(place, "map")
            self.add(f"{place}/keys", list(value))
            self.add(f"{place}/values", list(value.values()))
        elif isinstance(value, (list, tuple)):
            kind, items = type(value).__name__, [_plain(v) for v in value]
            scalars = {_scalar(v) for v in items}
            if scalars == {"float"}:
                self.row(place, f"{kind} of float", numbers=items)
            elif len(scalars) == 1 and None not in scalars:
                of = scalars.pop()
                self.row(place, f"{kind} of {of}", [SCALARS[of][1](v) for v in items])
            else:
                self.row(place, kind, shape=[len(items)])
                for i, v in enumerate(items):
                    self.add(f"{place}/{i}", v)
        else:
            raise TypeError(f"no way to write {type(value).__name__} at {place or 'the root'}")


def save_model(spark: SparkSession, model, folder: str) -> None:
    """Write the model to a folder that doesn't exist yet."""
    if type(model) not in NAMES:
        raise TypeError(f"no kind of model: {type(model).__name__}")
    parts = _Parts()
    parts.add("", model)
    for place, table in parts.tables.items():
        table.write.parquet(f"{folder}/tables{place}")
    if parts.nodes:
        spark.createDataFrame(parts.nodes, NODES).write.parquet(f"{folder}/nodes")
    spark.createDataFrame(parts.values, VALUES).coalesce(1).write.parquet(f"{folder}/values")


def load_model(spark: SparkSession, folder: str, kind: str = None):
    """The model in the folder, of this kind if one is given; a table that misses a column of its kind is refused."""
    rows = {r["place"]: r for r in spark.read.parquet(f"{folder}/values").collect()}
    nodes = {}
    if any(r["kind"] == "nodes" for r in rows.values()):
        for r in spark.read.parquet(f"{folder}/nodes").collect():
            node = trees.Node(int(r["id"]), dict(r["stats"]), r["loss"], r["size"], r["feature"], r["point"], r["mean"])
            nodes.setdefault(r["place"], {})[node.id] = node

    def read(place, owner):
        row = rows[place]
        what, _, of = row["kind"].partition(" ")
        if what == "none":
            return None
        if what == "float":
            return row["numbers"][0]
        if what in SCALARS:
            return SCALARS[what][2](row["texts"][0])
        if what == "model":
            return KINDS[of](**{name: read(f"{place}/{name}", (of, name)) for name in row["texts"]})
        if what == "table":
            return _checked(spark.read.parquet(f"{folder}/tables{place}"), owner, place)
        if what == "array":
            return np.array(row["numbers"], dtype=float).reshape(row["shape"])
        if what == "nodes":
            return dict(sorted(nodes[place].items()))
        if what == "map":
            return dict(zip(read(f"{place}/keys", owner), read(f"{place}/values", owner)))
        if of.startswith("of "):
            of = of.removeprefix("of ")
            items = row["numbers"] if of == "float" else [SCALARS[of][2](t) for t in row["texts"]]
        else:
            items = [read(f"{place}/{i}", owner) for i in range(row["shape"][0])]
        return tuple(items) if what == "tuple" else list(items)

    found = rows[""]["kind"].removeprefix("model ")
    if found not in KINDS or kind not in (None, found):
        raise ValueError(f"{folder} holds a model of kind {found}, not {kind or 'a known one'}")
    return read("", None)


def _checked(table: DataFrame, owner, place: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    for name, kind in COLUMNS.get(owner, {}).items():
        if kinds.get(name) != kind:
            raise ValueError(f"table {place}: column {name} is {kinds.get(name, 'missing')}, {owner[0]} needs {kind}")
    return table


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the folder that the executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
