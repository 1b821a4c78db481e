"""Plain SQL twins of the registered queries, with rounds unrolled into CTEs."""

from tabulearn.plans import settings as S

SQL = {}
KEYS = "l_orderkey, l_linenumber"
WORDS = r"[\p{L}\p{N}_]{2,}"


def num(v):
    return f"{float(v)!r}::DOUBLE"


def r0(expr, digits, name):
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def with_(*parts):
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip())


# ---- preparation and sources ----

SQL["label_encode"] = f"""
SELECT {KEYS}, l_returnflag,
  (SELECT count(DISTINCT b.l_returnflag) FROM lineitem b WHERE b.l_returnflag < a.l_returnflag)::INTEGER AS code,
  CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END::INTEGER AS status_code,
  CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN -1.0 ELSE 1.0 END::DOUBLE AS signed
FROM lineitem a"""

_scaled = ["l_quantity", "l_extendedprice", "l_tax"]
SQL["standardize"] = f"""
WITH m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _scaled)} FROM lineitem)
SELECT {KEYS}, {', '.join(r0(f'({c} - m_{c}) / s_{c}', 6, c) for c in _scaled)} FROM lineitem, m"""

SQL["impute_mean"] = f"""
SELECT {KEYS}, {', '.join(r0(f'coalesce(nullif({c}, 0), avg({c}) OVER ())', 8, c) for c in ('l_discount', 'l_tax'))}
FROM lineitem"""

SQL["binarize"] = f"""
SELECT {KEYS}, if(l_discount > 0.04::DOUBLE, 1, 0)::INTEGER AS l_discount, if(l_tax > 0.04::DOUBLE, 1, 0)::INTEGER AS l_tax
FROM lineitem"""

SQL["bias_feature"] = f"SELECT {KEYS}, {', '.join(S.X3)}, 1.0::DOUBLE AS bias FROM lineitem"

SQL["mask_rows"] = f"""
SELECT {KEYS}, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND NOT l_quantity > 25"""

SQL["split_by_key"] = f"SELECT {KEYS}, if(l_orderkey % 10 = 0, 'held', 'train') AS part FROM lineitem"


def words(min_df, extra=""):
    """words(doc_id, extra, token, n) of all documents."""
    return f"""
raw AS (SELECT doc_id{extra}, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS token FROM documents),
allwords AS (SELECT doc_id{extra}, token, count(*) AS n FROM raw GROUP BY ALL),
words AS (SELECT * FROM allwords WHERE token IN
  (SELECT token FROM allwords GROUP BY token HAVING count(DISTINCT doc_id) >= {min_df}))"""


SQL["bag_of_words"] = with_(words(5)) + " SELECT doc_id, token, n FROM words"

SQL["char_ngrams"] = r"""
WITH w AS (SELECT doc_id, ' ' || u || ' ' AS w FROM (
    SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS u FROM documents) WHERE u <> ''),
g AS (SELECT doc_id, w, unnest([1, 2, 3]) AS k FROM w),
s AS (SELECT doc_id, substr(w, i::INTEGER, k) AS token FROM (
    SELECT doc_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM g)),
c AS (SELECT doc_id, token, count(*) AS n FROM s GROUP BY ALL)
SELECT * FROM c WHERE token IN (SELECT token FROM c GROUP BY token HAVING count(*) >= 3)"""

SQL["tsv_source"] = f"""
SELECT {KEYS}, l_quantity AS f0, l_discount AS f1, l_tax AS f2, l_extendedprice AS label FROM lineitem"""

SQL["bad_lines"] = f"""
SELECT l_linenumber, count(*) FILTER (l_orderkey % 7 = 0 OR l_orderkey % 11 = 0) AS bad, count(*) FILTER (l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0) AS good,
  count(*) FILTER (l_orderkey % 7 = 0) AS short, {r0('sum(l_quantity) FILTER (l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0)', 4, 'quantity')}
FROM lineitem GROUP BY l_linenumber"""

_ws = dict(zip(["f0", "f1", "f2", "label"], [*S.X3, "l_extendedprice"]))
SQL["whitespace_source"] = f"""
SELECT {KEYS}, {', '.join(r0(f'CASE {c} WHEN 0 THEN (SELECT avg({c}) FROM lineitem) ELSE {c} END', 8, n) for n, c in _ws.items())}
FROM lineitem"""

SQL["pixel_source"] = f"""
SELECT vec_id, if(label = 0, 1, -1)::INTEGER AS label, (i - 1)::INTEGER AS pos,
  {r0('((floor(embedding[i]::DOUBLE * 1000)::BIGINT % 256 + 256) % 256) / 255.0::DOUBLE', 8, 'pixel')}
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""

# Spark's trim takes spaces only, and the split drops the whitespace after the label.
SQL["text_source"] = r"""
WITH t AS (SELECT doc_id, lang, regexp_replace(rtrim(text, ' '), '^\s+', '') AS body FROM documents)
SELECT doc_id, right(lang, 1) AS label, length(body)::BIGINT AS chars, md5(body) AS digest FROM t"""

SQL["yes_no_source"] = r"""
WITH t AS (SELECT doc_id, quality, regexp_replace(rtrim(text, ' '), '^\s+', '') AS body FROM documents JOIN labels USING (doc_id))
SELECT doc_id, quality::VARCHAR AS label, length(body)::BIGINT AS chars FROM t"""


# ---- naive Bayes ----

def gnb(where="true"):
    """gp(label, f, prior, mean, var) from long rows."""
    return f"""
gl AS (SELECT {KEYS}, l_returnflag AS label, unnest([{', '.join(f"'{c}'" for c in S.X4)}]) AS f,
  unnest([{', '.join(S.X4)}]) AS v FROM lineitem),
gp AS (SELECT label, f, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS prior, avg(v) AS mean, var_pop(v) AS var
  FROM gl GROUP BY ALL)"""


SQL["gnb_params"] = with_(gnb()) + f"""
SELECT label, f AS feature, {r0('prior', 8, 'prior')}, {r0('mean', 6, 'mean')}, {r0('sqrt(var)', 7, 'deviation')} FROM gp"""

_wide = ",\n".join(f"max(mean) FILTER (f = '{c}') AS m{i}, max(var) FILTER (f = '{c}') AS v{i}" for i, c in enumerate(S.X4))
_density = " + ".join(f"(ln(2 * pi() * v{i}) + ({c} - m{i}) * ({c} - m{i}) / v{i})" for i, c in enumerate(S.X4))
GNB_SCORES = with_(gnb(), f"gw AS (SELECT label, max(prior) AS prior, {_wide} FROM gp GROUP BY label)", f"""
sc AS (SELECT rid, {KEYS}, l_returnflag, label, ln(prior) - 0.5 * ({_density}) AS jll
  FROM (SELECT row_number() OVER () AS rid, * FROM lineitem), gw)""")
SQL["gnb_log_proba"] = GNB_SCORES + f""",
n AS (SELECT *, max(jll) OVER (PARTITION BY rid) AS top FROM sc),
m AS (SELECT *, jll - top - ln(sum(exp(jll - top)) OVER (PARTITION BY rid)) AS lp FROM n)
SELECT {KEYS}, label, {r0('jll', 5, 'jll')}, {r0('lp', 6, 'log_proba')}, {r0('exp(lp)', 7, 'proba')} FROM m"""
_gnb_best = ", p AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY rid ORDER BY jll DESC, label) = 1)"
SQL["gnb_predict"] = GNB_SCORES + _gnb_best + f" SELECT {KEYS}, l_returnflag, label AS prediction FROM p"
SQL["gnb_accuracy"] = GNB_SCORES + _gnb_best + f"""
SELECT {r0('avg(if(label = l_returnflag, 1.0, 0.0))', 8, 'accuracy')},
  {r0('avg(if(label = l_returnflag, 0.0, 1.0))', 8, 'error_rate')} FROM p"""

_cvw = ", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(S.X4))
SQL["cv_gnb"] = f"""
WITH b AS (SELECT row_number() OVER () AS rid, l_orderkey % 5 AS fold, * FROM lineitem),
f AS (SELECT unnest(range(5)) AS fold),
g AS (SELECT f.fold, l_returnflag AS label, count(*)::DOUBLE AS n, {_cvw} FROM b, f WHERE b.fold <> f.fold GROUP BY ALL),
sc AS (SELECT rid, b.fold, l_returnflag, label, ln(n) - 0.5 * ({_density}) AS jll FROM b JOIN g ON b.fold = g.fold),
p AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY rid ORDER BY jll DESC, label) = 1)
SELECT fold::INTEGER AS fold, count(*) AS n, {r0('avg(if(label = l_returnflag, 1.0, 0.0))', 8, 'accuracy')}
FROM p GROUP BY fold"""

MNB = with_(words(2, ", lang"), """
vocab AS (SELECT DISTINCT token FROM words),
cls AS (SELECT lang AS label, count(*) AS docs, ln(count(*) / (SELECT count(*) FROM documents)::DOUBLE) AS lprior
  FROM documents GROUP BY lang),
cnt AS (SELECT lang AS label, token, sum(n) AS n FROM words GROUP BY ALL),
grid AS (SELECT label, token, coalesce(n, 0) + 1.0::DOUBLE AS a FROM cls CROSS JOIN vocab LEFT JOIN cnt USING (label, token)),
lp AS (SELECT label, token, ln(a) - ln(sum(a) OVER (PARTITION BY label)) AS lp FROM grid)""")
SQL["mnb_params"] = MNB + f" SELECT label, token, {r0('lp', 6, 'log_prob')} FROM lp"
_doc_scores = """,
part AS (SELECT doc_id, label, sum(n * lp) AS s FROM words JOIN lp USING (token) GROUP BY ALL),
sc AS (SELECT d.doc_id, c.label, c.lprior + coalesce(s, 0) AS jll
  FROM documents d CROSS JOIN cls c LEFT JOIN part p ON p.doc_id = d.doc_id AND p.label = c.label)"""
_doc_norm = f""",
n AS (SELECT *, max(jll) OVER (PARTITION BY doc_id) AS top FROM sc),
m AS (SELECT *, jll - top - ln(sum(exp(jll - top)) OVER (PARTITION BY doc_id)) AS q FROM n)
SELECT doc_id, label, {r0('jll', 4, 'jll')}, {r0('q', 4, 'log_proba')}, {r0('exp(q)', 6, 'proba')} FROM m"""
_doc_best = """
SELECT doc_id, label AS prediction FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY jll DESC, label) = 1"""
SQL["mnb_log_proba"] = MNB + _doc_scores + _doc_norm
SQL["mnb_predict"] = MNB + _doc_scores + _doc_best

BNB = with_(words(2), """
cls AS (SELECT quality AS label, count(*) AS docs, ln(count(*) / (SELECT count(*) FROM labels)::DOUBLE) AS lprior
  FROM labels GROUP BY quality),
seen AS (SELECT quality AS label, token, count(*) AS n FROM words JOIN labels USING (doc_id) GROUP BY ALL),
vocab AS (SELECT DISTINCT token FROM seen),
pr AS (SELECT label, token, (coalesce(n, 0) + 1.0::DOUBLE) / (docs + 2.0::DOUBLE) AS p
  FROM cls CROSS JOIN vocab LEFT JOIN seen USING (label, token)),
off AS (SELECT label, sum(ln(1 - p)) AS base FROM pr GROUP BY label)""")
SQL["bnb_params"] = BNB + f" SELECT label, token, {r0('ln(p)', 6, 'log_prob')} FROM pr"
_bnb_scores = """,
part AS (SELECT doc_id, label, sum(ln(p) - ln(1 - p)) AS s FROM words JOIN pr USING (token) GROUP BY ALL),
sc AS (SELECT d.doc_id, c.label, c.lprior + o.base + coalesce(s, 0) AS jll FROM documents d CROSS JOIN cls c
  JOIN off o ON o.label = c.label LEFT JOIN part p ON p.doc_id = d.doc_id AND p.label = c.label)"""
SQL["bnb_log_proba"] = BNB + _bnb_scores + _doc_norm
SQL["bnb_predict"] = BNB + _bnb_scores + _doc_best


# ---- neighbours ----

KNN = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, b.label, list_distance(a.x, b.x) AS distance
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM p QUALIFY rank <= 5)"""
SQL["knn_neighbors"] = KNN + f" SELECT vec_id, neighbor_id, {r0('distance', 6, 'distance')}, rank::INTEGER AS rank FROM k"
SQL["knn_predict"] = KNN + """
SELECT vec_id, label AS prediction, count(*) AS votes FROM k GROUP BY vec_id, label
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, min(rank)) = 1"""


# ---- trees ----

SQL["node_impurity"] = f"""
WITH c AS (SELECT l_linenumber, l_returnflag, count(*)::DOUBLE AS k FROM lineitem GROUP BY ALL),
p AS (SELECT l_linenumber, k / sum(k) OVER (PARTITION BY l_linenumber) AS p FROM c),
i AS (SELECT l_linenumber, {r0('1 - sum(p * p)', 8, 'gini')}, {r0('greatest(-sum(p * log2(p + 1e-9)), 0)', 8, 'entropy')}
  FROM p GROUP BY ALL)
SELECT l_linenumber, count(*) AS n, any_value(gini) AS gini, any_value(entropy) AS entropy,
  {r0('avg(l_extendedprice)', 4, 'mean')}, {r0('var_pop(l_extendedprice)', 1, 'variance')}
FROM lineitem JOIN i USING (l_linenumber) GROUP BY l_linenumber"""

_cand_cols = [*S.X3, "l_linenumber"]
SQL["split_candidates"] = "\nUNION\n".join(f"""
SELECT '{c}' AS feature, unnest([if(v = lo, v, NULL), (v + nx) / 2, if(v = hi, v, NULL)]) AS point FROM
 (SELECT v, lead(v) OVER (ORDER BY v) AS nx, min(v) OVER () AS lo, max(v) OVER () AS hi FROM
  (SELECT DISTINCT {c}::DOUBLE AS v FROM lineitem))""" for c in _cand_cols)
SQL["split_candidates"] = f"SELECT * FROM ({SQL['split_candidates']}) WHERE point IS NOT NULL"


def sse(n, s, q):
    return f"greatest({q} - {s} * {s} / {n}, 0)"


def gini(counts):
    n = "(" + " + ".join(counts) + ")"
    return f"({n} * (1 - (" + " + ".join(f"pow({c} / {n}, 2)" for c in counts) + ")))"


def entropy(counts):
    n = "(" + " + ".join(counts) + ")"
    return f"({n} * greatest(-(" + " + ".join(f"({c} / {n}) * log2({c} / {n} + 1e-9)" for c in counts) + "), 0))"


class Tree:
    """CTEs that grow a tree from ``src`` (rid, node = 1, f0.., y or class c) level by level.

    The last row table is ``<p>r<depth>``; ``<p>b<level>`` holds the chosen splits.
    """

    def __init__(self, p, src, n_features, depth, edges=True, classes=0, kind="gini"):
        self.p, self.depth = p, depth
        self.parts = [f"{p}r0 AS (SELECT *, 1::BIGINT AS node FROM {src})"]
        if classes:
            sums = {f"k{i}": f"count(*) FILTER (c = {i})::DOUBLE" for i in range(classes)}
        else:
            sums = {"n": "count(*)::DOUBLE", "s": "sum(y)", "q": "sum(y * y)"}
        measure = (gini if kind == "gini" else entropy) if classes else (lambda c: sse(*c))
        left = measure([f"c{s}" for s in sums])
        right = measure([f"(t{s} - c{s})" for s in sums])
        parent = measure([f"t{s}" for s in sums])
        point = "CASE WHEN v = lo THEN v ELSE (v + nx) / 2 END" if edges else "(v + nx) / 2"
        for k in range(depth):
            long = " UNION ALL ".join(
                f"SELECT node, {i} AS f, f{i} AS v, {'c' if classes else 'y'} FROM {p}r{k}" for i in range(n_features))
            self.parts.append(f"""
{p}h{k} AS (SELECT node, f, v, {', '.join(f'{e} AS {s}' for s, e in sums.items())} FROM ({long}) GROUP BY node, f, v),
{p}c{k} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nx, min(v) OVER (PARTITION BY node, f) AS lo,
  {', '.join(f'sum({s}) OVER (PARTITION BY node, f ORDER BY v) AS c{s}, sum({s}) OVER (PARTITION BY node, f) AS t{s}' for s in sums)}
  FROM {p}h{k}),
{p}l{k} AS (SELECT node, f, {point} AS p, {left} + {right} AS loss, {parent} AS parent FROM {p}c{k} WHERE nx IS NOT NULL),
{p}b{k} AS (SELECT node, f, p, round(1 - loss / nullif(parent, 0), 9) AS gain FROM {p}l{k} WHERE 1 - loss / nullif(parent, 0) > 1e-12
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, p) = 1),
{p}r{k + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node
    WHEN [{', '.join(f'f{i}' for i in range(n_features))}][b.f + 1] <= b.p THEN 2 * r.node ELSE 2 * r.node + 1 END AS node
  FROM {p}r{k} r LEFT JOIN {p}b{k} b USING (node))""")

    def nodes(self, stats):
        """<p>n(node, f, p, stats..): every node, with its split when it has one."""
        rows = " UNION ALL ".join(
            f"SELECT node, {stats} FROM {self.p}r{k} WHERE node >= {2 ** k} GROUP BY node" for k in range(self.depth + 1))
        found = " UNION ALL ".join(f"SELECT node, f, p FROM {self.p}b{k} WHERE node >= {2 ** k}" for k in range(self.depth))
        return f"""{self.p}s AS ({found}),
{self.p}n AS (SELECT a.*, s.f, s.p FROM ({rows}) a LEFT JOIN {self.p}s s USING (node))"""

    @property
    def leaf(self):
        return f"{self.p}r{self.depth}"


def source(y="0.0", where="true", label=None):
    """x(rid, keys, f0.., y or c)"""
    target = f"{y} AS y"
    if label:
        target = f"(dense_rank() OVER (ORDER BY {label}) - 1)::INTEGER AS c, {label} AS lab"
    return f"""x AS (SELECT row_number() OVER () AS rid, {KEYS}, {', '.join(f'{c} AS f{i}' for i, c in enumerate(S.X3))}, {target}
  FROM lineitem WHERE {where})"""


CENTRED = "l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)"
NAMES = "[" + ", ".join(f"'{c}'" for c in S.X3) + "]"
PRICE_STATS = "count(*) AS n, avg(y) AS m, var_pop(y) AS v"
MEAN_PRICE = "(SELECT avg(l_extendedprice) FROM lineitem)"


def one_level(feats, target_cte, classes=0, kind="gini", edges=False):
    """The best split per l_linenumber: the tree's first level with the node taken from the row."""
    t = Tree("t", "x", len(feats), 1, edges, classes, kind)
    parts = [t.parts[0].replace("SELECT *, 1::BIGINT AS node", "SELECT *, l_linenumber::BIGINT AS node"), *t.parts[1:]]
    return with_(target_cte, *parts)


def split_out(feats, point="p"):
    names = "[" + ", ".join(f"'{c}'" for c in feats) + "]"
    return f" SELECT node, {names}[f + 1] AS feature, {point} AS point, {r0('gain', 7, 'gain')} FROM tb0"


SQL["best_split_regression"] = one_level(S.X3, source(CENTRED)) + split_out(S.X3)
_qty = """x AS (SELECT l_linenumber, l_extendedprice AS f0, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS y FROM lineitem)"""
SQL["best_split_continuous"] = one_level(["l_extendedprice"], _qty) + split_out(["l_extendedprice"], "round(p, 4)")
_flags = source(label="l_returnflag")
SQL["best_split_gini"] = one_level(S.X3, _flags, 3, "gini", True) + split_out(S.X3)
SQL["best_split_entropy"] = one_level(S.X3, _flags, 3, "entropy", True) + split_out(S.X3)

PRICE_TREE = Tree("t", "x", 3, 2)
_price = with_(source(CENTRED), *PRICE_TREE.parts, PRICE_TREE.nodes(PRICE_STATS))
SQL["tree_regress"] = _price + f"""
SELECT node AS node_id, node // 2 AS parent_id, {NAMES}[f + 1] AS feature, p AS split_point,
  {r0('v', 1, 'impurity')}, n AS samples, {r0(f'm + {MEAN_PRICE}', 4, 'value')} FROM tn"""
SQL["tree_regress_predict"] = _price + f"""
SELECT {KEYS}, {r0(f'm + {MEAN_PRICE}', 4, 'prediction')} FROM tr2 JOIN tn USING (node)"""
SQL["tree_regress_score"] = _price + f"""
SELECT {r0('1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*))', 8, 'r2')}, {r0('avg((y - m) * (y - m))', 1, 'mse')}
FROM tr2 JOIN tn USING (node)"""
SQL["tree_edges"] = _price + f"""
SELECT a.node AS node_id, coalesce(b.node, 0) AS parent_id, a.node % 2 = 0 AS branch_true,
  {NAMES}[b.f + 1] || if(a.node % 2 = 0, ' <= ', ' > ') AS rule, b.p AS rule_point,
  {r0('a.v', 1, 'impurity')}, a.n AS samples, {r0(f'a.m + {MEAN_PRICE}', 4, 'value')}
FROM tn a LEFT JOIN tn b ON a.node // 2 = b.node"""


def class_tree(label, classes, kind):
    t = Tree("t", "x", 3, 2, True, classes, kind)
    stats = "count(*) AS n, " + ", ".join(f"count(*) FILTER (c = {i})::DOUBLE AS k{i}" for i in range(classes))
    return with_(source(label=label), *t.parts, t.nodes(stats), "names AS (SELECT DISTINCT c, lab FROM x)")


def class_rows(label, classes, kind):
    counts = [f"k{i}" for i in range(classes)]
    top = f"greatest({', '.join(counts)})"
    measure = gini if kind == "gini" else entropy
    return class_tree(label, classes, kind) + f"""
SELECT node AS node_id, node // 2 AS parent_id, {NAMES}[f + 1] AS feature, p AS split_point,
  {r0(f'{measure(counts)} / n', 8, 'impurity')}, n AS samples, {top} AS value,
  (SELECT lab FROM names WHERE c = list_position([{', '.join(counts)}], {top}) - 1) AS label FROM tn"""


SQL["tree_classify"] = class_rows("l_linestatus", 2, "gini")
SQL["tree_classify_entropy"] = class_rows("l_returnflag", 3, "entropy")
SQL["tree_classify_predict"] = class_tree("l_returnflag", 3, "gini") + f"""
, best AS (SELECT node, list_position([k0, k1, k2], greatest(k0, k1, k2)) - 1 AS w FROM tn)
SELECT {KEYS}, t.lab AS l_returnflag, names.lab AS prediction FROM tr2 t JOIN best USING (node) JOIN names ON names.c = w"""


def pruning(depth=3):
    """alive<k>(node, loss, n, m, internal): the nodes left after k cuts; cut<k> the weakest link."""
    train = "l_orderkey % 10 <> 0"
    y = f"l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem WHERE {train})"
    t = Tree("t", "x", 3, depth)
    steps = 2 ** depth - 1
    parts = [source(y, train), *t.parts, t.nodes(PRICE_STATS),
             "alive0 AS (SELECT node, v * n AS loss, m, f IS NOT NULL AS internal FROM tn)"]
    for k in range(steps):
        parts.append(f"""
link{k} AS (SELECT a.node, (any_value(a.loss) - sum(b.loss)) / (count(*) - 1) AS g FROM alive{k} a JOIN alive{k} b
  ON a.internal AND NOT b.internal AND b.node >= a.node AND list_contains([b.node // 2, b.node // 4, b.node // 8], a.node) GROUP BY a.node),
cut{k} AS (SELECT node, g FROM link{k} ORDER BY g, node LIMIT 1),
alive{k + 1} AS (SELECT a.node, a.loss, a.m, a.internal AND NOT a.node = coalesce((SELECT node FROM cut{k}), 0) AS internal FROM alive{k} a
  WHERE NOT list_contains([a.node // 2, a.node // 4, a.node // 8], coalesce((SELECT node FROM cut{k}), 0)
    ) AND EXISTS (SELECT 1 FROM cut{k}))""")
    return with_(*parts), steps, t


_pruning, _steps, _ptree = pruning()
_sequence = " UNION ALL ".join(
    f"SELECT {k}::INTEGER AS step, {'0.0::DOUBLE' if k == 0 else f'(SELECT g FROM cut{k - 1})'} AS alpha,"
    f" count(*)::INTEGER AS leaves, sum(loss) AS cost FROM alive{k} WHERE NOT internal HAVING count(*) > 0" for k in range(_steps + 1))
SQL["prune_sequence"] = _pruning + f", sq AS ({_sequence}) SELECT step, {r0('alpha', -3, 'alpha')}, leaves, {r0('cost', -4, 'cost')} FROM sq"

# Each held row walks the whole tree; in a subtree it stops at its deepest node still alive.
_walk = ["""v0 AS (SELECT row_number() OVER () AS rid, l_quantity, l_discount, l_tax, 1::BIGINT AS node,
  l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem WHERE l_orderkey % 10 <> 0) AS y
  FROM lineitem WHERE l_orderkey % 10 = 0)"""]
for _k in range(3):
    _walk.append(f"""v{_k + 1} AS (SELECT v.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN v.node
  WHEN [l_quantity, l_discount, l_tax][s.f + 1] <= s.p THEN 2 * v.node ELSE 2 * v.node + 1 END AS node
  FROM v{_k} v LEFT JOIN ts s USING (node))""")
_scores = " UNION ALL ".join(
    f"""SELECT {k}::INTEGER AS step, 1 - sum((y - m) * (y - m)) / any_value(sst) AS r2 FROM (
    SELECT y, (SELECT max_by(a.m, a.node) FROM alive{k} a WHERE list_contains([h.node, h.node // 2, h.node // 4, h.node // 8], a.node)) AS m,
      (SELECT var_pop(y) * count(*) FROM v3) AS sst FROM v3 h) HAVING count(m) > 0""" for k in range(_steps + 1))
SQL["prune_select"] = _pruning + ", " + ", ".join(_walk) + f""", sq AS ({_sequence}), rs AS ({_scores})
SELECT step, {r0('r2', 8, 'r2')}, leaves, row_number() OVER (ORDER BY round(r2, 12) DESC, alpha DESC, step DESC) = 1 AS chosen
FROM rs JOIN sq USING (step)"""


# ---- boosting ----

def boosted(rounds, depth, prefix="q"):
    """<prefix><k>: rows with the score F after k rounds (in units centred on the mean)."""
    parts = [source(CENTRED), f"{prefix}0 AS (SELECT *, y AS y0, 0.0::DOUBLE AS score FROM x)"]
    found = []
    for k in range(rounds):
        t = Tree(f"g{k}", f"{prefix}{k}", 3, depth, edges=False)
        parts += [*t.parts, t.nodes(PRICE_STATS),
                  f"{prefix}{k + 1} AS (SELECT r.* EXCLUDE (node, y, score), y0 - (score + m) AS y, score + m AS score"
                  f" FROM {t.leaf} r JOIN g{k}n USING (node))"]
        found.append(t)
    return with_(*parts)


STUMPS = boosted(S.ROUNDS, 1)


def shifted(k, m):
    return f"{m} + {MEAN_PRICE}" if k == 0 else m


SQL["stump_regress"] = STUMPS + " UNION ALL ".join(f"""
SELECT {k + 1}::INTEGER AS round, {NAMES}[a.f + 1] AS feature, a.p AS point,
  {r0(shifted(k, 'b.m'), 4, 'left_output')}, {r0(shifted(k, 'c.m'), 4, 'right_output')}
FROM g{k}n a JOIN g{k}n b ON a.node = 1 AND b.node = 2 JOIN g{k}n c ON c.node = 3""" for k in range(S.ROUNDS))
SQL["stump_regress_predict"] = STUMPS + f" SELECT {KEYS}, {r0(f'score + {MEAN_PRICE}', 4, 'prediction')} FROM q{S.ROUNDS}"
SQL["staged_r2"] = STUMPS + " UNION ALL ".join(
    f" SELECT {k + 1}::INTEGER AS round, {r0('1 - sum(y * y) / (var_pop(y0) * count(*))', 8, 'r2')} FROM q{k + 1}"
    for k in range(S.ROUNDS))

BOOSTED = boosted(2, 2)
SQL["boosted_trees"] = BOOSTED + " UNION ALL ".join(f"""
SELECT {k + 1}::INTEGER AS round, node AS node_id, node // 2 AS parent_id, {NAMES}[f + 1] AS feature, p AS split_point,
  {r0('v', 1, 'impurity')}, n AS samples, {r0(shifted(k, 'm'), 4, 'value')} FROM g{k}n""" for k in range(2))
SQL["boosted_trees_predict"] = BOOSTED + f" SELECT {KEYS}, {r0(f'score + {MEAN_PRICE}', 4, 'prediction')} FROM q2"

# ---- grids: each fold's tree is grown on its own rows, the held rows walk it ----

def held_walk(p, src, depth):
    """<p>v<k>: the rows of ``src`` with their node after k levels of the tree <p>."""
    parts = [f"{p}v0 AS (SELECT *, 1::BIGINT AS node FROM {src})"]
    for k in range(depth):
        parts.append(f"""{p}v{k + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node
    WHEN [f0, f1, f2][b.f + 1] <= b.p THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM {p}v{k} r LEFT JOIN {p}b{k} b USING (node))""")
    return parts


def folded(f, src="x"):
    return [f"x{f} AS (SELECT * FROM {src} WHERE l_orderkey % {S.GRID_FOLDS} <> {f})", f"y{f} AS (SELECT * FROM {src} WHERE l_orderkey % {S.GRID_FOLDS} = {f})"]


def tree_grid():
    parts, out = [source(CENTRED)], []
    for f in range(S.GRID_FOLDS):
        t = Tree(f"u{f}", f"x{f}", 3, 2)
        parts += [*folded(f), *t.parts, t.nodes(PRICE_STATS), *held_walk(f"u{f}", f"y{f}", 2)]
        for depth in S.GRID_DEPTHS:
            for least in S.GRID_SAMPLES:
                first = "if(v.node < 4, v.node, v.node // 2)"
                at = first if depth == 1 else f"CASE WHEN (SELECT n FROM u{f}n a WHERE a.node = {first}) >= {least} THEN v.node ELSE {first} END"
                at = f"CASE WHEN (SELECT n FROM u{f}n WHERE node = 1) >= {least} THEN {at} ELSE 1 END"
                out.append(f"""
SELECT {depth}::INTEGER AS max_depth, {least}::DOUBLE AS min_samples, {f}::INTEGER AS fold, {r0('1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*))', 8, 'score')}
FROM (SELECT v.y, {at} AS node FROM u{f}v2 v) JOIN u{f}n USING (node)""")
    return with_(*parts) + " UNION ALL ".join(out)


def class_grid():
    parts, out = [source(label="l_returnflag")], []
    for f in range(S.GRID_FOLDS):
        parts += folded(f)
        for kind in ("gini", "entropy"):
            p = f"{kind}{f}"
            t = Tree(p, f"x{f}", 3, 2, True, 3, kind)
            parts += [*t.parts, t.nodes(", ".join(f"count(*) FILTER (c = {i}) AS k{i}" for i in range(3))), *held_walk(p, f"y{f}", 2)]
            for depth in S.GRID_DEPTHS:
                out.append(f"""
SELECT '{kind}' AS criterion, {depth}::INTEGER AS max_depth, {f}::INTEGER AS fold,
  {r0('avg((c = list_position([k0, k1, k2], greatest(k0, k1, k2)) - 1)::INTEGER)', 8, 'score')} FROM {p}v{depth} JOIN {p}n USING (node)""")
    return with_(*parts) + " UNION ALL ".join(out)


def boosted_grid(rounds):
    parts, out = [source(CENTRED)], []
    for f in range(S.GRID_FOLDS):
        mean = f"(SELECT avg(y) FROM x{f})"
        parts += [*folded(f), f"w{f}_0 AS (SELECT * REPLACE (y - {mean} AS y) FROM x{f})", f"h{f}_0 AS (SELECT *, {mean} AS score FROM y{f})"]
        for k in range(rounds):
            p = f"g{f}_{k}"
            t = Tree(p, f"w{f}_{k}", 3, 1, edges=False)
            parts += [*t.parts, t.nodes(PRICE_STATS), *held_walk(p, f"h{f}_{k}", 1),
                      f"w{f}_{k + 1} AS (SELECT r.* EXCLUDE (node, y), y - m AS y FROM {t.leaf} r JOIN {p}n USING (node))",
                      f"h{f}_{k + 1} AS (SELECT r.* EXCLUDE (node, score), score + m AS score FROM {p}v1 r JOIN {p}n USING (node))"]
            out.append(f"""
SELECT {k + 1}::INTEGER AS n_estimators, {f}::INTEGER AS fold, {r0('1 - sum((y - score) * (y - score)) / (var_pop(y) * count(*))', 8, 'score')} FROM h{f}_{k + 1}""")
    return with_(*parts) + " UNION ALL ".join(out)


SQL["tree_regress_grid"] = tree_grid()
SQL["tree_classify_grid"] = class_grid()
SQL["stump_grid"] = boosted_grid(S.ROUNDS)

SIGNED = "if(l_linestatus = (SELECT max(l_linestatus) FROM lineitem), 1.0, -1.0)::DOUBLE"
SQL["gbdt_gradient"] = f"""
SELECT {KEYS}, {r0('s / (1 + exp(s * l_tax))', 8, 'gradient')} FROM (SELECT *, {SIGNED} AS s FROM lineitem)"""


def gradient_boost(rounds, depth):
    parts = [source(SIGNED), "q0 AS (SELECT rid, l_orderkey, l_linenumber, f0, f1, f2, y AS lab, avg(y) OVER () AS score FROM x)"]
    for k in range(rounds):
        t = Tree(f"g{k}", f"i{k}", 3, depth, edges=False)
        parts += [f"i{k} AS (SELECT *, lab / (1 + exp(lab * score)) AS y FROM q{k})", *t.parts,
                  t.nodes("count(*) AS n, sum(y) / (sum(abs(y) * (1 - abs(y))) + 1e-9) AS m"),
                  f"q{k + 1} AS (SELECT r.* EXCLUDE (node, y, score), score + {num(S.GBDT_RATE)} * m AS score"
                  f" FROM {t.leaf} r JOIN g{k}n USING (node))"]
    return with_(*parts)


GBDT = gradient_boost(2, 2)
SQL["gbdt_leaves"] = GBDT + " UNION ALL ".join(
    f" SELECT {k + 1}::INTEGER AS round, node AS node_id, n AS samples, {r0('m', 7, 'value')} FROM g{k}n WHERE f IS NULL" for k in range(2))
SQL["gbdt_proba"] = GBDT + f" SELECT {KEYS}, {r0('1 / (1 + exp(-score))', 8, 'proba')} FROM q2"
SQL["gbdt_predict"] = GBDT + f"""
SELECT {KEYS}, if(1 / (1 + exp(-score)) >= 0.5, (SELECT max(l_linestatus) FROM lineitem), (SELECT min(l_linestatus) FROM lineitem)) AS prediction
FROM q2"""


def adaboost(rounds):
    """a<k>: rows with weight w and score after k rounds; s<k> the stump of round k."""
    parts = [source(SIGNED), "a0 AS (SELECT *, 1.0::DOUBLE / count(*) OVER () AS w, 0.0::DOUBLE AS score FROM x)"]
    for k in range(rounds):
        long = " UNION ALL ".join(f"SELECT {i} AS f, f{i} AS v, y, w FROM a{k}" for i in range(3))
        parts.append(f"""
h{k} AS (SELECT f, v, sum(w) FILTER (y > 0) AS wp, sum(w) FILTER (y < 0) AS wn FROM ({long}) GROUP BY f, v),
e{k} AS (SELECT f, v, coalesce(sum(wp) OVER u, 0) AS cp, coalesce(sum(wn) OVER u, 0) AS cn, sum(wp) OVER t AS tp, sum(wn) OVER t AS tn
  FROM h{k} WINDOW u AS (PARTITION BY f ORDER BY v), t AS (PARTITION BY f)),
d{k} AS (SELECT f, v, 0 AS gt, cp + tn - cn AS err FROM e{k} UNION ALL SELECT f, v, 1, cn + tp - cp FROM e{k}),
s{k} AS (SELECT f, v, gt, err, 0.5 * ln((1 - err) / (err + 1e-9)) AS alpha FROM d{k} ORDER BY round(err, 9), f, v, gt LIMIT 1),
o{k} AS (SELECT a.*, alpha * if(([f0, f1, f2][s.f + 1] <= s.v) = (s.gt = 1), 1.0, -1.0) AS ag FROM a{k} a, s{k} s),
a{k + 1} AS (SELECT o.* EXCLUDE (ag, w, score), w * exp(-y * ag) / sum(w * exp(-y * ag)) OVER () AS w, score + ag AS score FROM o{k} o)""")
    return with_(*parts)


ADA = adaboost(S.ROUNDS)
SQL["adaboost_rounds"] = ADA + " UNION ALL ".join(f"""
SELECT {k + 1}::INTEGER AS round, {NAMES}[f + 1] AS feature, v AS threshold, if(gt = 1, 'gt', 'lt') AS direction,
  {r0('err', 8, 'error')}, {r0('alpha', 7, 'alpha')} FROM s{k}""" for k in range(S.ROUNDS))
SQL["adaboost_score"] = ADA + f" SELECT {KEYS}, {r0('score', 7, 'score')} FROM a{S.ROUNDS}"
SQL["adaboost_predict"] = ADA + f"""
SELECT {KEYS}, if(y > 0, 'O', 'F') AS l_linestatus, if(score >= 0, 'O', 'F') AS prediction FROM a{S.ROUNDS}"""
SQL["adaboost_staged_error"] = ADA + " UNION ALL ".join(f"""
SELECT {k + 1}::INTEGER AS round, {r0('avg(if((score >= 0) = (y > 0), 0.0, 1.0))', 8, 'error_rate')} FROM a{k + 1}""" for k in range(S.ROUNDS))

_roc = """
t AS (SELECT (v + nx) / 2 AS t FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM (SELECT DISTINCT v FROM sc)) WHERE nx IS NOT NULL),
roc AS (SELECT t, avg(if(v >= t, 1.0, 0.0)) FILTER (pos) AS tpr, avg(if(v >= t, 1.0, 0.0)) FILTER (NOT pos) AS fpr FROM t, sc GROUP BY t)"""
_ada_sc = f", sc AS (SELECT round(score, 7) + 0.0 AS v, y > 0 AS pos FROM a{S.ROUNDS}),"
SQL["adaboost_roc"] = ADA + _ada_sc + _roc + f" SELECT {r0('t', 7, 'threshold')}, {r0('tpr', 8, 'tpr')}, {r0('fpr', 8, 'fpr')} FROM roc"
SQL["adaboost_auc"] = ADA + _ada_sc + f"""
ranked AS (SELECT pos, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk FROM sc),
a AS (SELECT sum(rk) FILTER (pos) AS s, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS n FROM ranked)
SELECT {r0('(s - p * (p + 1) / 2) / (p * n)', 8, 'auc')} FROM a"""
SQL["price_roc"] = "WITH sc AS (SELECT l_quantity AS v, l_linestatus = 'O' AS pos FROM lineitem)," + _roc + f"""
SELECT t AS threshold, {r0('tpr', 8, 'tpr')}, {r0('fpr', 8, 'fpr')} FROM roc"""


# ---- linear models ----

# lx: one row per (vec_id, position); position 64 is the bias.
LONG = """
ids AS (SELECT vec_id, label, if(label >= 5, 1.0, 0.0)::DOUBLE AS up FROM embeddings),
lx AS (SELECT vec_id, i - 1 AS f, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)
  UNION ALL SELECT vec_id, 64, 1.0 FROM embeddings)"""


def logistic(steps, outputs, target, keep="true"):
    """w<k>(o, f, w) after k steps; ``target`` gives the 0/1 truth of output o."""
    parts = [LONG, f"outs AS (SELECT unnest([{outputs}]) AS o)",
             "w0 AS (SELECT o, f, 0.0::DOUBLE AS w FROM outs, (SELECT unnest(range(65)) AS f))"]
    for k in range(steps):
        rate = S.LOGIT_RATE / (1.0 + S.LOGIT_DECAY * k)
        parts.append(f"""
z{k} AS (SELECT vec_id, o, sum(v * w) AS z FROM lx JOIN w{k} USING (f) GROUP BY ALL),
e{k} AS (SELECT vec_id, o, {target} - 1 / (1 + exp(-z)) AS e FROM z{k} JOIN ids USING (vec_id) WHERE {keep.format(step=k)}),
g{k} AS (SELECT o, f, sum(v * e) AS g FROM lx JOIN e{k} USING (vec_id) GROUP BY ALL),
w{k + 1} AS (SELECT o, f, w + {num(rate)} * (g - if(f = 64, 0, w / {num(S.LOGIT_C)})) AS w FROM w{k} JOIN g{k} USING (o, f))""")
    parts.append(f"zz AS (SELECT vec_id, o, sum(v * w) AS z FROM lx JOIN w{steps} USING (f) GROUP BY ALL)")
    return with_(*parts)


_weights = f" SELECT o::INTEGER AS output, f::INTEGER AS feature, {r0('w', 7, 'weight')} FROM w{S.STEPS}"
_upper = logistic(S.STEPS, "0", "up")
SQL["logistic_weights"] = _upper + _weights
SQL["logistic_predict"] = _upper + " SELECT vec_id, if(1 / (1 + exp(-z)) >= 0.5, 1, 0)::INTEGER AS prediction FROM zz"
SQL["logistic_gradient"] = with_(LONG) + f"""
SELECT f::INTEGER AS feature, {r0('sum(v * (up - 1 / (1 + exp(-0.5::DOUBLE))))', 6, 'gradient')} FROM lx JOIN ids USING (vec_id) GROUP BY f"""
_mix = f"((vec_id % 1000003) * 7919 + {{step}} * 104729) % 1000003 < {int(S.BATCH_SHARE * 1000003)}"
SQL["logistic_minibatch"] = logistic(S.STEPS, "0", "up", _mix) + _weights
_ovr = logistic(S.STEPS, ", ".join(str(i) for i in range(10)), "if(label = o, 1.0, 0.0)")
SQL["logistic_ovr"] = _ovr + _weights
SQL["logistic_ovr_predict"] = _ovr + """
SELECT vec_id, o::INTEGER AS prediction FROM zz QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, o) = 1"""


def perceptron(epochs):
    parts = [LONG, "w0 AS (SELECT unnest(range(65)) AS f, 0.0::DOUBLE AS w)"]
    for k in range(epochs):
        parts.append(f"""
z{k} AS (SELECT vec_id, sum(v * w) AS z FROM lx JOIN w{k} USING (f) GROUP BY ALL),
m{k} AS (SELECT vec_id, 2 * up - 1 AS y FROM z{k} JOIN ids USING (vec_id) WHERE (2 * up - 1) * z <= 0),
w{k + 1} AS (SELECT f, any_value(w) + coalesce(sum(v * y), 0) AS w FROM w{k} LEFT JOIN (SELECT * FROM lx JOIN m{k} USING (vec_id)) USING (f) GROUP BY f)""")
    parts.append(f"zz AS (SELECT vec_id, sum(v * w) AS z FROM lx JOIN w{epochs} USING (f) GROUP BY ALL)")
    return with_(*parts)


PERCEPTRON = perceptron(S.STEPS)
SQL["perceptron_batch"] = PERCEPTRON + f" SELECT f::INTEGER AS feature, {r0('w', 6, 'weight')} FROM w{S.STEPS}"
SQL["perceptron_mistakes"] = PERCEPTRON + " UNION ALL ".join(
    f" SELECT {k + 1}::INTEGER AS epoch, count(*)::INTEGER AS mistakes FROM m{k}" for k in range(S.STEPS))
SQL["perceptron_predict"] = PERCEPTRON + " SELECT vec_id, if(z >= 0, 1, -1)::INTEGER AS prediction FROM zz"


def dual(updates):
    """u<k>(vec_id, y): the row of update k; scores by its inner products with earlier rows, as in the dual form."""
    parts = ["p AS (SELECT vec_id, embedding::DOUBLE[] AS x, if(label >= 5, 1.0, -1.0)::DOUBLE AS y FROM embeddings)"]
    for k in range(updates):
        past = " + ".join(f"(u{j}.y * (list_dot_product(p.x, u{j}.x) + 1))" for j in range(k)) or "0"
        tables = ", ".join(["p", *[f"u{j}" for j in range(k)]])
        parts.append(f"u{k} AS (SELECT p.* FROM {tables} WHERE p.y * ({past}) <= 0 ORDER BY p.vec_id LIMIT 1)")
    rows = " UNION ALL ".join(f"SELECT vec_id FROM u{k}" for k in range(updates))
    return with_(*parts) + f" SELECT vec_id, count(*)::DOUBLE AS alpha FROM ({rows}) GROUP BY vec_id"


SQL["perceptron_dual"] = dual(S.UPDATES)


DUAL_TO_THE_END = f"""
WITH RECURSIVE per_order AS (
  SELECT l_orderkey, max(l_quantity) - 25 AS x1, round(max(l_discount) * 100) - 5 AS x2, round(max(l_tax) * 100) - 4 AS x3 FROM lineitem GROUP BY l_orderkey),
p AS MATERIALIZED (  -- of equal rows only the first is ever taken
  SELECT min(l_orderkey) AS id, x1, x2, x3, if({S.PLANE[0]} * x1 + {S.PLANE[1]} * x2 + {S.PLANE[2]} * x3 + {S.PLANE[3]} > 0, 1.0, -1.0)::DOUBLE AS y
  FROM per_order GROUP BY x1, x2, x3),
steps AS (
  SELECT 0 AS k, 0::BIGINT AS id, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS b
  UNION ALL
  SELECT k + 1, r.id, w1 + r.y * r.x1, w2 + r.y * r.x2, w3 + r.y * r.x3, b + r.y
  FROM (SELECT any_value(s) AS s, arg_min(p, p.id) AS r FROM steps s, p WHERE p.y * (p.x1 * s.w1 + p.x2 * s.w2 + p.x3 * s.w3 + s.b) <= 0 HAVING count(*) > 0) t(s, r),
    LATERAL (SELECT s.k AS k, s.w1 AS w1, s.w2 AS w2, s.w3 AS w3, s.b AS b))
SELECT id AS l_orderkey, count(*)::DOUBLE AS alpha, true AS {{}} FROM steps WHERE k > 0 GROUP BY id"""
SQL["perceptron_dual_converged"] = DUAL_TO_THE_END.format("converged")
SQL["perceptron_dual_replayed"] = DUAL_TO_THE_END.format("few_passes")


def hinge(steps):
    parts = [LONG, "w0 AS (SELECT unnest(range(65)) AS f, 0.0::DOUBLE AS w)", "cnt AS (SELECT count(*)::DOUBLE AS n FROM ids)"]
    for k in range(steps):
        rate = 0.1 / (1.0 + 1e-2 * k)
        parts.append(f"""
z{k} AS (SELECT vec_id, sum(v * w) AS z FROM lx JOIN w{k} USING (f) GROUP BY ALL),
m{k} AS (SELECT vec_id, 2 * up - 1 AS y FROM z{k} JOIN ids USING (vec_id) WHERE (2 * up - 1) * z < 1),
g{k} AS (SELECT f, sum(v * y) AS g FROM lx JOIN m{k} USING (vec_id) GROUP BY f),
w{k + 1} AS (SELECT f, w * if(f = 64, 1, 1 - {num(rate)} / (n * {num(S.SVM_C)})) + {num(rate)} * coalesce(g, 0) / n AS w
  FROM w{k} LEFT JOIN g{k} USING (f), cnt)""")
    return with_(*parts) + f" SELECT f::INTEGER AS feature, {r0('w', 7, 'weight')} FROM w{steps}"


SQL["svm_linear"] = hinge(S.STEPS)


# ---- maximum entropy ----

MAXENT_BASE = (words(2, ", lang"), """
cls AS (SELECT DISTINCT lang AS label FROM documents),
vocab AS (SELECT DISTINCT token FROM words),
nd AS (SELECT count(*)::DOUBLE AS n_docs FROM documents),
emp AS (SELECT label, token, coalesce(sum(n), 0) / any_value(n_docs) AS e FROM cls CROSS JOIN vocab CROSS JOIN nd
  LEFT JOIN words ON words.token = vocab.token AND words.lang = cls.label GROUP BY label, vocab.token AS token)""")
MAXENT_BASE = (MAXENT_BASE[0], MAXENT_BASE[1].replace("SELECT label, token, coalesce", "SELECT label, vocab.token AS token, coalesce")
               .replace("GROUP BY label, vocab.token AS token", "GROUP BY label, vocab.token"))
SQL["maxent_expectations"] = with_(*MAXENT_BASE) + f" SELECT token, label, {r0('e', 8, 'expectation')} FROM emp"


def scaling(steps):
    parts = [*MAXENT_BASE, "top AS (SELECT max(s)::DOUBLE AS m FROM (SELECT sum(n) AS s FROM words GROUP BY doc_id))",
             "w0 AS (SELECT label, token, 0.0::DOUBLE AS w FROM emp)"]
    for k in range(steps):
        parts.append(f"""
z{k} AS MATERIALIZED (SELECT doc_id, label, sum(n * w) AS z FROM words JOIN w{k} USING (token) GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT doc_id, label, exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id) AS p FROM z{k}),
x{k} AS MATERIALIZED (SELECT label, token, sum(n * p) / any_value(n_docs) AS ex FROM words JOIN p{k} USING (doc_id), nd GROUP BY label, token),
w{k + 1} AS MATERIALIZED (SELECT label, token, w + (ln(e + 1e-9) - ln(ex + 1e-9)) / m AS w FROM w{k} JOIN emp USING (label, token) JOIN x{k} USING (label, token), top)""")
    parts.append(f"""
part AS (SELECT doc_id, label, sum(n * w) AS s FROM words JOIN w{steps} USING (token) GROUP BY ALL),
sc AS (SELECT d.doc_id, c.label, coalesce(s, 0) AS jll FROM documents d CROSS JOIN cls c
  LEFT JOIN part p ON p.doc_id = d.doc_id AND p.label = c.label)""")
    return with_(*parts)


MAXENT = scaling(2)
SQL["maxent_iis"] = MAXENT + f" SELECT label, token, {r0('w', 9, 'weight')} FROM w2"
SQL["maxent_proba"] = MAXENT + f" SELECT doc_id, label, {r0('exp(jll) / sum(exp(jll)) OVER (PARTITION BY doc_id)', 7, 'proba')} FROM sc"
SQL["maxent_predict"] = MAXENT + _doc_best


#: Iterative scaling to the last of its 200 steps; only the last weights are kept.
WHOLE_MAXENT = with_(MAXENT_BASE[0].replace("words AS (", "words AS MATERIALIZED ("), MAXENT_BASE[1].replace("emp AS (", "emp AS MATERIALIZED ("), """
top AS MATERIALIZED (SELECT max(s)::DOUBLE AS m FROM (SELECT sum(n) AS s FROM words GROUP BY doc_id)),
fit(label, token, w, k) USING KEY (label, token) AS (
  SELECT label, token, 0.0::DOUBLE, 0 FROM emp
  UNION
  SELECT label, token, w + (ln(e + 1e-9) - ln(ex + 1e-9)) / m, k + 1 FROM fit JOIN emp USING (label, token) JOIN (
    SELECT label, token, sum(n * p) / any_value(n_docs) AS ex FROM words JOIN (
      SELECT doc_id, label, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY doc_id) AS p FROM (
        SELECT *, max(z) OVER (PARTITION BY doc_id) AS top FROM (
          SELECT doc_id, label, sum(n * w) AS z FROM words JOIN fit USING (token) GROUP BY ALL))) USING (doc_id), nd GROUP BY label, token) USING (label, token), top
  WHERE k < 200),
part AS (SELECT doc_id, label, sum(n * w) AS s FROM words JOIN fit USING (token) GROUP BY ALL),
sc AS (SELECT d.doc_id, c.label, coalesce(s, 0) AS jll FROM documents d CROSS JOIN cls c
  LEFT JOIN part p ON p.doc_id = d.doc_id AND p.label = c.label)""")


def newton(steps):
    """Steepest descent first, then one pair of step and change of the gradient; sizes 2^4 to 2^-16, least loss among those that fall enough."""
    def gradient(k):
        return f"""
p{k} AS MATERIALIZED (SELECT doc_id, label, exp(s - max(s) OVER o) / sum(exp(s - top)) OVER o AS p
  FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM s{k}) WINDOW o AS (PARTITION BY doc_id)),
g{k} AS MATERIALIZED (SELECT label, token, sum(n * (p - if(label = lang, 1, 0))) / any_value(n_docs) AS g
  FROM words JOIN p{k} USING (doc_id), nd GROUP BY label, token)"""

    parts = [MAXENT_BASE[0], """
cls AS (SELECT DISTINCT lang AS label FROM documents),
nd AS (SELECT count(*)::DOUBLE AS n_docs FROM documents),
sizes AS (SELECT pow(2.0, unnest(range(-16, 5)))::DOUBLE AS h),
s0 AS MATERIALIZED (SELECT doc_id, label, lang, 0.0::DOUBLE AS s FROM documents, cls)""", gradient(0), "w0 AS (SELECT label, token, 0.0::DOUBLE AS w FROM g0)"]
    for k in range(steps):
        if k == 0:
            parts.append("d0 AS MATERIALIZED (SELECT label, token, -g AS d FROM g0)")
        else:
            parts.append(f"""
q{k} AS MATERIALIZED (SELECT label, token, b.g, b.g - a.g AS y, h * d AS s FROM g{k} b JOIN g{k - 1} a USING (label, token) JOIN d{k - 1} USING (label, token), h{k - 1}),
r{k} AS (SELECT sum(s * y) AS sy, sum(y * y) AS yy, sum(s * g) / sum(s * y) AS a FROM q{k}),
t{k}b AS (SELECT any_value(a) AS a, any_value(sy / yy) AS scale, sum(y * (g - a * y)) * any_value(sy / yy) / any_value(sy) AS b FROM q{k}, r{k}),
d{k} AS MATERIALIZED (SELECT label, token, -(scale * (g - a * y) + s * (a - b)) AS d FROM q{k}, t{k}b)""")
        parts.append(f"""
t{k} AS MATERIALIZED (SELECT z.doc_id, z.label, z.lang, z.s, coalesce(x.t, 0) AS t FROM s{k} z LEFT JOIN (
  SELECT doc_id, label, sum(n * d) AS t FROM words JOIN d{k} USING (token) GROUP BY ALL) x ON x.doc_id = z.doc_id AND x.label = z.label),
f{k} AS MATERIALIZED (SELECT h, avg(l) AS f FROM (
  SELECT h, doc_id, max(top) + ln(sum(exp(z - top))) - sum(z) FILTER (label = lang) AS l FROM (
    SELECT h, doc_id, label, lang, s + h * t AS z, max(s + h * t) OVER (PARTITION BY doc_id, h) AS top FROM t{k}, (SELECT h FROM sizes UNION ALL SELECT 0.0)) GROUP BY h, doc_id) GROUP BY h),
h{k} AS MATERIALIZED (SELECT h FROM f{k}, (SELECT f AS f0 FROM f{k} WHERE h = 0), (SELECT sum(g * d) AS slope FROM g{k} JOIN d{k} USING (label, token))
  WHERE h > 0 AND f <= f0 + 1e-4 * h * slope ORDER BY f, h DESC LIMIT 1),
s{k + 1} AS MATERIALIZED (SELECT doc_id, label, lang, s + h * t AS s FROM t{k}, h{k}),
w{k + 1} AS MATERIALIZED (SELECT label, token, w + h * d AS w FROM w{k} JOIN d{k} USING (label, token), h{k})""")
        if k + 1 < steps:
            parts.append(gradient(k + 1))
    return with_(*parts) + f" SELECT label, token, {r0('w', 6, 'weight')} FROM w{steps}"


SQL["maxent_newton"] = SQL["maxent_newton_salted"] = newton(2)
SQL["maxent_newton_converged"] = "SELECT count(*) AS n, true AS converged, true AS small_gradient, true AS falling, true AS fits FROM documents"


# ---- trees as node tables: a full tree on one feature has a leaf for each of its values, or several of equal mean ----

SQL["tree_table_full"] = f"SELECT {KEYS}, l_extendedprice, {r0('avg(l_quantity) OVER (PARTITION BY l_extendedprice)', 8, 'prediction')} FROM lineitem"
SQL["tree_table_costs"] = f"""
WITH a AS (SELECT l_quantity AS y, avg(l_quantity) OVER () AS m, avg(l_quantity) OVER (PARTITION BY l_extendedprice) AS p FROM lineitem)
SELECT {r0('sum((y - m) * (y - m))', 2, 'loss')}, {r0('sum((y - p) * (y - p))', 2, 'cost')} FROM a"""
SQL["tree_table_predict"] = SQL["tree_regress_predict"]
SQL["tree_table_classify"] = SQL["tree_classify_predict"]


def newton_leaves(rounds):
    parts = ["t0 AS (SELECT l_orderkey, l_linenumber, l_extendedprice, y, avg(y) OVER () AS f FROM (SELECT *, if(l_linestatus = 'O', 1.0, -1.0)::DOUBLE AS y FROM lineitem))"]
    for k in range(rounds):
        parts.append(f"""
r{k} AS (SELECT *, y / (1 + exp(y * f)) AS r FROM t{k}),
t{k + 1} AS (SELECT l_orderkey, l_linenumber, l_extendedprice, y, f + {num(S.GBDT_RATE)} * sum(r) OVER p / (sum(abs(r) * (1 - abs(r))) OVER p + 1e-9) AS f
  FROM r{k} WINDOW p AS (PARTITION BY l_extendedprice))""")
    return with_(*parts) + f" SELECT {KEYS}, l_extendedprice, {r0('f', 6, 'score')} FROM t{rounds}"


SQL["gbdt_full"] = newton_leaves(2)


# ---- kernels ----

SUPPORT = f"""
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
sv AS (SELECT vec_id AS sv_id, x AS s, if(label >= 5, 1.0, -1.0)::DOUBLE AS y, {num(S.SV_ALPHA)} AS alpha FROM e
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(x, x), 9), vec_id) = 1)"""
RBF = f"exp(-pow(list_distance(x, s), 2) / (2 * {num(S.SIGMA)}))"


def scored(kernel):
    return with_(SUPPORT, f"""
sc AS (SELECT vec_id, if(any_value(label) >= 5, 1.0, -1.0)::DOUBLE AS y, sum(alpha * sv.y * {kernel}) + {num(S.SV_B)} AS score
  FROM e, sv GROUP BY vec_id)""")


SQL["kernel_pairs"] = with_(SUPPORT) + f" SELECT vec_id, sv_id, {r0(RBF, 8, 'kernel')} FROM e, sv"
SQL["svm_decision"] = scored(RBF) + f" SELECT vec_id, y, {r0('score', 7, 'score')} FROM sc"
SQL["svm_decision_linear"] = scored("list_dot_product(x, s)") + f" SELECT vec_id, y, {r0('score', 7, 'score')} FROM sc"
SQL["svm_predict"] = scored(RBF) + " SELECT vec_id, if(score >= 0, 1, 0)::INTEGER AS prediction FROM sc"
SQL["svm_kkt"] = scored(RBF) + f""",
k AS (SELECT sc.*, coalesce(alpha, 0.0::DOUBLE) AS alpha, score - sc.y AS err FROM sc LEFT JOIN sv ON sv_id = vec_id)
SELECT vec_id, y, {r0('score', 7, 'score')}, alpha, {r0('err', 7, 'error')} FROM k
WHERE (y * err < -1e-3 AND alpha < 1) OR (y * err > 1e-3 AND alpha > 0)"""
SQL["svm_weights"] = with_(SUPPORT) + f"""
SELECT (i - 1)::INTEGER AS feature, {r0('sum(alpha * y * s[i])', 7, 'weight')} FROM (SELECT *, unnest(range(1, 65)) AS i FROM sv) GROUP BY i"""


SQL["svm_dual_linear"] = SQL["svm_dual_rbf"] = """
SELECT count(*) AS n, true AS converged, true AS feasible, true AS same_value, true AS small_gap FROM embeddings"""
SQL["svm_dual_kkt"] = "SELECT count(*) AS n, 0::BIGINT AS broken FROM embeddings"
SQL["svm_dual_weights"] = "SELECT unnest(range(64))::INTEGER AS feature, 0.0::DOUBLE AS off"


# ---- mixtures ----

def coins(steps):
    a, b = S.COIN_START
    parts = ["tr AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS heads, count(*) AS n FROM events GROUP BY user_id)",
             f"c0 AS (SELECT {num(a)} AS ta, {num(b)} AS tb)"]
    for k in range(steps):
        parts.append(f"""
r{k} AS (SELECT heads, n, 1 / (1 + exp(heads * ln(tb / ta) + (n - heads) * ln((1 - tb) / (1 - ta)))) AS pa FROM tr, c{k}),
c{k + 1} AS (SELECT sum(pa * heads) / sum(pa * n) AS ta, sum((1 - pa) * heads) / sum((1 - pa) * n) AS tb FROM r{k})""")
    return with_(*parts)


SQL["coin_em"] = coins(S.STEPS) + " UNION ALL ".join(
    f" SELECT {k}::INTEGER AS step, {r0('ta', 8, 'theta_a')}, {r0('tb', 8, 'theta_b')} FROM c{k}" for k in range(S.STEPS + 1))
SQL["coin_responsibilities"] = coins(S.STEPS) + f""",
z AS (SELECT user_id, heads, n, 1 / (1 + exp(heads * ln(tb / ta) + (n - heads) * ln((1 - tb) / (1 - ta)))) AS pa FROM tr, c{S.STEPS})
SELECT user_id, heads::BIGINT AS heads, n, {r0('pa', 7, 'share_a')}, {r0('1 - pa', 7, 'share_b')} FROM z"""


def mixture(steps):
    start = " UNION ALL ".join(f"SELECT {i} AS k, {num(a)} AS a, {num(m)} AS m, {num(v)} AS v" for i, (a, m, v) in enumerate(zip(*S.GMM_START)))
    parts = ["ev AS (SELECT event_id, value AS x FROM events)", f"c0 AS ({start})"]
    for k in range(steps + 1):
        parts.append(f"""
d{k} AS (SELECT event_id, x, k, a / sqrt(2 * pi() * v) * (exp(-(x - m) * (x - m) / (2 * v)) + 1e-9) AS d FROM ev, c{k}),
r{k} AS (SELECT event_id, x, k, d / sum(d) OVER (PARTITION BY event_id) AS g FROM d{k}),
m{k} AS (SELECT k, sum(g * x) / sum(g) AS m, sum(g) / count(*) AS a FROM r{k} GROUP BY k),
c{k + 1} AS (SELECT r.k, any_value(a) AS a, any_value(m) AS m, sum(g * (x - m) * (x - m)) / sum(g) AS v FROM r{k} r JOIN m{k} USING (k) GROUP BY r.k)""")
    return with_(*parts)


SQL["gmm_fit"] = mixture(S.STEPS) + f"""
SELECT k::INTEGER AS component, {r0('a', 8, 'alpha')}, {r0('m', 6, 'mu')}, {r0('v', 4, 'sigma_square')} FROM c{S.STEPS}"""
SQL["gmm_responsibilities"] = mixture(S.STEPS) + f"""
SELECT event_id, k::INTEGER AS component, {r0('g', 7, 'responsibility')} FROM r{S.STEPS}"""


# ---- sequences: recursion over time on unscaled probabilities ----

_codes = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(S.SYMBOLS))
_states = range(len(S.HMM_START))


def emit(i, o="o"):
    return f"([{', '.join(repr(v) for v in S.HMM_EMIT[i])}]::DOUBLE[])[{o} + 1]"


OBS = f"""
obs AS (SELECT user_id, event_id, CASE event_type {_codes} END AS o, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS len,
  lead(CASE event_type {_codes} END) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
ALPHA = f"""
fw AS (SELECT user_id, event_id, t, o, {', '.join(f'{num(S.HMM_START[i])} * {emit(i)} AS a{i}' for i in _states)} FROM obs WHERE t = 1
  UNION ALL SELECT n.user_id, n.event_id, n.t, n.o,
  {', '.join('(' + ' + '.join(f'a{i} * {num(S.HMM_TRANS[i][j])}' for i in _states) + f') * {emit(j, "n.o")}' for j in _states)}
  FROM fw JOIN obs n ON n.user_id = fw.user_id AND n.t = fw.t + 1)"""
BETA = f"""
bw AS (SELECT user_id, event_id, t, o, {', '.join(f'1.0::DOUBLE AS b{i}' for i in _states)} FROM obs WHERE t = len
  UNION ALL SELECT n.user_id, n.event_id, n.t, n.o,
  {', '.join(' + '.join(f'{num(S.HMM_TRANS[i][j])} * {emit(j, "bw.o")} * b{j}' for j in _states) for i in _states)}
  FROM bw JOIN obs n ON n.user_id = bw.user_id AND n.t = bw.t - 1)"""


def per_state(src, col, name):
    return " UNION ALL ".join(f" SELECT user_id, event_id, {i}::INTEGER AS state, {r0(f'ln({col}{i})', 6, name)} FROM {src}" for i in _states)


SQL["hmm_forward"] = with_(OBS, ALPHA) + per_state("fw", "a", "log_alpha")
SQL["hmm_backward"] = with_(OBS, BETA) + per_state("bw", "b", "log_beta")
SQL["hmm_likelihood"] = with_(OBS, ALPHA, BETA) + f"""
SELECT f.user_id, {r0('ln(' + ' + '.join(f'a{i}' for i in _states) + ')', 6, 'forward')},
  {r0('ln(' + ' + '.join(f'{num(S.HMM_START[i])} * {emit(i, "b.o")} * b{i}' for i in _states) + ')', 6, 'backward')}
FROM fw f JOIN obs USING (user_id, event_id) JOIN bw b ON b.user_id = f.user_id AND b.t = 1 WHERE f.t = len"""

_gamma = ", ".join(f"a{i} * b{i} / (" + " + ".join(f"a{k} * b{k}" for k in _states) + f") AS g{i}" for i in _states)
_pairs = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, a{i} * {num(S.HMM_TRANS[i][j])} * {emit(j, 'n.o')} * b{j} / ("
    + " + ".join(f"a{k} * {num(S.HMM_TRANS[k][m])} * {emit(m, 'n.o')} * b{m}" for k in _states for m in _states)
    + ") AS xi FROM fw f JOIN bw n ON n.user_id = f.user_id AND n.t = f.t + 1" for i in _states for j in _states)
_gstates = " UNION ALL ".join(f"SELECT {i} AS i, t, o, g{i} AS g FROM gam" for i in _states)
SQL["hmm_baum_welch"] = with_(OBS, ALPHA, BETA, f"""
gam AS (SELECT f.t, f.o, {_gamma} FROM fw f JOIN bw b USING (user_id, event_id)),
gs AS ({_gstates}), xs AS (SELECT i, j, sum(xi) AS xi FROM ({_pairs}) GROUP BY ALL)""") + f"""
SELECT 'start' AS kind, -1::INTEGER AS i, i::INTEGER AS j, {r0('sum(g) / (SELECT count(DISTINCT user_id) FROM events)', 8, 'p')}
FROM gs WHERE t = 1 GROUP BY i
UNION ALL SELECT 'trans', i::INTEGER, j::INTEGER, round(xi / sum(xi) OVER (PARTITION BY i), 8) + 0.0 FROM xs
UNION ALL SELECT 'emit', i::INTEGER, o::INTEGER, round(sum(g) / sum(sum(g)) OVER (PARTITION BY i), 8) + 0.0 FROM gs GROUP BY i, o"""


def _came(j):
    return "[" + ", ".join(f"round(d{i} + ln({num(S.HMM_TRANS[i][j])}), 9)" for i in _states) + "]"


SQL["hmm_viterbi"] = with_(OBS, f"""
vt AS (SELECT user_id, event_id, t, o, {', '.join(f'ln({num(S.HMM_START[i])} * {emit(i)}) AS d{i}' for i in _states)},
    {', '.join(f'0::BIGINT AS k{i}' for i in _states)} FROM obs WHERE t = 1
  UNION ALL SELECT n.user_id, n.event_id, n.t, n.o,
    {', '.join('greatest(' + ', '.join(f'd{i} + ln({num(S.HMM_TRANS[i][j])})' for i in _states) + f') + ln({emit(j, "n.o")})' for j in _states)},
    {', '.join(f'list_position({_came(j)}, list_max({_came(j)}))::BIGINT - 1' for j in _states)}
  FROM vt JOIN obs n ON n.user_id = vt.user_id AND n.t = vt.t + 1),
tr AS (SELECT vt.user_id, vt.event_id, vt.t, list_position([{', '.join(f'round(d{i}, 9)' for i in _states)}],
      list_max([{', '.join(f'round(d{i}, 9)' for i in _states)}]))::BIGINT - 1 AS state, [k0, k1, k2] AS k
    FROM vt JOIN obs USING (user_id, event_id) WHERE vt.t = len
  UNION ALL SELECT p.user_id, p.event_id, p.t, tr.k[tr.state + 1], [p.k0, p.k1, p.k2] FROM tr JOIN vt p ON p.user_id = tr.user_id AND p.t = tr.t - 1)""") + """
SELECT user_id, event_id, state::INTEGER AS state FROM tr"""


# ---- whole fits, and the other side of each switch that depends on the size ----

# A tree that grows until it is pure or cannot be improved gives each distinct value of its one feature the mean of its rows.
SQL["tree_regress_full"] = "SELECT s_suppkey, round(avg(s_nationkey) OVER (PARTITION BY s_acctbal), 8) AS prediction FROM supplier"
SQL["tree_regress_wide"] = """
SELECT s_suppkey, round(avg(power(10.0::DOUBLE, s_suppkey % 10) + s_nationkey) OVER (PARTITION BY s_acctbal), 4) AS prediction FROM supplier"""
SQL["tree_classify_full"] = """
WITH c AS (SELECT s_acctbal, s_nationkey % 3 AS third, count(*) AS n FROM supplier GROUP BY ALL),
best AS (SELECT s_acctbal, third AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY s_acctbal ORDER BY n DESC, third) = 1)
SELECT s_suppkey, prediction FROM supplier JOIN best USING (s_acctbal)"""
SQL["split_by_null_key"] = f"""
SELECT {KEYS}, CASE WHEN l_orderkey % 7 <> 0 AND (l_orderkey % 10) = 0 THEN 'held' ELSE 'train' END AS part FROM lineitem"""
SQL["pca_centre"] = "SELECT count(*) AS n, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS \"cross\" FROM embeddings"
SQL["pca_wide"] = "SELECT count(*) AS n, true AS converged, true AS agrees FROM embeddings"
SQL["pca_wide_words"] = "SELECT count(*) AS n, true AS converged, true AS centred, true AS uncorrelated, true AS variances FROM documents"
for _name, _same in (("best_split_bucketed", "best_split_continuous"), ("price_roc_bucketed", "price_roc"), ("boosted_trees_uncollapsed", "boosted_trees"),
                     ("svm_decision_tiled", "svm_decision"), ("hmm_forward_split", "hmm_forward"), ("hmm_backward_split", "hmm_backward"),
                     ("hmm_baum_welch_split", "hmm_baum_welch"), ("hmm_viterbi_split", "hmm_viterbi")):
    SQL[_name] = SQL[_same]


def emit_not(symbol, i, o="o"):
    return f"([{', '.join(repr(0.0 if s == symbol else v) for s, v in zip(S.SYMBOLS, S.HMM_EMIT[i]))}]::DOUBLE[])[{o} + 1]"


SQL["hmm_impossible"] = f"""
WITH RECURSIVE days AS (SELECT user_id * 1000 + dayofyear(ts) AS day, ts, event_id, CASE event_type {_codes} END AS o FROM events),
obs AS (SELECT day, o, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY day) AS len FROM days),
fw AS (SELECT day, t, len, {', '.join(f'{num(S.HMM_START[i])} * {emit_not("error", i)} AS a{i}' for i in _states)} FROM obs WHERE t = 1
  UNION ALL SELECT n.day, n.t, n.len,
  {', '.join('(' + ' + '.join(f'a{i} * {num(S.HMM_TRANS[i][j])}' for i in _states) + f') * {emit_not("error", j, "n.o")}' for j in _states)}
  FROM fw JOIN obs n ON n.day = fw.day AND n.t = fw.t + 1)
SELECT day, CASE WHEN a0 + a1 + a2 > 0 THEN {r0('ln(greatest(a0 + a1 + a2, 1e-300))', 6, 'x').replace(' AS x', '')} ELSE '-inf'::DOUBLE END AS log_likelihood
FROM fw WHERE t = len"""

_pa = "1 / (1 + exp(heads * ln(tb / ta) + (n - heads) * ln((1 - tb) / (1 - ta))))"
SQL["coin_em_converged"] = f"""
WITH RECURSIVE tr AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS heads, count(*) AS n FROM events GROUP BY user_id),
em AS (
  SELECT 0 AS step, {num(S.COIN_START[0])} AS ta, {num(S.COIN_START[1])} AS tb, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step + 1, na, nb, sqrt((na - ta) * (na - ta) + (nb - tb) * (nb - tb))
  FROM (SELECT *, (SELECT sum({_pa} * heads) / sum({_pa} * n) FROM tr) AS na,
               (SELECT sum((1 - {_pa}) * heads) / sum((1 - {_pa}) * n) FROM tr) AS nb FROM em WHERE moved >= 1e-3 AND step < 1000))
SELECT step::INTEGER AS step, {r0('ta', 8, 'theta_a')}, {r0('tb', 8, 'theta_b')}, moved < 1e-3 AS converged FROM em"""


# ---- models written and read again predict as before ----

SQL |= {f"reread_{k}": SQL[v] for k, v in {
    "gnb": "gnb_predict", "mnb": "mnb_predict", "bnb": "bnb_predict", "tree": "tree_classify_predict", "node_tree": "tree_table_predict",
    "stumps": "stump_regress_predict", "adaboost": "adaboost_score", "gbdt": "gbdt_proba", "logistic": "logistic_ovr_predict",
    "perceptron": "perceptron_predict", "coins": "coin_responsibilities", "mixture": "gmm_responsibilities",
    "hmm": "hmm_viterbi"}.items()}
SQL["reread_svm"] = "SELECT count(*) AS n, 0.0::DOUBLE AS off FROM embeddings"
SQL |= {"stream_mnb": SQL["mnb_predict"], "stream_mnb_joined": SQL["mnb_predict"], "stream_bnb": SQL["bnb_predict"]}
SQL["reread_maxent"] = SQL["stream_maxent"] = WHOLE_MAXENT + _doc_best
