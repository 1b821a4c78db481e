"""Hidden Markov models over sequences of any length.

Rows are range-partitioned by (sequence, order), so a sequence holding a large
share of all rows spans many tasks; each task packs its part of a sequence into
runs. A run acts on the state distribution as one S x S matrix, so the vectors
at the run borders follow from a small table of such matrices, and the second
pass over the runs then works on each alone. Sequences inside one run, the
usual case, need no border step.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulearn.functions.batches import summed
from tabulearn.functions.columns import label_array
from tabulearn.functions.tables import BROADCAST_ROWS
from tabulearn.session import checkpointed

PADDED_LIMIT = 2_000_000
TIE = 1e-9


@dataclass(frozen=True)
class HmmParams:
    symbols: tuple
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of(symbols, start, trans, emit):
        p = HmmParams(tuple(symbols), np.array(start, float), np.array(trans, float), np.array(emit, float))
        s = len(p.start)
        if p.trans.shape != (s, s) or p.emit.shape != (s, len(p.symbols)):
            raise ValueError("parameter shapes disagree")
        return p

    def table(self, spark) -> DataFrame:
        """(kind, i, j, p): start has no i; emit has the symbol position as j."""
        rows = [("start", None, i, float(v)) for i, v in enumerate(self.start)]
        rows += [("trans", i, j, float(v)) for i, r in enumerate(self.trans) for j, v in enumerate(r)]
        rows += [("emit", i, j, float(v)) for i, r in enumerate(self.emit) for j, v in enumerate(r)]
        return spark.createDataFrame(rows, "kind string, i int, j int, p double")


@dataclass
class Runs:
    """Packed sequences: one row per run with the symbol codes and row ids in order."""

    table: DataFrame  # seq, run, obs array<int>, rid array<long>
    split: DataFrame  # sequences that span several runs; at most two per partition
    split_runs: int  # their number of runs, at most about twice the number of partitions
    symbols: tuple

    @property
    def has_split(self) -> bool:
        return self.split_runs > 0

    def small(self, table: DataFrame) -> DataFrame:
        """A table with at most one row per split run: copied to the tasks while that is few."""
        return F.broadcast(table) if self.split_runs <= BROADCAST_ROWS else table


def pack_sequences(df: DataFrame, seq: str, order: list, row_id: str, obs: str, symbols, rows_per_partition: int = 1 << 20,
                   max_run: int = 1 << 20, partitions: int = None) -> Runs:
    """Sort each sequence by ``order`` and pack it into runs; written out once.

    ``row_id`` (a number) names each row in the results.
    """
    symbols = tuple(symbols)
    code = F.array_position(label_array(symbols), F.col(obs)).cast("int") - 1
    code = F.when(code >= 0, code).otherwise(F.raise_error(F.lit(f"symbol of {obs} outside the dictionary")).cast("int"))
    rows = df.select(F.col(seq).alias("seq"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                     code.alias("obs"), F.col(row_id).cast("long").alias("rid"))
    if partitions is None:
        partitions = max(-(-df.count() // rows_per_partition), df.sparkSession.sparkContext.defaultParallelism)
    keys = ["seq", *[f"_o{i}" for i in range(len(order))]]
    ordered = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("seq", "obs", "rid")
    schema = T.StructType([
        ordered.schema["seq"], T.StructField("run", T.LongType()), T.StructField("obs", T.ArrayType(T.IntegerType())),
        T.StructField("rid", T.ArrayType(T.LongType()))])
    table = checkpointed(ordered.mapInPandas(_packer(max_run), schema))
    split = checkpointed(table.groupBy("seq").agg(F.count("*").alias("runs")).filter(F.col("runs") > 1))
    split_runs = split.agg(F.sum("runs")).first()[0] or 0
    return Runs(table, split.select("seq"), split_runs, symbols)


def _packer(max_run):
    def pack(batches):
        base = TaskContext.get().partitionId() << 32
        number, seq, obs, rid, size = 0, None, [], [], 0

        def flush():
            return base + number, seq, np.concatenate(obs), np.concatenate(rid)

        for pdf in batches:
            out = []
            values = pdf["seq"].to_numpy()
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else []
            for a, b in zip(starts, np.r_[starts[1:], len(values)].astype(int) if len(values) else []):
                for c in range(a, b, max_run):
                    d = min(c + max_run, b)
                    if size and (values[c] != seq or size + d - c > max_run):
                        out.append(flush())
                        number, obs, rid, size = number + 1, [], [], 0
                    seq = values[c]
                    obs.append(pdf["obs"].to_numpy()[c:d])
                    rid.append(pdf["rid"].to_numpy()[c:d])
                    size += d - c
            if out:
                yield pd.DataFrame(
                    {"seq": [o[1] for o in out], "run": [o[0] for o in out], "obs": [o[2] for o in out],
                     "rid": [o[3] for o in out]})
        if size:
            o = flush()
            yield pd.DataFrame({"seq": [o[1]], "run": [o[0]], "obs": [o[2]], "rid": [o[3]]})

    return pack


def _groups(lengths):
    """Indices of runs to work on together, padded to the longest of each group."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        take = max(1, PADDED_LIMIT // max(1, longest))
        yield order[at:at + take]
        at += take


def _padded(obs):
    lengths = np.array([len(o) for o in obs])
    out = np.zeros((len(obs), lengths.max()), dtype=int)
    for i, o in enumerate(obs):
        out[i, :len(o)] = o
    return out, lengths


def _border(values, states):
    """Border vectors as an array, with a mask of the runs that have one."""
    has = np.array([v is not None for v in values])
    out = np.ones((len(values), states))
    for i in np.flatnonzero(has):
        out[i] = values[i]
    return out, has


def _scaled(v, axis=-1):
    """``v`` over its sum, and the log of that sum; nothing possible stays all zero, with log -inf."""
    c = v.sum(axis=axis, keepdims=True)
    with np.errstate(divide="ignore"):
        return v / np.where(c > 0, c, 1.0), np.log(np.squeeze(c, axis=axis))


def forward(p, obs, entry):
    """Scaled forward vectors and log scales per step; ``entry`` is the vector before the run.

    From a step on that the parameters make impossible, the vectors are zero and the log scales -inf.
    """
    codes, lengths = _padded(obs)
    first, has = _border(entry, len(p.start))
    alpha = np.zeros((*codes.shape, len(p.start)))
    scale = np.zeros(codes.shape)
    for t in range(codes.shape[1]):
        live = lengths > t
        prior = np.where(has[live, None], first[live] @ p.trans, p.start) if t == 0 else alpha[live, t - 1] @ p.trans
        alpha[live, t], scale[live, t] = _scaled(prior * p.emit[:, codes[live, t]].T)
    return codes, lengths, alpha, scale


def backward(p, codes, lengths, exit_):
    """Scaled backward vectors and the log of their scale; ``exit_`` is the vector at the run's end."""
    last, has = _border(exit_, len(p.start))
    beta = np.ones((*codes.shape, len(p.start)))
    logs = np.zeros(codes.shape)
    for t in range(codes.shape[1] - 1, -1, -1):
        ends = lengths == t + 1
        beta[ends, t] = np.where(has[ends, None], last[ends], 1.0)
        live = lengths > t + 1
        if live.any():
            beta[live, t], c = _scaled((p.emit[:, codes[live, t + 1]].T * beta[live, t + 1]) @ p.trans.T)
            logs[live, t] = logs[live, t + 1] + c
    return beta, logs


def run_matrix(p, obs):
    """Scaled product of the steps after the first, and its log scale."""
    m, log = np.eye(len(p.start)), 0.0
    for o in obs[1:]:
        m, c = _scaled(((m @ p.trans) * p.emit[:, o]).ravel())
        m, log = m.reshape(len(p.start), -1), log + c
    return m, log


def best_matrix(p, obs):
    """Best log score between the first step of a run and its last, per pair of states."""
    with np.errstate(divide="ignore"):
        a, b = np.log(p.trans), np.log(p.emit)
    m = np.where(np.eye(len(p.start), dtype=bool), 0.0, -np.inf)
    for o in obs[1:]:
        m = (m[:, :, None] + a[None]).max(1) + b[:, o]
    return m


def _seq_field(df):
    return T.StructField("seq", df.schema["seq"].dataType)


def _schema(df, fields):
    return T.StructType([_seq_field(df), T.StructField("run", T.LongType()), *fields])


DOUBLES = T.ArrayType(T.DoubleType())


def _borders(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, run, entry, entry_log, exit, exit_log) for the split sequences.

    A task sees one small matrix per run of a sequence, never its rows.
    """
    part = runs.table.select("seq", "run", "obs").join(runs.small(runs.split), "seq", "left_semi")
    fields = [T.StructField("first", T.IntegerType()), T.StructField("m", DOUBLES), T.StructField("log", T.DoubleType())]

    def matrices(batches):
        for pdf in batches:
            found = [run_matrix(p, o) for o in pdf["obs"]]
            yield pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "first": [int(o[0]) for o in pdf["obs"]],
                                "m": [m.ravel() for m, _ in found], "log": [x for _, x in found]})

    s = len(p.start)
    out = [T.StructField(n, t) for n, t in
           (("entry", DOUBLES), ("entry_log", T.DoubleType()), ("exit", DOUBLES), ("exit_log", T.DoubleType()))]

    def chain(pdf):
        pdf = pdf.sort_values("run").reset_index(drop=True)
        ms = [np.array(m).reshape(s, s) for m in pdf["m"]]
        entry, entry_log, vec, log = [], [], None, 0.0
        for first, m, scale in zip(pdf["first"], ms, pdf["log"]):
            entry.append(vec)
            entry_log.append(log)
            vec, c = _scaled((p.start if vec is None else vec @ p.trans) * p.emit[:, first] @ m)
            log = log + scale + c
        leave, leave_log, vec, log = [], [], np.ones(s), 0.0
        for i in range(len(ms) - 1, -1, -1):
            leave.append(None if i == len(ms) - 1 else vec)
            leave_log.append(log)
            vec, c = _scaled(p.trans @ (p.emit[:, pdf["first"][i]] * (ms[i] @ vec)))
            log = log + pdf["log"][i] + c
        return pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "entry": entry, "entry_log": entry_log,
                             "exit": leave[::-1], "exit_log": leave_log[::-1]})

    return part.mapInPandas(matrices, _schema(runs.table, fields)).groupBy("seq").applyInPandas(chain, _schema(runs.table, out))


def _with_borders(runs: Runs, p: HmmParams) -> DataFrame:
    if not runs.has_split:
        none = F.lit(None).cast("array<double>")
        return runs.table.withColumns({"entry": none, "entry_log": F.lit(0.0), "exit": none, "exit_log": F.lit(0.0)})
    joined = runs.table.join(runs.small(_borders(runs, p)), ["seq", "run"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("entry_log", "exit_log")})


def _sweep(runs, p, emit_rows, schema):
    """Run forward and backward over the runs and emit one table per group of runs."""
    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for idx in _groups([len(o) for o in pdf["obs"]]):
                g = pdf.iloc[idx].reset_index(drop=True)
                codes, lengths, alpha, scale = forward(p, list(g["obs"]), list(g["entry"]))
                yield emit_rows(g, codes, lengths, alpha, scale)

    return _with_borders(runs, p).mapInPandas(run, schema)


def _long(g, lengths, logs):
    """(seq, rid, state, value) rows of a padded (run, step, state) array."""
    s = logs.shape[2]
    steps = np.concatenate([logs[i, :n] for i, n in enumerate(lengths)])
    return pd.DataFrame({
        "seq": np.repeat(g["seq"].to_numpy(), lengths * s), "row_id": np.repeat(np.concatenate(list(g["rid"])), s),
        "state": np.tile(np.arange(s, dtype="int32"), int(lengths.sum())), "value": steps.ravel()})


def _long_schema(runs):
    return T.StructType([_seq_field(runs.table), T.StructField("row_id", T.LongType()),
                         T.StructField("state", T.IntegerType()), T.StructField("value", T.DoubleType())])


def forward_table(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, row_id, state, log_alpha)"""
    def rows(g, codes, lengths, alpha, scale):
        with np.errstate(divide="ignore"):
            logs = np.log(alpha) + (scale.cumsum(1) + g["entry_log"].to_numpy()[:, None])[:, :, None]
        return _long(g, lengths, logs)

    return _sweep(runs, p, rows, _long_schema(runs)).withColumnRenamed("value", "log_alpha")


def backward_table(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, row_id, state, log_beta)"""
    def rows(g, codes, lengths, alpha, scale):
        beta, logs = backward(p, codes, lengths, list(g["exit"]))
        with np.errstate(divide="ignore"):
            out = np.log(beta) + (logs + g["exit_log"].to_numpy()[:, None])[:, :, None]
        return _long(g, lengths, out)

    return _sweep(runs, p, rows, _long_schema(runs)).withColumnRenamed("value", "log_beta")


def log_likelihood(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, log_likelihood): the sum of the log scales of all steps, forward."""
    def rows(g, codes, lengths, alpha, scale):
        return pd.DataFrame({"seq": g["seq"], "part": scale.sum(1)})

    schema = T.StructType([_seq_field(runs.table), T.StructField("part", T.DoubleType())])
    return _sweep(runs, p, rows, schema).groupBy("seq").agg(F.sum("part").alias("log_likelihood"))


def backward_log_likelihood(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, log_likelihood) from the backward vectors: sum of start * emit * beta at the first step."""
    def rows(g, codes, lengths, alpha, scale):
        beta, logs = backward(p, codes, lengths, list(g["exit"]))
        first = np.array([e is None for e in g["entry"]])
        like = _scaled(p.start * p.emit[:, codes[:, 0]].T * beta[:, 0])[1] + logs[:, 0] + g["exit_log"].to_numpy()
        return pd.DataFrame({"seq": g["seq"][first], "log_likelihood": like[first]})

    schema = T.StructType([_seq_field(runs.table), T.StructField("log_likelihood", T.DoubleType())])
    return _sweep(runs, p, rows, schema)


def expected_counts(runs: Runs, p: HmmParams) -> dict:
    """Expected starts, transitions and emissions under the parameters, over all sequences."""
    s, v = p.emit.shape
    size = s + s * s + s * v + 1

    def count(pdf):
        start, xi, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, v))
        for idx in _groups([len(o) for o in pdf["obs"]]):
            g = pdf.iloc[idx].reset_index(drop=True)
            codes, lengths, alpha, scale = forward(p, list(g["obs"]), list(g["entry"]))
            beta, _ = backward(p, codes, lengths, list(g["exit"]))
            live = np.arange(codes.shape[1])[None, :] < lengths[:, None]
            gamma = alpha * beta
            total = gamma.sum(2)  # zero all along an impossible sequence, which then counts nothing
            gamma = np.where(live[:, :, None], gamma / np.where(total > 0, total, 1.0)[:, :, None], 0.0)
            for o in range(v):
                emit[:, o] += gamma[(codes == o) & live].sum(0)
            first = np.array([e is None for e in g["entry"]])
            start += gamma[first, 0].sum(0)
            before, has = _border(list(g["entry"]), s)
            # The step into a run belongs to it; the first run of a sequence has none.
            prev = np.concatenate([before[:, None, :], alpha[:, :-1]], axis=1)
            into = live.copy()
            into[:, 0] &= has
            right = p.emit.T[codes[into]] * beta[into]
            pair = prev[into][:, :, None] * p.trans[None] * right[:, None, :]
            total = pair.sum((1, 2), keepdims=True)
            xi += (pair / np.where(total > 0, total, 1.0)).sum(0)
        return np.concatenate([start, xi.ravel(), emit.ravel(), [start.sum()]])

    table = _with_borders(runs, p).select("seq", "obs", "entry", "exit")

    def part(batch):
        return count(batch.to_pandas())

    sums = summed(table, part, size)
    at = np.cumsum([s, s * s, s * v])
    return {"start": sums[:at[0]], "trans": sums[at[0]:at[1]].reshape(s, s), "emit": sums[at[1]:at[2]].reshape(s, v),
            "sequences": sums[-1]}


def hmm_fit(runs: Runs, start: HmmParams, eps: float = 1e-3, max_iter: int = 100):
    """Baum-Welch; returns (parameters, steps, converged)."""
    p, done, step = start, False, 0
    for step in range(1, max_iter + 1):
        c = expected_counts(runs, p)
        if not c["sequences"]:
            raise ValueError("every sequence is impossible under the parameters")
        new = HmmParams(p.symbols, c["start"] / c["sequences"], _rows_to_one(c["trans"], p.trans),
                        _rows_to_one(c["emit"], p.emit))
        moves = [np.linalg.norm(a - b) for a, b in ((new.start, p.start), (new.trans, p.trans), (new.emit, p.emit))]
        p = new
        if max(moves) < eps:
            done = True
            break
    return p, step, done


def _rows_to_one(counts, old):
    total = counts.sum(1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1.0), old)


def random_start(symbols, n_states: int, seed: int = None) -> HmmParams:
    rng = np.random.default_rng(seed)

    def rows(*shape):
        m = rng.random(shape)
        return m / m.sum(-1, keepdims=True)

    return HmmParams(tuple(symbols), rows(n_states), rows(n_states, n_states), rows(n_states, len(symbols)))


def _lowest_best(scores):
    """Lowest index within rounding error of the best, along the last axis."""
    best = scores.max(-1, keepdims=True)
    return (scores >= best - TIE).argmax(-1)


def best_scores(p, obs, entry):
    """Best log score per step and state, and the best previous state of each."""
    with np.errstate(divide="ignore"):
        a, b, pi = np.log(p.trans), np.log(p.emit), np.log(p.start)
    codes, lengths = _padded(obs)
    first, has = _border(entry, len(p.start))
    delta = np.zeros((len(obs), len(p.start)))
    back = np.zeros((*codes.shape, len(p.start)), dtype="int16")
    for t in range(codes.shape[1]):
        live = np.flatnonzero(lengths > t)
        before = first[live] if t == 0 else delta[live]
        steps = (before[:, :, None] + a[None]).transpose(0, 2, 1)
        back[live, t] = _lowest_best(steps)
        d = steps.max(2)
        if t == 0:
            d = np.where(has[live, None], d, pi)
        delta[live] = d + b[:, codes[live, t]].T
    return codes, lengths, delta, back


def _trace(lengths, back, end):
    """States per step from the state at each run's end, and the state before the run."""
    n, width, _ = back.shape
    states = np.zeros((n, width), dtype="int32")
    now = np.array(end, dtype=int)
    for t in range(width - 1, -1, -1):
        live = lengths > t
        states[live, t] = now[live]
        now = np.where(live, back[np.arange(n), t, now], now)
    return states, now


def _path_borders(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, run, entry, end) for split sequences: scores before each run and the state at its end."""
    part = runs.table.select("seq", "run", "obs").join(runs.small(runs.split), "seq", "left_semi")
    with np.errstate(divide="ignore"):
        a, b, pi = np.log(p.trans), np.log(p.emit), np.log(p.start)
    s = len(p.start)

    def matrices(batches):
        for pdf in batches:
            yield pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "first": [int(o[0]) for o in pdf["obs"]],
                                "m": [best_matrix(p, o).ravel() for o in pdf["obs"]]})

    def chain(pdf):
        pdf = pdf.sort_values("run").reset_index(drop=True)
        entry, vec = [], None
        for first, m in zip(pdf["first"], pdf["m"]):
            entry.append(vec)
            head = (pi if vec is None else (vec[:, None] + a).max(0)) + b[:, first]
            vec = (head[:, None] + np.array(m).reshape(s, s)).max(0)
        return pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "entry": entry})

    fields = [T.StructField("first", T.IntegerType()), T.StructField("m", DOUBLES)]
    entries = part.mapInPandas(matrices, _schema(runs.table, fields)).groupBy("seq").applyInPandas(
        chain, _schema(runs.table, [T.StructField("entry", DOUBLES)]))

    def maps(batches):
        for pdf in batches:
            rows = []
            for obs, e in zip(pdf["obs"], pdf["entry"]):
                _, lengths, delta, back = best_scores(p, [obs], [e])
                wide = np.repeat(back, s, axis=0)
                _, before = _trace(np.repeat(lengths, s), wide, np.arange(s))
                rows.append((before, int(_lowest_best(delta)[0])))
            yield pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "entry": pdf["entry"],
                                "before": [r[0] for r in rows], "top": [r[1] for r in rows]})

    def follow(pdf):
        pdf = pdf.sort_values("run").reset_index(drop=True)
        end, now = [], pdf["top"].iloc[-1]
        for before in pdf["before"][::-1]:
            end.append(int(now))
            now = before[now]
        return pd.DataFrame({"seq": pdf["seq"], "run": pdf["run"], "entry": pdf["entry"], "end": end[::-1]})

    mapped = part.join(entries, ["seq", "run"]).mapInPandas(maps, _schema(runs.table, [
        T.StructField("entry", DOUBLES), T.StructField("before", T.ArrayType(T.LongType())), T.StructField("top", T.IntegerType())]))
    return mapped.groupBy("seq").applyInPandas(follow, _schema(runs.table, [
        T.StructField("entry", DOUBLES), T.StructField("end", T.IntegerType())]))


def hmm_decode(runs: Runs, p: HmmParams) -> DataFrame:
    """(seq, row_id, state): the most likely path; the lowest state wins a tie."""
    if runs.has_split:
        table = runs.table.join(runs.small(_path_borders(runs, p)), ["seq", "run"], "left")
    else:
        table = runs.table.withColumns({"entry": F.lit(None).cast("array<double>"), "end": F.lit(None).cast("int")})
    table = table.withColumn("end", F.coalesce("end", F.lit(-1)))

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for idx in _groups([len(o) for o in pdf["obs"]]):
                g = pdf.iloc[idx].reset_index(drop=True)
                _, lengths, delta, back = best_scores(p, list(g["obs"]), list(g["entry"]))
                end = np.where(g["end"].to_numpy() >= 0, g["end"].to_numpy(), _lowest_best(delta))
                states, _ = _trace(lengths, back, end)
                yield pd.DataFrame({
                    "seq": np.repeat(g["seq"].to_numpy(), lengths), "row_id": np.concatenate(list(g["rid"])),
                    "state": np.concatenate([states[i, :n] for i, n in enumerate(lengths)])})

    schema = T.StructType([_seq_field(runs.table), T.StructField("row_id", T.LongType()), T.StructField("state", T.IntegerType())])
    return table.mapInPandas(run, schema)
