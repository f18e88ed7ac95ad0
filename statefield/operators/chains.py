"""Hidden Markov chains over long sequences: products of small matrices, block by block, joined by associative scans.

A sequence is cut into blocks of rows, which are the unit of work: a block's effect on the forward vector is a k x k matrix, the
product of one matrix a row, in the semiring (+, x) for likelihoods and (max, +) for best paths; its effect on the way back
is a map from its last state to the last state of the block before. Both compose associatively, so blocks of blocks are joined
level by level (`scan`), and what each block is entered with is handed down again. A sequence of any length is spread over all
tasks; no task sees more of it than a block, or `FANOUT` matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .latent import CategoricalHMM

#: Rows of a block, and children of a node of the scan.
ROWS, FANOUT = 4096, 64

Parts = list[np.ndarray]


def blocks_of(seqs: DataFrame, rows: int = ROWS) -> DataFrame:
    """seq_id, block (from 0), blocks, dates, obs: runs of at most `rows` rows of a sequence, written. seqs: seq_id, date, C_t.

    Rows are dealt by ranges of sequence and date, so that blocks are cut where the rows are and a long sequence lies in many tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, days, obs, out = None, [], [], []

        def take() -> None:
            d, o = np.concatenate(days), np.concatenate(obs)
            out.extend((seq, d[a : a + rows], o[a : a + rows]) for a in range(0, len(d), rows))
            days.clear()
            obs.clear()

        def given() -> pa.RecordBatch:
            arrays = [pa.array([s for s, _, _ in out], pa.string()), pa.array([d.tolist() for _, d, _ in out], pa.list_(pa.int32())), pa.array([o.tolist() for _, _, o in out], pa.list_(pa.int32()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["seq_id", "days", "obs"])

        for b in batches:
            ids = np.asarray(b.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if days and (ids[a] != seq or sum(map(len, days)) >= 16 * rows):
                    take()
                seq = ids[a]
                days.append(b.column(1).to_numpy()[a:z])
                obs.append(b.column(2).to_numpy()[a:z])
            if len(out) >= 64:
                yield given()
        if days:
            take()
        if out:
            yield given()

    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    dealt = seqs.select(F.col("seq_id").cast("string").alias("seq_id"), day.alias("day"), F.col("C_t").cast("int").alias("c")).repartitionByRange("seq_id", "day").sortWithinPartitions("seq_id", "day")
    found = written(dealt.mapInArrow(cut, "seq_id string, days array<int>, obs array<int>"), "chain-blocks")
    w = Window.partitionBy("seq_id").orderBy("start")
    keys = found.select("seq_id", F.col("days")[0].alias("start"))  # numbers without the rows
    keys = keys.select("seq_id", "start", (F.row_number().over(w) - 1).alias("block"), F.count(F.lit(1)).over(Window.partitionBy("seq_id")).alias("blocks"))
    return found.withColumn("start", F.col("days")[0]).join(keys, ["seq_id", "start"]).select("seq_id", "block", "blocks", "days", "obs")


def scan(nodes: DataFrame, top: DataFrame, up: Callable[[Parts], np.ndarray], down: Callable[[np.ndarray, Parts], Parts], fanout: int = FANOUT) -> DataFrame:
    """seq_id, block, given: what each node is entered with. nodes: seq_id, block, v (a node's effect). top: seq_id, given.

    up: the effect of nodes in a row, as one. down: what each of them is entered with, if all of them are entered with the first
    argument. Effects are joined by `fanout` nodes at a time until one is left of each sequence.
    """
    levels = [nodes]
    most = (nodes.agg(F.max("block")).first()[0] or 0) + 1
    while most > 1:
        above = levels[-1].withColumn("group", F.floor(F.col("block") / fanout).cast("int"))

        def join_up(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("block")
            return pd.DataFrame({"seq_id": [g["seq_id"].iloc[0]], "block": [g["group"].iloc[0]], "v": [up([np.asarray(v) for v in g["v"]]).tolist()]})

        levels.append(written(above.groupBy("seq_id", "group").applyInPandas(join_up, "seq_id string, block int, v array<double>"), "chain-level"))
        most = -(-most // fanout)
    given = top.withColumn("block", F.lit(0))
    for nodes_of in levels[-2::-1]:
        parents = given.select("seq_id", F.col("block").alias("group"), F.col("given").alias("g"))
        children = nodes_of.withColumn("group", F.floor(F.col("block") / fanout).cast("int")).join(parents, ["seq_id", "group"])

        def hand_down(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("block")
            found = down(np.asarray(g["g"].iloc[0]), [np.asarray(v) for v in g["v"]])
            return pd.DataFrame({"seq_id": g["seq_id"], "block": g["block"], "given": [x.tolist() for x in found]})

        given = written(children.groupBy("seq_id", "group").applyInPandas(hand_down, "seq_id string, block int, given array<double>"), "chain-given")
    return given


def _padded(obs: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, cells, lengths): blocks side by side, the longest first."""
    order = np.argsort([-len(o) for o in obs], kind="stable")
    lengths = np.array([len(obs[i]) for i in order], np.int64)
    cells = np.zeros((len(obs), int(lengths.max(initial=0))), np.int64)
    for row, i in enumerate(order):
        cells[row, : len(obs[i])] = obs[i]
    return order, cells, lengths


def _open(lengths: np.ndarray, i: int) -> int:
    """The number of blocks longer than i; lengths fall."""
    return int(np.searchsorted(-lengths, -i, "left"))


_TYPES = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _over_blocks(blocks: DataFrame, columns: list[str], work: Callable[..., Parts], schema: str, most: int = 1 << 18) -> DataFrame:
    """seq_id, block and the columns that work(obs, *columns) returns, some blocks at a time."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = [_TYPES[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            obs = [np.asarray(x.values) for x in b.column(2)]
            step = max(1, most // max(1, max(map(len, obs), default=1)))
            for a in range(0, len(obs), step):
                part = b.slice(a, step)
                found = work(obs[a : a + step], *(part.column(i).to_pylist() for i in range(3, 3 + len(columns))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([np.asarray(x).tolist() for x in f], t) for f, t in zip(found, types))], ["seq_id", "block", *names])

    return blocks.select("seq_id", "block", "obs", *columns).mapInArrow(run, f"seq_id string, block int, {schema}")


def _effects(blocks: DataFrame, model: CategoricalHMM) -> DataFrame:
    """v of each block: the logarithm of its scale, then its matrix in (+, x)."""
    k = len(model.start)

    def work(obs: Parts, number: list[int]) -> Parts:
        order, cells, lengths = _padded(obs)
        m, log = np.tile(np.eye(k), (len(obs), 1, 1)), np.zeros(len(obs))
        first = np.array([number[i] == 0 for i in order])
        for t in range(cells.shape[1]):
            n = _open(lengths, t)
            step = m[:n] @ model.trans
            if t == 0:
                step[first[:n]] = m[:n][first[:n]]
            step *= model.emit.T[cells[:n, t]][:, None, :]
            scale = np.maximum(step.sum((1, 2)), 1e-300)
            m[:n], log[:n] = step / scale[:, None, None], log[:n] + np.log(scale)
        out = [np.empty(0)] * len(obs)
        for row, i in enumerate(order):
            out[i] = np.concatenate([[log[row]], m[row].ravel()])
        return [out]

    return _over_blocks(blocks.withColumn("number", F.col("block")), ["number"], work, "v array<double>")


def _joined_effects(parts: Parts) -> np.ndarray:
    k = int(np.sqrt(len(parts[0]) - 1))
    log, m = 0.0, np.eye(k)
    for v in parts:
        m = m @ v[1:].reshape(k, k)
        scale = max(m.sum(), 1e-300)
        m, log = m / scale, log + v[0] + np.log(scale)
    return np.concatenate([[log], m.ravel()])


def _handed_effects(given: np.ndarray, parts: Parts) -> Parts:
    """given: the logarithm of the scale so far, the forward vector before, the backward vector after."""
    k = (len(given) - 1) // 2
    log, a, b = given[0], given[1 : 1 + k], given[1 + k :]
    ahead, logs = [a], [log]
    for v in parts[:-1]:
        a = a @ v[1:].reshape(k, k)
        scale = max(a.sum(), 1e-300)
        a, log = a / scale, log + v[0] + np.log(scale)
        ahead.append(a)
        logs.append(log)
    behind = [b]
    for v in parts[:0:-1]:
        b = v[1:].reshape(k, k) @ b
        b = b / max(b.sum(), 1e-300)
        behind.append(b)
    return [np.concatenate([[x], f, g]) for x, f, g in zip(logs, ahead, behind[::-1])]


def _entered(blocks: DataFrame, model: CategoricalHMM, fanout: int) -> DataFrame:
    """blocks with given: what each block is entered with, forward and backward."""
    k = len(model.start)
    start = F.array(*(F.lit(float(x)) for x in [0.0, *model.start, *np.full(k, 1 / k)]))
    long = blocks.where("blocks > 1")
    given = scan(written(_effects(long, model), "chain-effects"), long.where("block = 0").select("seq_id", start.alias("given")), _joined_effects, _handed_effects, fanout)
    return blocks.join(given, ["seq_id", "block"], "left").withColumn("given", F.coalesce("given", start))


def expected_counts(blocks: DataFrame, model: CategoricalHMM, fanout: int = FANOUT) -> DataFrame:
    """seq_id, block, log (of its share of the likelihood), first (k), moves (k x k), emits (k x m) of each block.

    blocks: of blocks_of, written. Summed over a sequence they are its log-likelihood and expected counts.
    """
    k, m = model.emit.shape

    def work(obs: Parts, number: list[int], given: list[list[float]]) -> Parts:
        order, cells, lengths = _padded(obs)
        enter = np.array([given[i] for i in order])
        a0, b_end, first = enter[:, 1 : 1 + k], enter[:, 1 + k :], np.array([number[i] == 0 for i in order])
        size, n = cells.shape
        alpha, scale = np.zeros((n, size, k)), np.ones((n, size))
        for t in range(n):
            open_ = _open(lengths, t)
            before = a0[:open_] if t == 0 else alpha[t - 1, :open_]
            a = before @ model.trans
            if t == 0:
                a[first[:open_]] = before[first[:open_]]
            a *= model.emit.T[cells[:open_, t]]
            scale[t, :open_] = np.maximum(a.sum(1), 1e-300)
            alpha[t, :open_] = a / scale[t, :open_, None]
        beta, moves, emits = b_end.copy(), np.zeros((size, k, k)), np.zeros((size, k, m))
        for t in range(n - 1, -1, -1):
            open_ = _open(lengths, t)
            gamma = alpha[t, :open_] * beta[:open_]
            total = np.maximum(gamma.sum(1, keepdims=True), 1e-300)
            gamma = gamma / total
            np.add.at(emits, (np.arange(open_)[:, None], np.arange(k)[None], cells[:open_, t][:, None]), gamma)
            ahead = model.emit.T[cells[:open_, t]] * beta[:open_]
            before = a0[:open_] if t == 0 else alpha[t - 1, :open_]
            move = before[:, :, None] * model.trans[None] * ahead[:, None, :]
            move /= np.maximum(move.sum((1, 2), keepdims=True), 1e-300)
            if t == 0:
                move[first[:open_]] = 0
                starts = np.where(first[:open_, None], gamma, 0)
            moves[:open_] += move
            back = ahead @ model.trans.T
            beta[:open_] = back / np.maximum(back.sum(1, keepdims=True), 1e-300)
        logs = np.log(scale).sum(0)
        place = np.argsort(order)
        return [logs[place], starts[place], moves.reshape(size, -1)[place], emits.reshape(size, -1)[place]]

    entered = _entered(blocks, model, fanout).withColumn("number", F.col("block"))
    return _over_blocks(entered, ["number", "given"], work, "log double, first array<double>, moves array<double>, emits array<double>")


def summed_counts(blocks: DataFrame, model: CategoricalHMM, fanout: int = FANOUT) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and expected counts of all sequences; k x (k + m + 1) numbers come to the driver."""
    k, m = model.emit.shape
    found = expected_counts(blocks, model, fanout)
    cells = found.select("log", F.posexplode(F.concat("first", "moves", "emits")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("log").alias("log")).orderBy("i").collect()
    x = np.array([c.x for c in cells])
    return cells[0].log, x[:k], x[k : k + k * k].reshape(k, k), x[k + k * k :].reshape(k, m)


def log_likelihoods(blocks: DataFrame, model: CategoricalHMM, fanout: int = FANOUT) -> DataFrame:
    """seq_id, n, log_likelihood of each sequence."""
    counts = expected_counts(blocks, model, fanout).groupBy("seq_id").agg(F.sum("log").alias("log_likelihood"))
    return blocks.groupBy("seq_id").agg(F.sum(F.size("obs")).alias("n")).join(counts, "seq_id")


def _best_effects(blocks: DataFrame, trans: np.ndarray, emit: np.ndarray) -> DataFrame:
    """v of each block: its matrix in (max, +)."""
    k = len(trans)

    def work(obs: Parts, number: list[int]) -> Parts:
        order, cells, lengths = _padded(obs)
        m = np.tile(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (len(obs), 1, 1))
        first = np.array([number[i] == 0 for i in order])
        for t in range(cells.shape[1]):
            n = _open(lengths, t)
            step = (m[:n, :, :, None] + trans[None, None]).max(2)
            if t == 0:
                step[first[:n]] = m[:n][first[:n]]
            m[:n] = step + emit.T[cells[:n, t]][:, None, :]
        return [m.reshape(len(obs), -1)[np.argsort(order)]]

    return _over_blocks(blocks.withColumn("number", F.col("block")), ["number"], work, "v array<double>", 1 << 16)


def _square(v: np.ndarray) -> np.ndarray:
    k = int(np.sqrt(len(v)))
    return v.reshape(k, k)


def _joined_best(parts: Parts) -> np.ndarray:
    m = _square(parts[0])
    for v in parts[1:]:
        m = (m[:, :, None] + _square(v)[None]).max(1)
    return m.ravel()


def _handed_best(given: np.ndarray, parts: Parts) -> Parts:
    out = [given]
    for v in parts[:-1]:
        out.append((out[-1][:, None] + _square(v)).max(0))
    return out


def _joined_maps(parts: Parts) -> np.ndarray:
    m = parts[-1].astype(int)
    for v in parts[-2::-1]:
        m = v.astype(int)[m]
    return m.astype(float)


def _handed_maps(given: np.ndarray, parts: Parts) -> Parts:
    out = [given]
    for v in parts[:0:-1]:
        out.append(v[out[-1].astype(int)])
    return out[::-1]


def best_paths(blocks: DataFrame, start: np.ndarray, trans: np.ndarray, emit: np.ndarray, fanout: int = FANOUT) -> DataFrame:
    """seq_id, date, Z_t: the best path of each sequence, by logarithms of a model's parameters; of equal ones the lowest state.

    blocks: of blocks_of, written. Where the logarithms are multiples of a power of two, sums are exact and so are ties.
    """
    k = len(start)
    long = blocks.where("blocks > 1")
    begin = F.array(*(F.lit(float(x)) for x in start))
    given = scan(written(_best_effects(long, trans, emit), "chain-best"), long.where("block = 0").select("seq_id", begin.alias("given")), _joined_best, _handed_best, fanout)
    entered = blocks.join(given, ["seq_id", "block"], "left").withColumn("given", F.coalesce("given", begin)).withColumn("number", F.col("block"))

    def pointers(obs: Parts, number: list[int], given: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks in order, their lengths, scores after their last rows, and for each row and state the state before."""
        order, cells, lengths = _padded(obs)
        score = np.array([given[i] for i in order])
        first = np.array([number[i] == 0 for i in order])
        back = np.tile(np.arange(k, dtype=np.int8), (cells.shape[1], len(obs), 1))
        for t in range(cells.shape[1]):
            n = _open(lengths, t)
            step = score[:n, :, None] + trans[None]
            came, best = step.argmax(1), step.max(1)
            if t == 0:
                came[first[:n]], best[first[:n]] = np.arange(k), score[:n][first[:n]]
            back[t, :n] = came
            score[:n] = best + emit.T[cells[:n, t]]
        return order, lengths, score, back

    def maps(obs: Parts, number: list[int], given: list[list[float]]) -> Parts:
        order, lengths, score, back = pointers(obs, number, given)
        m = np.tile(np.arange(k), (len(obs), 1))
        for t in range(len(back) - 1, -1, -1):
            m = np.take_along_axis(back[t].astype(int), m, 1)  # beyond a block's length states stay
        place = np.argsort(order)
        return [m.astype(float)[place], score.argmax(1).astype(float)[place]]

    found = written(_over_blocks(entered, ["number", "given"], maps, "v array<double>, last double"), "chain-maps")
    ends = found.join(blocks.where("block = blocks - 1").select("seq_id", "block"), ["seq_id", "block"]).select("seq_id", F.array("last").alias("given"))
    several = found.join(long.select("seq_id", "block"), ["seq_id", "block"])
    after = scan(several.select("seq_id", "block", "v"), ends.join(long.select("seq_id").distinct(), "seq_id"), _joined_maps, _handed_maps, fanout)
    after = after.unionByName(ends.join(blocks.where("blocks = 1").select("seq_id", "block"), "seq_id").select("seq_id", "given", "block")).withColumnRenamed("given", "last")

    def walk(obs: Parts, number: list[int], given: list[list[float]], last: list[list[float]], days: list[list[int]]) -> Parts:
        order, lengths, _, back = pointers(obs, number, given)
        state = np.array([int(last[i][0]) for i in order])
        out = np.zeros((len(obs), len(back)), np.int64)
        rows = np.arange(len(obs))
        for t in range(len(back) - 1, -1, -1):
            out[:, t] = state
            inside = t < lengths
            state = np.where(inside, back[t, rows, state], state)
        place = np.argsort(order)
        return [days, [out[p, : lengths[p]] for p in place]]

    path = _over_blocks(entered.join(after, ["seq_id", "block"]), ["number", "given", "last", "days"], walk, "days array<int>, states array<int>")
    each = path.select("seq_id", F.explode(F.arrays_zip("days", "states")).alias("x"))
    return each.select("seq_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("x.days")).alias("date"), F.col("x.states").alias("Z_t"))


def decode(seqs: DataFrame, model: CategoricalHMM, rows: int = ROWS, fanout: int = FANOUT) -> DataFrame:
    """code, date, Z_t of seqs (seq_id, code, date, C_t) by Viterbi (M3)."""
    with np.errstate(divide="ignore"):
        logs = [np.log(x) for x in (model.start, model.trans, model.emit)]
    paths = best_paths(blocks_of(seqs, rows), *logs, fanout)
    return seqs.select(F.col("seq_id").cast("string").alias("seq_id"), "code", "date").join(paths.hint("merge"), ["seq_id", "date"]).select("code", "date", "Z_t")


def fit(blocks: DataFrame, model: CategoricalHMM, iterations: int = 200, tol: float = 1e-3, fanout: int = FANOUT) -> tuple[CategoricalHMM, list[float]]:
    """Expectation-maximisation from a model on, and the log-likelihood before each step (M2). blocks: of blocks_of, written."""
    seen: list[float] = []
    norm = lambda x: (x + 1e-12) / (x + 1e-12).sum(-1, keepdims=True)
    for _ in range(iterations):
        ll, *counts = summed_counts(blocks, model, fanout)
        seen.append(ll)
        model = CategoricalHMM(*map(norm, counts))
        if len(seen) > 1 and ll - seen[-2] < tol:
            break
    return model, seen


def next_parameters(blocks: DataFrame, model: CategoricalHMM, fanout: int = FANOUT) -> DataFrame:
    """part ('start', 'trans' or 'emit'), i, j, p: the parameters after one step of expectation-maximisation, as a table."""
    k, m = model.emit.shape
    found = expected_counts(blocks, model, fanout).select(F.posexplode(F.concat("first", "moves", "emits")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    at, moves, emits = F.col("at"), F.col("at") - k, F.col("at") - k - k * k
    part = F.when(at < k, "start").when(moves < k * k, "trans").otherwise("emit")
    i = F.when(at < k, 0).when(moves < k * k, F.floor(moves / k)).otherwise(F.floor(emits / m)).cast("int")
    j = F.when(at < k, at).when(moves < k * k, F.pmod(moves, F.lit(k))).otherwise(F.pmod(emits, F.lit(m))).cast("int")
    cells = found.select(part.alias("part"), i.alias("i"), j.alias("j"), "x")
    return cells.select("part", "i", "j", (F.col("x") / F.sum("x").over(Window.partitionBy("part", "i"))).alias("p"))
