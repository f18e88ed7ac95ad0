"""Latent regimes: clusters, hidden Markov model, labels, transitions and edges of the hidden states."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import by_code, decode

LABELS = ("SHOCK", "TRANSITION", "TREND", "RANGE")


def sequences(df: DataFrame, valid: str = "valid") -> DataFrame:
    """Valid rows with seq_id: runs of valid rows of a code."""
    w = by_code().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("gap", F.sum(F.when(F.col(valid), 0).otherwise(1)).over(w)).where(F.col(valid))
    return out.withColumn("seq_id", F.concat_ws("|", F.col("code").cast("string"), "gap")).drop("gap")


def pairs(df: DataFrame, returns: bool = False) -> DataFrame:
    """z, z_next of consecutive rows of a code that both have a state; with r_t = p(t+1) - p(t) if asked."""
    w = by_code()
    out = df.select("code", "date", F.col("Z_t").alias("z"), F.lead("Z_t").over(w).alias("z_next"), *([(F.lead("p").over(w) - F.col("p")).alias("r_t")] if returns else []))
    out = out.where("z <> -1 and z_next is not null and z_next <> -1")
    return out.where("r_t is not null") if returns else out


def _grid(df: DataFrame, k: int) -> DataFrame:
    i = df.sparkSession.range(k).select(F.col("id").alias("z"))
    return i.crossJoin(F.broadcast(i.withColumnRenamed("z", "z_next")))


def transition_matrix(df: DataFrame, k: int = DEFAULT.latent) -> DataFrame:
    """z, z_next, c, t for all k x k cells; a row without pairs stays zero."""
    counts = pairs(df).groupBy("z", "z_next").agg(F.count(F.lit(1)).alias("c"))
    grid = _grid(df, k).join(counts, ["z", "z_next"], "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    total = F.sum("c").over(Window.partitionBy("z"))
    return grid.withColumn("t", F.when(total > 0, F.col("c") / total).otherwise(0.0))


def edge_state(df: DataFrame, k: int = DEFAULT.latent) -> DataFrame:
    """z, e, n: mean next return of each hidden state, null where unobserved."""
    seen = pairs(df, True).groupBy("z").agg(F.avg("r_t").alias("e"), F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(k).withColumnRenamed("id", "z").join(seen, "z", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def edge_transition(df: DataFrame, k: int = DEFAULT.latent) -> DataFrame:
    """z, z_next, e, n for all cells."""
    seen = pairs(df, True).groupBy("z", "z_next").agg(F.avg("r_t").alias("e"), F.count(F.lit(1)).alias("n"))
    return _grid(df, k).join(seen, ["z", "z_next"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def identity_check(df: DataFrame, k: int = DEFAULT.latent, tolerance: float = 1e-9) -> DataFrame:
    """z, e, rebuilt, ok: e(z) against the sum of t(z, z') e(z, z') over the same pairs."""
    cells = edge_transition(df, k)
    share = F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("z")), F.lit(0))
    rebuilt = cells.withColumn("part", share * F.col("e")).groupBy("z").agg(F.sum("part").alias("rebuilt"))
    return edge_state(df, k).join(rebuilt, "z").withColumn("ok", F.coalesce(F.abs(F.col("e") - F.col("rebuilt")) < tolerance, F.col("n") == 0))


def label_scores(df: DataFrame, trend=(0, 5), ranging=(2, 3), low=(0, 1, 2), shock=(4, 5), p: Params = DEFAULT) -> DataFrame:
    """z, n, scores and label of each hidden state; ties go to the first of LABELS."""
    r, s = decode(F.col("state_id"), p.bins, 0), decode(F.col("state_id"), p.bins, 1)
    share = lambda c: F.avg(c.cast("double"))
    g = df.where("Z_t <> -1 and state_id is not null").groupBy(F.col("Z_t").alias("z")).agg(
        F.count(F.lit(1)).alias("n"), share(r.isin(*trend) & s.isin(*low)).alias("TREND"), share(r.isin(*ranging) & s.isin(*low)).alias("RANGE"), share(s.isin(*shock)).alias("SHOCK")
    )
    g = g.withColumn("TRANSITION", 1 - (F.col("TREND") + F.col("RANGE") + F.col("SHOCK")))
    best = F.greatest(*LABELS)
    label = F.coalesce(*(F.when(F.col(x) == best, F.lit(x)) for x in LABELS))
    return g.withColumn("label", label)


def apply_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """R_t of Z_t, null for -1."""
    return df.join(F.broadcast(labels.select(F.col("z").alias("Z_t"), F.col("label").alias("R_t"))), "Z_t", "left")


def stationary(t: np.ndarray) -> np.ndarray:
    """Stationary distribution of a k x k matrix; uniform where it isn't unique or proper (M4)."""
    k = len(t)
    values, vectors = np.linalg.eig(t.T)
    if int((np.abs(np.abs(values) - 1) < 1e-6).sum()) > 1:
        return np.full(k, 1 / k)
    v = np.real(vectors[:, int(np.argmin(np.abs(values - 1)))])
    if abs(v.sum()) < 1e-12:
        return np.full(k, 1 / k)
    v = v / v.sum()
    return np.full(k, 1 / k) if (v < -1e-9).any() else np.clip(v, 0, None) / np.clip(v, 0, None).sum()


#: Rows that the centres' starting points are sought on, those with the smallest digests; all else covers all rows.
SEED_ROWS = 4096
#: Rows of a block that go through a step of all restarts at once: few enough for the processor's cache, and for products that BLAS does in one thread.
STEP_ROWS = 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, ties to the first."""
    d = (centres * centres).sum(1) - 2.0 * (x @ centres.T)
    at = d.argmin(1)
    return at, np.maximum(0.0, d[np.arange(len(x)), at] + (x * x).sum(1))


#: Rows of a product with a few columns, few enough for one thread of BLAS as well.
PRODUCT_ROWS = 2048
#: Share of all rows that steps look at before all distances are taken again, which costs about as much.
LOOKED = 1.0
#: Eighths of a power of two that a lead is told by, and the power that the least one stands for.
LEAD_PARTS, LEAD_LEAST = 8, -20


def _lead(gap: np.ndarray) -> np.ndarray:
    """A lead, or what would make up for one, as a whole number from 0 to 255; it never falls where the lead grows."""
    with np.errstate(divide="ignore"):
        return np.clip((np.log2(gap) - LEAD_LEAST) * LEAD_PARTS, 0, 255).astype(np.uint8)


def _step_sums(x: np.ndarray, centres: np.ndarray, leads: np.ndarray | None = None) -> np.ndarray:
    """For each restart (restarts, k, d): its cost, then for each of its centres the rows that are nearest to it, ties to the first, and their sums.

    One product has the distances to the centres of all restarts, another adds the rows up by their nearest ones. leads (restarts,
    rows), where given, is filled with how much nearer each row's centre is than the next one.
    """
    r, k, d = centres.shape
    flat = centres.reshape(-1, d)
    by = np.column_stack([(flat * flat).sum(1), -2.0 * flat])
    cost, sums = np.zeros(r), np.zeros((r * k, 1 + d))
    for a in range(0, len(x), STEP_ROWS):
        w = x[a : a + STEP_ROWS]
        one = np.column_stack([np.ones(len(w)), w])
        gaps = (by @ one.T).reshape(r, k, len(w))
        least = gaps.min(1)
        near = gaps == least[:, None]
        if np.count_nonzero(near) != r * len(w):
            near &= near.cumsum(1) == 1
        own = np.maximum(0.0, least + (w * w).sum(1))
        cost += own.sum(1)
        sums += near.reshape(r * k, -1).astype(float) @ one
        if leads is not None:
            np.copyto(gaps, np.inf, where=near)
            leads[:, a : a + STEP_ROWS] = _lead(np.maximum(0.0, np.sqrt(np.maximum(0.0, gaps.min(1) + (w * w).sum(1))) - np.sqrt(own)))
    return np.column_stack([cost, sums.reshape(r, -1)])


def _together(blocks: Iterator[np.ndarray], rows: int = 1 << 17) -> Iterator[np.ndarray]:
    """Blocks put together into ones of about `rows` rows, so that a step's calls are few."""
    held: list[np.ndarray] = []
    for x in blocks:
        held.append(x)
        if sum(map(len, held)) >= rows:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _leading(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, its leads, and the sums of _step_sums beside how many rows have each lead."""
    leads = np.empty((len(centres), len(x)), np.uint8)
    sums = _step_sums(x, centres, leads)
    return x, leads, np.column_stack([sums, [np.bincount(v, minlength=256) for v in leads]])


def _changed_sums(x: np.ndarray, leads: np.ndarray, made_up: np.ndarray, before: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each restart and each of its centres (restarts, k, 1 + d): the rows and sums that it has won since `before`, less those lost.

    leads: those before; a row whose lead is above made_up of its restart has kept its centre, and isn't looked at.
    """
    out, one = np.zeros((*centres.shape[:2], 1 + x.shape[1])), np.column_stack([np.ones(len(x)), x])
    for i, sums in enumerate(out):
        near = np.flatnonzero(leads[i] <= made_up[i])
        both = [np.column_stack([(c * c).sum(1), -2.0 * c]) for c in (before[i], centres[i])]
        for a in range(0, len(near), PRODUCT_ROWS):
            w = one.take(near[a : a + PRODUCT_ROWS], 0)
            old, new = (_first_least(by @ w.T) for by in both)
            other = np.flatnonzero(old != new)
            np.add.at(sums, new[other], w[other])
            np.subtract.at(sums, old[other], w[other])
    return out


def _first_least(gaps: np.ndarray) -> np.ndarray:
    """The first row that has each column's least value; argmin takes longer on few rows."""
    least, found = gaps.min(0), np.full(gaps.shape[1], len(gaps) - 1)
    for i in range(len(gaps) - 2, -1, -1):
        np.copyto(found, i, where=gaps[i] == least)
    return found


def _moved(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], before)


def _start(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 50) -> np.ndarray:
    """Centres spread over x with chances by squared distance, moved to the means of what is nearest some times."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        far = _nearest(x, centres)[1]
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))]])
    for _ in range(steps):
        at = _nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        new = _moved(sums, np.bincount(at, minlength=k), centres)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def _columns(b: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)]) if b.num_rows else np.empty((0, n))


def _blocks(df: DataFrame, how) -> RDD:
    """how(columns of each Arrow batch) as kept NumPy blocks, which an iteration passes over without a plan or a conversion."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if found := [pickle.dumps(x, protocol=5) for x in how(b)] if b.num_rows else []:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["v"])

    return df.mapInArrow(packed, "v binary").rdd.map(lambda r: pickle.loads(bytes(r.v))).persist(StorageLevel.MEMORY_AND_DISK)


#: Parts whose sums come to the driver one by one; those of more are added up by executors first.
PARTS = 64


def _summed(blocks: RDD, step) -> np.ndarray:
    """The sum of step(blocks of a part) over all parts, arrays of a fixed size."""
    sums = blocks.mapPartitions(lambda own: [step(own)])
    return sums.treeReduce(np.add) if blocks.getNumPartitions() > PARTS else sums.reduce(np.add)


def fit_centres(rows: DataFrame, cols: list[str], k: int, restarts: int, seed: int, iterations: int, tol: float) -> np.ndarray:
    """Centres of the restart with the lowest cost, in the order of their first coordinate.

    All restarts take their step in the same pass over all rows; what comes to the driver is k sums for each of them. A
    restart stands still once its centres move by less than tol. Now and then a step takes all distances, and notes how much nearer a
    row's centre is than the next one; the steps after it look only at rows whose lead the centres' moves since then may have made
    up for, and add what changed to the sums, until they would have looked at LOOKED of all rows.
    """
    d, rng = len(cols), np.random.default_rng(seed)
    x = rows.select(*(F.col(c).cast("double").alias(c) for c in cols)).cache()
    sample = np.array([list(r) for r in x.orderBy(F.xxhash64(*cols), *cols).limit(SEED_ROWS).collect()], float).reshape(-1, d)
    if not len(sample):
        return np.zeros((k, d))
    centres = np.stack([_start(sample, k, rng) for _ in range(restarts)])
    live, cost = list(range(restarts)), np.full(restarts, np.inf)
    blocks, noted, looked = _blocks(x, lambda b: [_columns(b, 0, d)]), None, 0.0
    for _ in range(iterations):
        at = centres[live]
        if noted is not None:
            own = [place[r] for r in live]
            moves = np.sort(np.sqrt(((at - before[own]) ** 2).sum(2)), 1)
            made_up = _lead(moves[:, -1] + moves[:, -2:-1].sum(1) + 2.0**LEAD_LEAST)
            looked += sum(leads[i, : m + 1].sum() for i, m in zip(own, made_up)) / max(1.0, leads[own].sum())
        if noted is None or looked > LOOKED:
            fresh = blocks.mapPartitions(lambda own, at=at: (_leading(v, at) for v in _together(own))).persist(StorageLevel.MEMORY_AND_DISK)
            total = _summed(fresh, lambda part, n=len(live): sum((v[2] for v in part), np.zeros((n, 1 + k * (1 + d) + 256))))
            if noted is not None:
                noted.unpersist()
            noted, looked, place, before = fresh, 0.0, {r: i for i, r in enumerate(live)}, at
            base, leads = total[:, 1 : 1 + k * (1 + d)].reshape(-1, k, 1 + d), total[:, 1 + k * (1 + d) :]
            sums, squares = base, total[0, 0] - _inertia(base[0], at[0])
        else:
            def step(part: Iterator[tuple[np.ndarray, ...]], at=at, before=before[own], own=own, made_up=made_up) -> np.ndarray:
                return sum((_changed_sums(v, leads[own], made_up, before, at) for v, leads, _ in part), np.zeros((len(at), k, 1 + d)))

            sums = base[own] + _summed(noted, step)
        still = []
        for r, own in zip(live, sums):
            cost[r] = squares + _inertia(own, centres[r])
            new = _moved(own[:, 1:], own[:, 0], centres[r])
            if np.abs(new - centres[r]).max() > tol:
                still.append(r)
            centres[r] = new
        live = still
        if not live:
            break
    if noted is not None:
        noted.unpersist()
    blocks.unpersist()
    x.unpersist()
    best = centres[int(cost.argmin())]
    return best[np.lexsort(best.T[::-1])]


def _inertia(sums: np.ndarray, centres: np.ndarray) -> float:
    """The cost of clusters with these numbers and sums of rows around centres, less the rows' own squares."""
    return float((sums[:, 0] * (centres * centres).sum(1) - 2.0 * (sums[:, 1:] * centres).sum(1)).sum())


def kmeans(df: DataFrame, cols: list[str], k: int = DEFAULT.latent, restarts: int = 20, seed: int = 42, iterations: int = 300, tol: float = 1e-4) -> DataFrame:
    """C_t of each valid row, -1 for others; the restart with the lowest cost wins (M1). Clusters are numbered by their centres."""
    return assigned(df, cols, fit_centres(df.where("valid"), cols, k, restarts, seed, iterations, tol))


def assigned(df: DataFrame, cols: list[str], centres: np.ndarray) -> DataFrame:
    """C_t, the number of the nearest centre, the first of equally near ones; -1 for rows that aren't valid."""
    gap = lambda c: reduce(lambda a, b: a + b, ((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(cols, c)))
    near = F.array_position(F.array(*(gap(c) for c in centres)), F.least(*(gap(c) for c in centres)) if len(centres) > 1 else gap(centres[0])) - 1
    return df.withColumn("C_t", F.when(F.col("valid"), near).otherwise(-1).cast("int"))


class CategoricalHMM:
    """start (k), trans (k, k), emit (k, m): a hidden Markov model over categories."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = start, trans, emit

    @classmethod
    def initial(cls, k: int, m: int, seed: int = 42) -> CategoricalHMM:
        rng = np.random.default_rng(seed)
        row = lambda n, c: (x := rng.random((n, c)) + 0.5) / x.sum(1, keepdims=True)
        return cls(np.full(k, 1 / k), 0.5 * row(k, k) + 0.5 * np.eye(k), row(k, m))

    def expected(self, obs: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and expected counts of sequences, by the scaled forward-backward recursion over all of them at once.

        obs: (sequences, longest), longest sequence first; what lies beyond a sequence's length isn't read.
        """
        size, n, k = len(obs), obs.shape[1], len(self.start)
        alpha, scale, b = np.zeros((n, size, k)), np.ones((n, size)), self.emit.T[obs.T]
        ahead, gamma = np.zeros((n, size, k)), np.zeros((n, size, k))  # zero beyond a sequence's length
        open_ = [int(np.searchsorted(-lengths, -i, "left")) for i in range(n + 1)]  # sequences longer than i
        for i in range(n):
            m = open_[i]
            a = (self.start if i == 0 else alpha[i - 1, :m] @ self.trans) * b[i, :m]
            scale[i, :m] = np.maximum(a.sum(1), 1e-300)
            alpha[i, :m] = a / scale[i, :m, None]
        beta = np.ones((size, k))
        for i in range(n - 1, -1, -1):
            m = open_[i + 1]
            if m:
                ahead[i, :m] = b[i + 1, :m] * beta[:m] / scale[i + 1, :m, None]
                beta[:m] = ahead[i, :m] @ self.trans.T
            np.multiply(alpha[i, : open_[i]], beta[: open_[i]], out=gamma[i, : open_[i]])
        moves = alpha.reshape(-1, k).T @ ahead.reshape(-1, k)
        seen, flat = np.ascontiguousarray(obs.T).ravel(), gamma.reshape(-1, k)
        emits = np.stack([np.bincount(seen, flat[:, state], minlength=self.emit.shape[1]) for state in range(k)])
        return float(np.log(scale).sum()), gamma[0].sum(0) if n else np.zeros(k), self.trans * moves, emits

    def _words(self, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the words of 1, 2.. width categories, in order: digits (words, length), one matrix a digit, and those of all words as one product."""
        one = self.trans * self.emit.T[:, None, :]
        digits = np.arange(len(one))[:, None]
        out = [(digits, one[digits], one)]
        for _ in range(width - 1):
            d, _, product = out[-1]
            digits = np.column_stack([np.repeat(d, len(one), 0), np.tile(np.arange(len(one)), len(d))])
            out.append((digits, one[digits], (product[:, None] @ one[None]).reshape(-1, *product.shape[1:])))
        return out

    def passes(self, words: np.ndarray, group: tuple[np.ndarray, ...]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood, expected first states, emissions of the first rows, and for each word its expected ends, unweighted (words, k, k).

        words: the product of each word's matrices; group: of in_words. What `expected` does row by row, a word at a time: the sums over all
        places of a word, of the state before it by what follows it, are all that `word_counts` needs for the rows in it.
        """
        first, codes, open_, order, counts = group
        (steps, size), k = codes.shape, len(self.start)
        alpha, ahead, scale = np.zeros((steps + 1, size, k)), np.zeros((steps, size, k)), np.ones((steps + 1, size))
        a = self.start * self.emit.T[first]
        for i in range(steps + 1):
            m = size if i == 0 else open_[i - 1]
            if i:
                a = (alpha[i - 1, :m, None, :] @ words.take(codes[i - 1, :m], 0))[:, 0]
            scale[i, :m] = np.maximum(a.sum(1), 1e-300)
            alpha[i, :m] = a / scale[i, :m, None]
        beta = np.ones((size, k))
        for i in range(steps - 1, -1, -1):
            m = open_[i]
            ahead[i, :m] = beta[:m] / scale[i + 1, :m, None]
            beta[:m] = (words.take(codes[i, :m], 0) @ ahead[i, :m, :, None])[:, :, 0]
        left, right = alpha[:-1].reshape(-1, k).take(order, 0), ahead.reshape(-1, k).take(order, 0)
        ends, found = np.cumsum(counts), np.zeros((len(words), k, k))
        for w in np.flatnonzero(counts):
            for a in range(ends[w] - counts[w], ends[w], PRODUCT_ROWS):
                z = min(a + PRODUCT_ROWS, ends[w])
                found[w] += left[a:z].T @ right[a:z]
        gamma = alpha[0] * beta
        emits = np.stack([np.bincount(first, gamma[:, state], minlength=self.emit.shape[1]) for state in range(k)])
        return float(np.log(scale).sum()), gamma.sum(0), emits, found

    def word_counts(self, found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected moves (k, k) and emissions (k, m) of the rows in words, from what `passes` sums up for each word."""
        k, m = self.emit.shape
        moves, emits, at = np.zeros((k, k)), np.zeros((m, k)), 0
        for digits, each, _ in self._words(width):
            own, at = found[at : at + len(digits)], at + len(digits)
            after = [np.broadcast_to(np.eye(k), own.shape)]
            for i in range(digits.shape[1] - 1, 0, -1):
                after.append(each[:, i] @ after[-1])
            before = after[0]
            for i, rest in enumerate(after[::-1]):
                step = (before.transpose(0, 2, 1) @ own @ rest.transpose(0, 2, 1)) * each[:, i]
                moves += step.sum(0)
                np.add.at(emits, digits[:, i], step.sum(1))
                before = before @ each[:, i]
        return moves, emits.T

    def viterbi(self, obs: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            t, b = np.log(self.trans), np.log(self.emit)
            score = np.log(self.start) + b[:, obs[0]]
        back = np.zeros((len(obs), len(self.start)), int)
        for i in range(1, len(obs)):
            step = score[:, None] + t
            back[i] = step.argmax(0)
            score = step.max(0) + b[:, obs[i]]
        out = np.empty(len(obs), int)
        out[-1] = score.argmax()
        for i in range(len(obs) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def _padded(found: list[np.ndarray], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of like length side by side, the longest first, at most about `most` cells at a time."""
    found = sorted((o for o in found if len(o)), key=len, reverse=True)
    while found:
        take = max(1, most // len(found[0]))
        part, found = found[:take], found[take:]
        lengths = np.array([len(o) for o in part])
        out = np.zeros((len(part), lengths[0]), np.int64)
        for i, o in enumerate(part):
            out[i, : len(o)] = o
        yield out, lengths


#: Most words of one length that rows are taken together in, so that their matrices stay in the processor's cache.
WORDS = 512


def word_width(m: int) -> int:
    """The longest words of m categories of which there are at most WORDS, one row at least."""
    width = 1
    while m > 1 and m ** (width + 1) <= WORDS:
        width += 1
    return width


def in_words(obs: np.ndarray, lengths: np.ndarray, m: int, width: int) -> tuple[np.ndarray, ...]:
    """Sequences (of _padded) as their first rows and then words of `width` rows, the last one of what is left.

    first; the number of each word (words, sequences), those of fewer rows first; sequences that have so many words; places of the words
    sorted by number, and how many places each number has.
    """
    starts = np.cumsum([0, *(m**i for i in range(1, width + 1))])
    steps = -(-(obs.shape[1] - 1) // width)
    codes = np.full((steps, len(obs)), -1, np.int16 if starts[-1] < 1 << 15 else np.int32)
    for b in range(steps):
        at = 1 + b * width
        left = np.clip(lengths - at, 0, width)
        value = np.zeros(len(obs), np.int64)
        for i in range(min(width, obs.shape[1] - at)):
            value = np.where(i < left, value * m + obs[:, at + i], value)
        codes[b] = np.where(left > 0, starts[np.maximum(left, 1) - 1] + value, -1)
    flat, open_ = codes.ravel(), (codes >= 0).sum(1)
    order = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0) :].astype(np.int32)
    return obs[:, 0].astype(np.int16), codes, open_, order, np.bincount(flat[order], minlength=int(starts[-1]))


def fit_hmm(seqs: DataFrame, k: int = DEFAULT.latent, m: int = DEFAULT.latent, iterations: int = 200, tol: float = 1e-3, seed: int = 42, rows: int = 250_000) -> CategoricalHMM:
    """Pooled expectation-maximisation over all sequences (M2).

    seqs: seq_id, date, C_t. Each step sums expected counts over groups of sequences with about `rows` rows each, fewer where there
    are cores for more groups, a word of rows at a time; k x k numbers of each group come to the driver.
    """
    width = word_width(m)
    packed = seqs.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "C_t"))), lambda x: x["C_t"].cast("int")).alias("obs"))
    parts = max(1, -(-seqs.count() // rows), seqs.sparkSession.sparkContext.defaultParallelism)
    blocks = _blocks(packed.repartition(parts, "seq_id").select("obs"), lambda b: (in_words(*x, m, width) for x in _padded([np.asarray(o.values) for o in b.column(0)])))
    model, before = CategoricalHMM.initial(k, m, seed), -np.inf
    for _ in range(iterations):
        def step(own: Iterator[tuple[np.ndarray, ...]], model=model) -> np.ndarray:
            words = np.concatenate([product for _, _, product in model._words(width)])
            ll, s, e, found = 0.0, np.zeros(k), np.zeros((k, m)), np.zeros((len(words), k, k))
            for group in own:
                parts = model.passes(words, group)
                ll, s, e, found = ll + parts[0], s + parts[1], e + parts[2], found + parts[3]
            moves, emits = model.word_counts(found, width)
            return np.concatenate([[ll], s, moves.ravel(), (e + emits).ravel()])

        total = _summed(blocks, step)
        s, t, e = total[1 : k + 1], total[k + 1 : k + 1 + k * k].reshape(k, k), total[k + 1 + k * k :].reshape(k, m)
        norm = lambda x: (x + 1e-12) / (x + 1e-12).sum(-1, keepdims=True)
        model = CategoricalHMM(norm(s), norm(t), norm(e))
        if total[0] - before < tol:
            break
        before = total[0]
    blocks.unpersist()
    return model


def verify(df: DataFrame) -> bool:
    """Z_t is -1 exactly where R_t is null (V3)."""
    return df.agg(F.count_if((F.col("Z_t") == -1) != F.col("R_t").isNull()).alias("n")).first()["n"] == 0


def verify_matrix(t: DataFrame, tolerance: float = 1e-9) -> bool:
    """No negative cell, and each row's sum is 0 or 1 (V2, V4)."""
    rows = t.groupBy("z").agg(F.sum("t").alias("s"), F.min("t").alias("least"))
    bad = rows.where((F.col("least") < 0) | ((F.abs(F.col("s") - 1) > tolerance) & (F.abs(F.col("s")) > tolerance)))
    return bad.isEmpty()
