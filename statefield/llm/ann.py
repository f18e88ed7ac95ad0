"""Approximate nearest neighbours by cosine: vantage-point trees per shard.

Vectors are dealt to shards of a bounded size by a digest of their id; each shard becomes one tree over unit vectors,
with the chord as metric. A tree node splits its vectors at the median distance from a vantage point. A block of queries
walks the tree together, each query into its nearer side first; the farther side is skipped when the triangle inequality,
tightened by `relax`, puts it beyond the k-th distance found: relax 1 is exact, larger skips more.

One shuffle brings a block of queries and a group of shards to a task, which builds one tree after the other and takes the
k-th distances found along, so that later trees prune by them. Queries are copied once for each group, of which there are
GROUPS at most; vectors once for each block, and a block is large: up to BLOCK queries all vectors are moved once.
Each query's best k of all groups are merged at the end.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no part;
ties go to the smaller id; a query with fewer candidates than k gets all of them; repeated rows of one id count once
each, and none is a candidate for its own id. Rows with null id take no part. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups

SHARD = 8192
BLOCK = 1 << 16
GROUPS = 64
LEAF = 512
#: Guards prunes against rounding.
EPS = 1e-9


class VPTree:
    """A vantage-point tree over unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        self.norms = np.sqrt((self.raw * self.raw).sum(1))
        self.unit = self.raw / self.norms[:, None]
        self.leaf = leaf
        self.root = self._build(np.arange(len(self.ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        middle = self.unit[rows].mean(0)
        vantage = rows[int(np.argmin(self.unit[rows] @ middle))]  # far from the middle, so that distances spread
        d = chord(self.unit[rows] @ self.unit[vantage])
        cut = len(rows) // 2
        by = np.argsort(d, kind="stable")
        near, far = by[:cut], by[cut:]
        if d[by[0]] == d[by[-1]]:
            return rows  # all alike: no vantage point can part them
        return vantage, float(d[near].max()), float(d[far].min()), self._build(np.sort(rows[near])), self._build(np.sort(rows[far]))

    def search(self, found: Found, relax: float = 1.0) -> None:
        """Takes this tree's vectors into what has been found for the queries."""
        _Walk(self, found, relax).visit(self.root, np.arange(len(found.own)))


class Found:
    """Queries with the ids and cosines of their k best so far, ties by id; unfilled places have the score -inf."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.norm = np.sqrt((queries * queries).sum(1))
        self.unit = queries / self.norm[:, None]
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(queries), k), -np.inf)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class _Walk:
    def __init__(self, tree: VPTree, found: Found, relax: float):
        self.tree, self.found, self.relax = tree, found, relax

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The k-th distance found so far."""
        worst = self.found.scores[q, -1]
        return np.where(np.isneginf(worst), np.inf, chord(worst))

    def offer(self, rows: np.ndarray, q: np.ndarray) -> None:
        for s in range(0, len(q), 4096):
            self._offer(rows, q[s : s + 4096])

    def _offer(self, rows: np.ndarray, q: np.ndarray) -> None:
        tree, found, k = self.tree, self.found, self.found.k
        rough = found.unit[q] @ tree.unit[rows].T
        hit = rough >= found.scores[q, -1][:, None] - 1e-7
        qi, ri = np.nonzero(hit)
        if not len(qi):
            return
        exact = (found.queries[q[qi]] * tree.raw[rows[ri]]).sum(1) / (found.norm[q[qi]] * tree.norms[rows[ri]])
        fine = tree.ids[rows[ri]] != found.own[q[qi]]
        qi, ri, exact = qi[fine], ri[fine], exact[fine]
        touched = np.unique(qi)
        all_q = np.concatenate([qi, np.repeat(touched, k)])
        all_ids = np.concatenate([tree.ids[rows[ri]], found.ids[q[touched]].ravel()])
        all_s = np.concatenate([exact, found.scores[q[touched]].ravel()])
        order = np.lexsort((all_ids, -all_s, all_q))
        take = order[np.searchsorted(all_q[order], touched)[:, None] + np.arange(k)]
        found.ids[q[touched]], found.scores[q[touched]] = all_ids[take], all_s[take]

    def visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self.offer(node, q)
            return
        vantage, near_max, far_min, near, far = node
        d = chord(self.found.unit[q] @ self.tree.unit[vantage])
        inner = d <= (near_max + far_min) / 2
        self.visit(near, q[inner])
        self.visit(far, q[~inner])
        i, o = q[inner], q[~inner]
        self.visit(far, i[(far_min - d[inner]) * self.relax <= self.reach(i) + EPS])
        self.visit(near, o[(d[~inner] - near_max) * self.relax <= self.reach(o) + EPS])


def _usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (width["w"] if width else 0))


def _stack(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, relax: float = 1.0, vec_id: str = "vec_id", column: str = "embedding", shard: int = SHARD, block: int = BLOCK, most_groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors for each row of queries, other than its own id.

    queries has the columns of vectors. relax: 1 exact; above, subtrees are skipped sooner.
    """
    base, asked = _usable(vectors, vec_id, column), _usable(queries, vec_id, column)
    shards, blocks = max(1, -(-base.count() // shard)), max(1, -(-asked.count() // block))
    n_groups = min(shards, most_groups)
    dealt = lambda n, name: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", dealt(blocks, "block").alias("block"), F.lit(-1).alias("part"), every(n_groups).alias("group"))
    right = base.select("id", "v", every(blocks).alias("block"), dealt(shards, "shard").alias("part")).withColumn("group", F.col("part") % n_groups)
    keys = ["block", "group", "part"]
    rows = left.unionByName(right).select(*keys, "id", F.xxhash64("v").alias("digest"), "v").repartition(2 * blocks * n_groups, "block", "group").sortWithinPartitions(*keys, "id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, found = None, None
        for g in groups(batches, keys):
            at, part = (g.column("block")[0].as_py(), g.column("group")[0].as_py()), g.column("part")[0].as_py()
            if at != task:
                yield from _best(found)
                task, found = at, None
            ids, v = g.column("id").to_numpy(), _stack(g.column("v"))
            if part < 0:
                found = Found(v, ids, k)
            elif found is not None and v.shape[1] == found.unit.shape[1]:
                VPTree(ids, v).search(found, relax)
        yield from _best(found)

    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    merged = rows.mapInArrow(run, "query_id long, copy long, vec_id long, score double")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(found: Found | None) -> Iterator[pa.RecordBatch]:
    """Rows of what was found. copy: the query's place in its block, which all of the block's tasks see in one order."""
    if found is not None:
        qi, ki = np.nonzero(~np.isneginf(found.scores))
        yield pa.RecordBatch.from_arrays([pa.array(found.own[qi]), pa.array(qi), pa.array(found.ids[qi, ki]), pa.array(found.scores[qi, ki])], ["query_id", "copy", "vec_id", "score"])
