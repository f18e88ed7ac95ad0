"""Packing into token windows by Karmarkar-Karp multiway differencing.

Each document's ids, ended by id 0, are cut into full windows and a rest; the rest is cut into pieces. Pieces are
packed block by block: every piece starts as a partition into k windows with itself in one of them, and the two partial
partitions with the largest imbalance are merged again and again, fullest windows onto emptiest, until one is left. It
has near-equal windows; k starts at the least count that can hold the block and rises while a window is over capacity.

A block ends where its windows have a little slack, so packing needs one pass over the documents, no shuffle, and the
memory of one block. Retried tasks give the same rows, as a task's rows depend on its input split alone.

Defined results: null text counts as empty, so that a document always has at least the closing id; repeated rows are
packed once each; rows with null doc_id are packed like others. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, forget
from .common import small_batches, tidy

CAPACITY = 1024
PIECE = 256
BLOCK = 400
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item, and the sums of the k windows."""
    n = len(sizes)
    heap: list[tuple[int, int]] = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = s, i
        parts[i] = sums, nodes
        heap.append((-s if k > 1 else 0, i))
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    free = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (sa, na), (sb, nb) = parts.pop(a), parts.pop(b)
        sums, nb = sa + sb[::-1], nb[::-1]
        both = (na >= 0) & (nb >= 0)
        nodes = np.maximum(na, nb)
        count = int(both.sum())
        if count:
            own = np.arange(free, free + count)
            joined.append((own, na[both], nb[both]))
            nodes[both] = own
            free += count
        order = np.argsort(-sums, kind="stable")
        parts[a] = sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), a))
    sums, nodes = parts[heap[0][1]]
    window = np.full(free, -1, np.int64)
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for own, left, right in reversed(joined):
        window[left] = window[right] = window[own]
    return window[:n], sums


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows; the count rises until none is over capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if sums.max() <= capacity:
            return window, k
        k += 1


class _Packer:
    def __init__(self, part: int, capacity: int, piece: int, block: int):
        self.capacity, self.piece, self.block = capacity, piece, block
        self.next = part << 33
        self.rows: list[tuple] = []
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n, full = len(ids) // 4, len(ids) // 4 // self.capacity
        for s in range(0, full * self.capacity, self.capacity):
            self.rows.append((doc, s, self.capacity, zlib.crc32(ids[4 * s : 4 * (s + self.capacity)]), n, self.next, 0))
            self.next += 1
        for s in range(full * self.capacity, n, self.piece):
            e = min(n, s + self.piece)
            self.held.append((doc, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n))
            self.total += e - s
            if len(self.held) >= self.block:
                slack = -self.total % self.capacity
                windows = -(-self.total // self.capacity)
                if 2 * windows <= slack <= 6 * windows or len(self.held) >= 2 * self.block:
                    self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        window, k = pack_block(np.array([h[2] for h in self.held], np.int64), self.capacity)
        filled = [0] * k
        for h, w in zip(self.held, window.tolist()):
            self.rows.append((*h, self.next + w, filled[w]))
            filled[w] += h[2]
        self.next += k
        self.held, self.total = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, keep: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    keep: whether a worker keeps its encoder, with the chunks it has seen, for the tasks after; some 100 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, plain=True), _Packer(TaskContext.get().partitionId(), capacity, piece, block)
        for b in small_batches(batches, "text"):
            for doc, ids in zip(b.column(0).to_pylist(), enc.ids(t or "" for t in b.column(1).to_pylist())):
                packer.add(doc, ids + b"\0\0\0\0")
            if len(packer.rows) > 20_000:
                yield packer.take()
        packer.flush()
        if packer.rows:
            yield packer.take()
        if not keep:
            forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(run), SCHEMA)
