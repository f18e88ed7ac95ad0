"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprints within radius r agree on at least one of r + 1 bands of bits, so blocks of equal band values hold every
linked pair; the number of rows is r + 1 times that of the distinct fingerprints. A block is sorted by population count
and compared tile by tile; tile pairs whose population counts differ beyond the radius are skipped. A block above the
tile size is dealt out as pairs of tiles, so no task gets more than two tiles of one block, whatever the block's size.
A tile pair returns a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; a text with fewer words than a shingle is one shingle, one without words has
fingerprint zero and links like any other. Repeated rows share a fingerprint and so a component. Null doc_ids are
ignored for component_id unless all ids of the component are null. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, groups, known_size, materialise, placed, small_batches, tidy
from .components import connected_components

TILE = 1024
#: More than the tiles of one span in one block.
SALTS = 30_000_000


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words, in order, repeats included; ASCII upper case is lowered."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), seed) for x in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the graph on 0..n-1 with edges i-j: (member, root) for members other than roots."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def near_pairs(a: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within radius, tile pair by tile pair; a is sorted by population count."""
    if len(a) == 2:
        if (int(a[0]) ^ int(a[1])).bit_count() <= radius:
            yield np.array([0]), np.array([1])
        return
    pop = np.bitwise_count(a)
    for s in range(0, len(a), tile):
        x = a[s : s + tile]
        for t in range(s, len(a), tile):
            y = a[t : t + tile]
            if int(pop[t]) - int(pop[s + len(x) - 1]) > radius:
                break
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            i, j = i + s, j + t
            i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def linked(a: np.ndarray, radius: int, accept=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into a that span its links. accept: takes two index arrays and tells which pairs count."""
    order = np.argsort(np.bitwise_count(a), kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in near_pairs(a[order], radius):
        i, j = order[i], order[j]
        if accept is not None:
            fits = accept(i, j)
            i, j = i[fits], j[fits]
        found.append(forest(len(a), i, j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _edges(batches: Iterator[pa.RecordBatch], keys: list[str], node: str, pairs) -> Iterator[pa.RecordBatch]:
    """Edges a, b between values of `node`."""
    left, right, held = [], [], 0

    def take() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (left, right)], ["a", "b"])

    for g in groups(batches, keys):
        if g.num_rows < 2:
            continue
        x, y = pairs(g)
        if len(x):
            nodes = g.column(node).to_numpy()
            left.append(nodes[x])
            right.append(nodes[y])
            held += len(x)
        if held > 50_000:
            yield take()
            left, right, held = [], [], 0
    if held:
        yield take()


def bands(fps: DataFrame, radius: int) -> DataFrame:
    """fp in each of its radius + 1 blocks: band, value, fp, pop."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    each = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    ]
    return fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*each)).alias("x")).select("x.band", "x.value", "fp", "pop")


def tile_pairs(blocks: DataFrame, key: list[str], node: str, span: Column, weight: Column | int = 1, most: int = TILE, near: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of blocks dealt to comparisons (key, ta, tb), and edges a, b found on the way or None.

    A block of weight up to `most` is one comparison. Of a larger one, rows are dealt by their span, and by a salt within
    a span, into tiles of about that weight; rows whose spans differ by more than one never match, so only tiles of the
    same or of neighbouring spans are compared. near: whether a row matches the row `_lead` of its block, that with the
    smallest node. Rows that do are linked to it, so that tiles of such rows needn't be compared among themselves: a large
    block of copies of one thing costs one look at each, and pairs only with the rows that differ from it.
    """
    cols, weight = blocks.columns, F.lit(weight) if isinstance(weight, int) else weight
    large = blocks.groupBy(*key).agg(F.sum(weight).alias("w"), F.min(node).alias("lead")).where(F.col("w") > most).select(*key, "lead")
    large = materialise(large, "large-blocks")
    whole = lambda df: df.select(*cols, F.lit(-1).cast("long").alias("ta"), F.lit(-1).cast("long").alias("tb"))
    if large.isEmpty():
        return whole(blocks), None
    rows = blocks.join(large, key).withColumn("span", span.cast("int"))
    if near is None:
        rows = rows.withColumn("done", F.lit(0))
    else:
        leads = rows.where(F.col(node) == F.col("lead")).select(*key, F.struct(*cols).alias("_lead")).dropDuplicates(key)
        rows = rows.join(leads, key).withColumn("done", near.cast("int")).drop("_lead")
    rows = materialise(rows, "large-rows")
    counts = rows.groupBy(*key, "span", "done").agg(F.ceil(F.sum(weight) / most).cast("int").alias("salts"))
    tiles = counts.select(*key, "span", "done", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    number = lambda salt: (2 * F.col("span") + F.col("done")).cast("long") * SALTS + salt
    tiles = materialise(tiles.select(*key, "span", "done", number(F.col("salt")).alias("t")), "tiles")
    other = tiles.select(*key, F.col("span").alias("span2"), F.col("done").alias("done2"), F.col("t").alias("t2"))
    fits = (F.col("t") <= F.col("t2")) & (F.col("span2") - F.col("span") <= 1) & (F.col("done") + F.col("done2") < 2)
    pairs = materialise(tiles.join(other, key).where(fits).select(*key, F.col("t").alias("ta"), F.col("t2").alias("tb")), "tile-pairs")
    dealt = rows.join(counts, [*key, "span", "done"]).withColumn("t", number(F.pmod(F.xxhash64(node, F.lit(7)), F.col("salts")).cast("int")))
    left = dealt.join(pairs.withColumn("t", F.col("ta")), [*key, "t"]).select(*cols, "ta", "tb")
    right = dealt.join(pairs.where("ta <> tb").withColumn("t", F.col("tb")), [*key, "t"]).select(*cols, "ta", "tb")
    found = None if near is None else rows.where((F.col("done") == 1) & (F.col(node) != F.col("lead"))).select(F.col(node).alias("a"), F.col("lead").alias("b"))
    return whole(blocks.join(large, key, "left_anti")).unionByName(left).unionByName(right), found


def _compared(dealt: tuple[DataFrame, DataFrame | None], key: list[str], node: str, pairs) -> DataFrame:
    """Edges a, b between nodes; pairs(rows of one comparison) gives index pairs that span its links."""
    rows, found = dealt
    keys = [*key, "ta", "tb"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    edges = rows.mapInArrow(tidy(lambda batches: _edges(batches, keys, node, pairs)), "a long, b long")
    return edges if found is None else edges.unionByName(found)


def fingerprint_links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges a, b that span all links between the distinct fingerprints in column fp."""

    def pairs(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return linked(g.column("fp").to_numpy().view(np.uint64), radius)

    key = ["band", "value"]
    return _compared(tile_pairs(bands(fps, radius), key, "fp", F.floor(F.col("pop") / (radius + 1)), most=tile), key, "fp", pairs)


def near_components(docs: DataFrame, words: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = fingerprint_links(distinct.select("fp"), radius, tile)
    comps = connected_components(links)
    rooted = distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Of near_duplicates: blocks of a text, first shingles that make a block's key, and the radius within which similar texts lie.
KEYS, ROWS, WIDE = 12, 2, 24
#: Texts of fewer shingles are not told apart by fingerprints, which vary too much there.
SHORT = 64
#: Rows of a list of places up to which it is broadcast: some 30 MB.
PLACES = 400_000
#: Shingles of the texts that are compared at a time.
SHINGLES = 1 << 19
_ORDERS = np.random.default_rng(42).integers(0, 2**63, (KEYS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _keys(h: np.ndarray) -> np.ndarray:
    """Block keys of a set of shingles: each is made of the least shingles in ROWS orders, which are independent."""
    least = np.full(KEYS * ROWS, np.iinfo(np.uint64).max)
    for s in range(0, len(h), 1 << 13):
        np.minimum(least, (h[s : s + (1 << 13)] * _ORDERS).min(1), out=least)
    key = np.arange(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, ROWS).T:
        key = _mixed(key ^ part)
    return key


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = WIDE, tile: int = TILE, shingles: int = SHINGLES, place: str | None = None) -> DataFrame:
    """doc_id, component_id, place, stays of every row that has a near duplicate: Jaccard similarity of shingle sets of at least `similarity`.

    Fingerprints within a wide radius don't agree on any band, so blocks are made by shingles instead: a document's first
    shingles in ROWS orders are a key, of which it has KEYS. Documents of similarity s share none of them with probability
    (1 - s ** ROWS) ** KEYS, 5 in a million at 0.8. Blocks are compared tile by tile as in fingerprint_links, but for texts
    under SHORT shingles; candidates are then verified by exact similarity, component by component, `shingles` at a time.
    Rows are told apart by their place, whatever doc_ids they share: component_id is the smallest doc_id of the component, and
    the first row with it is the one that stays. place: a column of docs that placed() made, if it has one. Rows without doc_id or words take no part.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20):
            rows = []
            for i, t in enumerate(b.column(2)):
                if len(h := np.unique(shingle_hashes(t.as_py(), words))):
                    rows.append((i, fingerprint(h), len(h), _keys(h)))
            at, fps, n, keys = zip(*rows) if rows else ((), (), (), (np.empty(0, np.uint64),))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys).view(np.int64)), KEYS).cast(pa.list_(pa.int64()))
            own = b.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int32()), lists], ["place", "doc_id", "fp", "n", "keys"])

    at_place = "place struct<f1: long, f2: long, row: long>"
    texts = placed(docs.select("doc_id", "text"), "place") if place is None else docs.withColumnRenamed(place, "place")
    texts = texts.select("place", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    # numbers stand for rows from here on; they hold once they are written
    signed = texts.mapInArrow(tidy(sign), f"{at_place}, doc_id long, fp long, n int, keys array<long>").withColumn("node", F.monotonically_increasing_id())
    signed = materialise(signed, "signatures")
    each = lambda df, fp, first: df.select("node", fp.alias("fp"), F.bit_count(fp).alias("pop"), "n", F.posexplode("keys").alias("band", "value")).withColumn("band", F.col("band") + first)
    short = each(signed.where(F.col("n") * similarity < SHORT), F.lit(0).cast("long"), KEYS)
    blocks = short.unionByName(each(signed.where(F.col("n") >= SHORT), F.col("fp"), 0))
    like = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n)
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("_lead.fp"))) <= radius) & like(F.col("n"), F.col("_lead.n"))

    def close(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n = g.column("n").to_numpy()
        return linked(g.column("fp").to_numpy().view(np.uint64), radius, lambda i, j: np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))

    key = ["band", "value"]
    loose = connected_components(_compared(tile_pairs(blocks, key, "node", F.floor(F.col("pop") / (radius + 1)), most=tile, near=near), key, "node", close))
    loose = signed.select("node", "place").join(loose, "node").select("node", "root", F.col("place").alias("_place"))
    loose = materialise(loose, "candidates")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(2)]
            n = np.array([len(h) for h in sets], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), lists], ["node", "root", "n", "hashes"])

    few = texts.join(known_size(loose, PLACES), F.col("place") == F.col("_place")).select("node", "root", "text")
    sets = materialise(few.mapInArrow(tidy(hashed), "node long, root long, n int, hashes array<long>"), "shingle-sets")
    both = F.size(F.array_intersect("hashes", "_lead.hashes"))
    same = both >= similarity * (F.col("n") + F.col("_lead.n") - both) - 1e-9

    def similar(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        col = g.column("hashes").combine_chunks()
        return similar_links(col.flatten().to_numpy(), np.diff(col.offsets.to_numpy()), similarity)

    # sets of similar sizes are in the same or in neighbouring spans
    span = F.floor(F.ln("n") / math.log(1.01 / similarity))
    edges = _compared(tile_pairs(sets, ["root"], "node", span, F.col("n"), shingles, same), ["root"], "node", similar)
    members = connected_components(edges).join(signed.select("node", "doc_id", "place"), "node")
    members = materialise(members, "near-members")
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    return members.join(first, "root").select("doc_id", F.col("first.doc_id").alias("component_id"), "place", (F.col("node") == F.col("first.node")).alias("stays"))


def similar_links(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) that span the pairs of sets of at least that Jaccard similarity; the sets, none empty, lie end to end in flat.

    From a set to those like it that no one has reached yet, and so on: a group of copies takes one look at each.
    """
    n = len(sizes)
    ids = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    has = np.zeros(int(ids.max()) + 1, np.int32)
    free = np.ones(n, bool)
    members, roots = [], []
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], todo = False, [seed]
        while todo:
            i = todo.pop()
            ask = np.flatnonzero(free & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9))
            if not len(ask):
                continue
            own = ids[starts[i] : ends[i]]
            has[own] = 1
            if 4 * len(ask) > n:
                both = np.add.reduceat(has[ids], starts)[ask]
            else:
                both = np.array([has[ids[starts[j] : ends[j]]].sum() for j in ask])
            has[own] = 0
            hit = ask[both >= similarity * (sizes[i] + sizes[ask] - both) - 1e-9]
            free[hit] = False
            todo += hit.tolist()
            members.append(hit)
            roots.append(np.full(len(hit), seed))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that have a near duplicate with a smaller doc_id, or an earlier one with the same, in their component.

    Columns pass through whatever their names.
    """
    own, gone_place = fresh("place", docs), fresh("gone", docs)
    rows = placed(docs, own)
    gone = near_duplicates(rows.select("doc_id", "text", own), words, similarity, place=own).where("not stays").select(F.col("place").alias(gone_place))
    gone = materialise(gone, "near-gone")
    return rows.join(known_size(gone, PLACES), rows[own] == gone[gone_place], "left_anti").drop(own)
