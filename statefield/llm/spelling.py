"""Spelling variant grouping: words that differ by one letter, found by rolling hashes of their deletions.

A word of L letters has L deletions, its letters but one. Two words of one length that differ in one letter share the deletion
at that place; a word and another with one letter more share the word and the other's deletion there. Hashes of all deletions
come from polynomial prefix hashes, worked out for whole batches of words in NumPy: prefix plus suffix moved by one place,
modulo 2^64. The keys are dealt by their leading bits, sorted by key and place within each part, and runs of one key are
compared by their letters, so collisions of hashes never link words.

A run of one key is small whatever the words: at most one word, and as many deletions as there are letters and places. Words
that share a deletion at one place are counted from the size of their run, and the nearest of each from the run's two most
frequent words; no pairs are made. Equal letters in a row give one deletion several times, of which only the first counts, so
each near pair is counted once.

Forms are followed to their ends by doubling: each step of a chain has ten times as many occurrences, so few steps are needed.

Defined results: null texts have no words, a null doc_id is written as nothing before the colon; repeated rows count again.
Ties between near words go by code points. Empty tables give no rows. Other columns take no part. Words may be of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty

#: Least letters of a word; least occurrences; least ratio of a form's occurrences to the word's. One in VARIANTS occurrences loses a letter.
LETTERS, OCCURRENCES, RATIO, VARIANTS = 7, 2, 10, 31
#: Words held before a task hands on their counts, and letters of the words whose keys are made at a time.
HELD, LETTERS_AT_A_TIME = 300_000, 1 << 20
#: Leading bits of keys that they are dealt by.
RADIX_BITS = 12
_RANDOM = np.random.default_rng(13)
_VALUES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(0, 2**62)) * 4 + 3
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def words_of(doc_id: int | None, text: bytes, letters: int = LETTERS) -> Counter:
    """Occurrences of a document's words, as Latin-1; A-Z are lower-cased, and one in VARIANTS runs loses a letter."""
    runs = Counter(re.findall(rb"[a-z\xc0-\xff]{%d,}" % letters, text.decode().encode("latin-1", "replace").lower()))
    head, out = crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % VARIANTS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < letters:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word (Latin-1 bytes), n: occurrences over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        take = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in small_batches(batches, "text"):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.update(words_of(doc_id, text.as_py(), letters))
                if len(held) > HELD:
                    yield take()
                    held.clear()
        yield take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: spreads a hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, key) of each word's deletions, and of the word itself at place -1; the words lie end to end in flat."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - starts[word]
    power = np.full(int(sizes.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    term = _VALUES[flat] * power[place]
    upto = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    before, whole = upto[:-1] - upto[starts][word], upto[ends] - upto[starts]
    less = before + (whole[word] - before - term) * _INVERSE
    length = np.uint64(0x9E3779B97F4A7C15)
    deleted = _mixed(less + (sizes[word] - 1).astype(np.uint64) * length)
    own = _mixed(whole + sizes.astype(np.uint64) * length)
    return np.concatenate([np.arange(len(sizes)), word]), np.concatenate([np.full(len(sizes), -1), place]), np.concatenate([own, deleted])


def keyed(words: DataFrame, mask: int = (1 << 64) - 1) -> DataFrame:
    """radix, key, place, word, n for each deletion of each word and for the words themselves. mask: the bits of keys that are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "word", LETTERS_AT_A_TIME):
            if not b.num_rows:
                continue
            col = b.column(0)
            sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]).astype(np.int64)
            first = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
            flat = np.frombuffer(col.buffers()[2], np.uint8)[first : first + int(sizes.sum())]
            number, place, key = deletion_keys(flat, sizes)
            key &= np.uint64(mask)
            for i in range(0, len(key), 50_000):
                s = slice(i, i + 50_000)
                taken = b.take(pa.array(number[s]))
                radix = (key[s] >> np.uint64(64 - RADIX_BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key[s].view(np.int64)), pa.array(place[s].astype(np.int32)), *taken.columns], ["radix", "key", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "radix int, key long, place int, word binary, n long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of one key each, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and (last or held[-1].column(0)[-1].as_py() != key[0]):
            cut = int(np.searchsorted(key, held[-1].column(0)[-1].as_py(), "right")) if not last else last
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
            b = b.slice(cut)
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
            b = b.slice(last)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _left(word: bytes, place: int) -> bytes:
    return word if place < 0 else word[:place] + word[place + 1 :]


def near_in_runs(key: np.ndarray, place: np.ndarray, words: list[bytes], n: np.ndarray) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(word, near words, occurrences of the most frequent of them, that word) for what the runs of one key show; sorted by key."""
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if z - a < 2:
            continue
        same: dict[bytes, list[int]] = {}  # one, unless hashes collide
        for i in range(a, z):
            same.setdefault(_left(words[i], int(place[i])), []).append(i)
        for rows in same.values():
            if len(rows) < 2:
                continue
            at: dict[int, list[int]] = {}
            for i in rows:
                at.setdefault(int(place[i]), []).append(i)
            best = lambda ids: min(ids, key=lambda i: (-int(n[i]), words[i]))
            for where, ids in at.items():
                if where >= 0 and len(ids) > 1:
                    top = best(ids)
                    second = best([i for i in ids if i != top])
                    for i in ids:
                        to = second if i == top else top
                        yield words[i], len(ids) - 1, int(n[to]), words[to]
            if owner := at.get(-1):
                o = owner[0]
                longer = [i for i in rows if place[i] == 0 or place[i] > 0 and words[i][place[i]] != words[i][place[i] - 1]]
                if longer:
                    top = best(longer)
                    yield words[o], len(longer), int(n[top]), words[top]
                    for i in longer:
                        yield words[i], 1, int(n[o]), words[o]


def near_words(words: DataFrame, mask: int = (1 << 64) - 1) -> DataFrame:
    """word, n_near, best struct<less, word>: of each word that has near ones, their number and the most frequent of them; less is minus its n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key = t.column("key").to_numpy()
            # a run of one row has nothing to compare
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            t = t.filter(pa.array(twin))
            found = list(near_in_runs(t.column("key").to_numpy(), t.column("place").to_numpy(), t.column("word").to_pylist(), t.column("n").to_numpy()))
            for i in range(0, len(found), 50_000):
                word, near, most, best = zip(*found[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(near, pa.int64()), pa.array(most, pa.int64()), pa.array(best, pa.binary())], ["word", "near", "most", "best"])

    dealt = keyed(words, mask).repartition("radix").drop("radix").sortWithinPartitions("key", "place")
    found = dealt.mapInArrow(run, "word binary, near long, most long, best binary")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of word, form ends. Chains have no cycles, as forms are the more frequent."""
    steps = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, mask: int = (1 << 64) - 1) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word with at least `letters` letters and `occurrences`."""
    words = materialise(word_counts(docs, letters).where(F.col("n") >= occurrences), "spelling-words")
    near = near_words(words, mask)
    most = -F.col("best.less")
    linked = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(most >= ratio * F.col("n"), F.col("best")).alias("to"))
    linked = materialise(linked.select("word", "n", "n_near", F.col("to.word").alias("form"), (-F.col("to.less")).alias("form_n")), "spelling-links")
    ends = roots(linked.where("form is not null"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = linked.join(ends, "word", "left")
    return out.select(text("word").alias("word"), text("form").alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
