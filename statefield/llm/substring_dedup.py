"""Substring dedup by hashing lines and the sentences in them.

Units are lines, cut further at sentence ends, and where a sentence is long after words whose digest is the least of some
WINDOW words in a row, so that a passage is cut alike wherever it stands. They are lower-cased, with white space as one
space. Digests of all units are grouped globally; the earliest occurrence, ranked by doc_id and place, stays. Later ones
are seeds of runs: a run is consecutive later occurrences, units too short to count in between included. It is extended
word by word on both sides as far as the text there equals that around the earliest occurrence of its first and last unit;
runs that then touch are one, and a run goes if it has run_words words. So passages that many documents share go, wherever
in a sentence they begin and end, while a short line that happens to recur stays.

A passage of 51 words holds a whole sentence or 26 words of a long one, of which the windows cut a unit out; so it has a
seed within CONTEXT words of either end, unless all such units are of under unit_words words. Where the first unit of a
run has an earliest occurrence elsewhere, in other words, the run isn't extended on that side.

The documents are parsed for their digests once, which are written; two shuffles of digests, one of the texts for the words
around earliest occurrences that runs end with, and one of the texts with their marks. Hot digests are pre-aggregated, and
the joins back to the units and to the words around them are ones that adaptive execution splits. Marks carry the digest and
are checked against the text. Digests have 64 bits: no unit has run_words words, so text goes only where two in a row agree.

With run_words 0 every later occurrence of a unit goes, however short; the default spares lines that merely recur.

Defined results: null text counts as empty and comes back as it was; rows of one doc_id count as one document; rows
without doc_id rank last and share one rank, so among themselves they keep their units. Empty tables give no rows.
Columns of docs pass through whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small_batches, tidy

_END = re.compile(r"(?<=[.!?])[^\S\n]+|\s*\n\s*")
_WORD = re.compile(r"\S+")
#: Sentences of more words are cut, at least once in WINDOW words. 2 * WINDOW - 1 words of a passage hold two cuts of its own.
LONG, WINDOW = 24, 12
#: Units of fewer words aren't looked up; they go along within a run.
UNIT_WORDS = 4
#: Least words of a run that goes.
RUN_WORDS = 25
#: Words before and after an earliest occurrence that runs are compared with.
CONTEXT = 51


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of each unit, in order."""
    out, at = [], 0
    for start, end in [m.span() for m in _END.finditer(text)] + [(len(text), len(text))]:
        words = text[at:start].lower().split()
        if len(words) > LONG:
            _cut_long(text, at, start, out)
        elif words:
            out.append((at, start, len(words), " ".join(words)))
        at = end
    return out


def _cut_long(text: str, start: int, end: int, out: list[tuple[int, int, int, str]]) -> None:
    """Cuts a long sentence after each word whose digest is the least, the last one if equal, of some WINDOW words in a row."""
    places = [m.span() for m in _WORD.finditer(text, start, end)]
    words = [text[s:e].lower() for s, e in places]
    h = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
    cuts, least = [], -1
    for i in range(len(h) - WINDOW + 1):
        last = i + WINDOW - 1
        if least < i:
            window = h[i : last + 1]
            least = last - window[::-1].index(min(window))
        elif h[last] <= h[least]:
            least = last
        else:
            continue
        cuts.append(least + 1)
    at = 0
    for cut_at in [*cuts, len(words)]:
        if cut_at > at:
            out.append((places[at][0], places[cut_at - 1][1], cut_at - at, " ".join(words[at:cut_at])))
            at = cut_at


def digest(unit: str) -> int:
    d = xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"))
    return d - (1 << 64) if d >> 63 else d


def unit_digests(docs: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """doc_id, pos, digest of each unit that is looked up; they are written, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            ends, places, digests = [0], [], []
            for text in b.column(1).to_pylist():
                for pos, (_, _, words, unit) in enumerate(units(text or "")):
                    if words >= unit_words:
                        places.append(pos)
                        digests.append(digest(unit))
                ends.append(len(places))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(digests, pa.int64()))], ["doc_id", "pos", "digest"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(run), "doc_id long, pos array<int>, digest array<long>")
    return materialise(found, "substring-units").select("doc_id", F.explode(F.arrays_zip("pos", "digest")).alias("u")).select("doc_id", "u.pos", "u.digest")


def contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """digest, around struct<before, after>: the CONTEXT words before and after the units at places (first_doc, first_pos)."""
    asked = places.groupBy(F.col("first_doc").alias("_doc")).agg(F.collect_set("first_pos").alias("_at"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text")).join(asked, F.col("_id") == F.col("_doc")).select("text", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            digests, before, after = [], [], []
            for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = units(text or "")
                for start, end, _, unit in (found[p] for p in at if p < len(found)):
                    digests.append(digest(unit))
                    before.append(_words_before(text, start))
                    after.append(_words_after(text, end))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], ["digest", "before", "after"])

    found = rows.mapInArrow(tidy(run), "digest long, before string, after string")
    return found.groupBy("digest").agg(F.min(F.struct("before", "after")).alias("around"))


def _words_before(text: str, at: int) -> str:
    """The CONTEXT words that end at `at` or before, normalised."""
    size = 16 * CONTEXT
    while True:
        lo = max(0, at - size)
        words = text[lo:at].lower().split()
        if lo == 0 or len(words) > CONTEXT:  # the first one may lack its beginning
            return " ".join(words[-CONTEXT:])
        size *= 4


def _words_after(text: str, at: int) -> str:
    size = 16 * CONTEXT
    while True:
        words = text[at : at + size].lower().split()
        if at + size >= len(text) or len(words) > CONTEXT:
            return " ".join(words[:CONTEXT])
        size *= 4


def _equal(a: list[str], b: list[str]) -> int:
    """Number of equal words from the start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def removed_runs(text: str, marks: dict[int, set[int]], unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, around: dict[int, tuple[str, str]] | None = None) -> list[tuple[int, int]]:
    """Spans of text that go, in code points, given the digests marked at unit positions.

    around: the words before and after the earliest occurrence of digests.
    """
    around, runs, at = around or {}, [], 0
    found = False
    for pos, (_, _, n, unit) in enumerate(units(text)):
        if pos in marks and (d := digest(unit)) in marks[pos]:
            if not found:
                runs.append([at, at, d, d])
                found = True
            runs[-1][1], runs[-1][3] = at + n, d
        elif n >= unit_words:
            found = False
        at += n
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    word = lambda i: text[slice(*places[i])].lower()
    merged: list[list[int]] = []
    for a, b, first, last in runs:
        before, after = around.get(first, ("", ""))[0].split(), around.get(last, ("", ""))[1].split()
        a -= _equal([word(i) for i in range(a - 1, max(-1, a - 1 - len(before)), -1)], before[::-1])
        b += _equal([word(i) for i in range(b, min(len(places), b + len(after)))], after)
        while merged and merged[-1][1] >= a:
            a, b = min(a, merged[-1][0]), max(b, merged.pop()[1])
        merged.append([a, b])
    return [(places[a][0], places[b - 1][1]) for a, b in merged if b - a >= run_words]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """What is left of text; white space after a span goes with it."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        while e < len(text) and text[e].isspace():
            e += 1
        at = e
    return "".join([*out, text[at:]])


def substring_dedup(docs: DataFrame, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """docs' columns with text cut, and removed array<struct<start, end>>: spans of the original text, in code points.

    Where docs has a column removed, the new one is called _removed.
    """
    found = unit_digests(docs, unit_words)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").select(F.col("digest").alias("d"), "first")
    later = found.join(first, F.col("digest") == F.col("d")).where((rank != F.col("first")) & F.col("doc_id").isNotNull())
    later = later.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "digest", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")))).alias("marks"))
    later = materialise(later, "substring-marks")
    # runs end where the unit beside isn't the one beside the earliest occurrence, or has no mark
    beside = lambda x, y: F.coalesce((y["pos"] - x["pos"] == 1) & (y["first_doc"] == x["first_doc"]) & (y["first_pos"] - x["first_pos"] == 1), F.lit(False))
    ends = F.filter("marks", lambda x, i: ~(beside(F.get("marks", i - 1), x) & beside(x, F.get("marks", i + 1))))
    ends = later.select("doc_id", F.explode(ends).alias("m")).select("doc_id", "m.digest", "m.first_doc", "m.first_pos").distinct()
    ends = materialise(ends, "substring-ends")
    around = materialise(contexts(docs, ends.select("first_doc", "first_pos")), "substring-contexts")
    around = ends.select("doc_id", "digest").join(around, "digest").groupBy(F.col("doc_id").alias("_with")).agg(F.collect_list(F.struct("digest", "around.before", "around.after")).alias("_around"))
    own, marked, with_ = fresh("doc", docs), fresh("marks", docs), fresh("around", docs)
    marks = later.select(F.col("doc_id").alias(own), F.transform("marks", lambda m: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest"))).alias(marked))
    marks = marks.join(around, F.col(own) == F.col("_with"), "left").select(own, marked, F.col("_around").alias(with_))
    keep = docs.columns
    joined = docs.join(marks, docs["doc_id"].cast("long") == marks[own], "left").select(*(docs[c] for c in keep), marks[marked], marks[with_])
    at, first_mark, removed_name = keep.index("text"), len(keep), fresh("removed", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            texts, removed = b.column(at).to_pylist(), []
            for i, (marks_of, around_of) in enumerate(zip(b.column(first_mark).to_pylist(), b.column(first_mark + 1).to_pylist())):
                spans: list[tuple[int, int]] = []
                if marks_of and texts[i]:
                    by_pos: dict[int, set[int]] = {}
                    for m in marks_of:
                        by_pos.setdefault(m["pos"], set()).add(m["digest"])
                    spans = removed_runs(texts[i], by_pos, unit_words, run_words, {x["digest"]: (x["before"], x["after"]) for x in around_of or ()})
                    texts[i] = cut(texts[i], spans)
                removed.append([{"start": s, "end": e} for s, e in spans])
            cols = list(b.columns[:first_mark])
            cols[at] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, kind)], [*keep, removed_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{removed_name}` array<struct<start:int,end:int>>"
    return joined.mapInArrow(tidy(run), schema)
