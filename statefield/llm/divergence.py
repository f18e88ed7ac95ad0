"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

A group is a language and a source. Of a language's kept terms each group has smoothed shares p, as integers, and two groups
differ by f = (p - q)^2 / (p + q), floored, summed over all terms. Nearly all counts are zero, so no group is compared term by
term: a pair starts at V times the f of zero counts, and an inverted index corrects it. Terms that one of the two groups has
count by their numbers: a group's terms are summed up by their share before they meet other groups. Terms that both have
come from the postings of the term, and carry what is then wrong with the two former. All of it is sums of whole numbers,
pre-aggregated part by part, so the result is exact.

Terms are counted where the texts are, in Python over Arrow batches, and leave a task as counts by language, source and term.
Pairs, and postings of frequent terms, are dealt by tiles of TILE sources, so no task holds more than two tiles of a key,
whatever the number of sources. The table of groups is broadcast up to a counted size. The ten most telling terms of a
group come from a window, which limits each task's rows before the shuffle.

Defined results: every row is a document; null text, lang and source count as ''; a group without terms takes part with
counts of zero; a language whose terms are all rare has pairs of value 0; a language of one source has no pairs. Ties go by
the item's UTF-8 bytes. Repeated rows count each. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import known_size, materialise, small_batches, text_or_empty

#: Letters, and all bytes of code points beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counts held before a task hands them on.
HELD = 400_000
#: Sources compared in one task.
TILE = 512
#: Groups up to which their table is broadcast, some 10 MB; beyond it is joined by a shuffle.
GROUPS = 100_000
MIN_DOCS, TOP = 10, 10


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); null columns count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each group and term: occurrences, and from bit 32 on the documents
        counts: dict[tuple[str, str], dict[bytes, int]] = {}

        def take() -> Iterator[pa.RecordBatch]:
            for group, found in counts.items():
                columns = [pa.array([x] * len(found), pa.string()) for x in group]
                both = np.fromiter(found.values(), np.int64, len(found))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found), pa.binary()), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)], ["lang", "source", "term", "n", "docs"])
            counts.clear()

        held = 0
        for b in small_batches(batches, "text"):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = counts.setdefault((lang, source), {})
                before, get = len(own), own.get
                for term, n in Counter(_TERM.findall(text.as_py().lower())).items():
                    own[term] = get(term, 0) + n + (1 << 32)
                held += len(own) - before
                if held > HELD:
                    yield from take()
                    held = 0
        yield from take()

    rows = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(c) for c in ("lang", "source")), text_or_empty("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """p of a count, in thousand millionths: exact, as counts may exceed what a long holds times 10^9."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = (whole(F.lit(1_000_000_000)) * whole(count + 2)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, whole(total + 2 * kinds))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tiled(df: DataFrame, own: str, other: str, up: bool) -> DataFrame:
    """df once for each tile that its rows' tile meets: those from its own on, or those up to its own."""
    tiles = F.sequence(F.col("tile"), F.col("tiles") - 1) if up else F.sequence(F.lit(0), F.col("tile"))
    return df.withColumn(own, F.col("tile")).withColumn(other, F.explode(tiles)).drop("tile", "tiles")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = materialise(term_counts(docs), "term-counts")
    groups = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(c) for c in ("lang", "source"))).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    kept = materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    # one row a language and one a group
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    info = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
    info = info.select("lang", "source", zero("total"), zero("kinds"), zero("lang_total"), "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"))
    p0 = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(F.lit(1))
    info = materialise(info.withColumn("p0", p0.cast("long")), "term-groups")
    posted = kept.join(known_size(info, GROUPS), ["lang", "source"])
    posted = posted.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")).alias("q"), "p0", "tile", "tiles")

    left = _tiled(info.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "kinds", "tile", "tiles"), "ta", "tb", True)
    right = _tiled(info.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"), "tile", "tiles"), "tb", "ta", False)
    once = (F.col("ta") < F.col("tb")) | (F.col("a") < F.col("b"))
    pairs = materialise(left.join(right, ["lang", "ta", "tb"]).where(once).select("lang", "a", "b", "a0", "b0", "kinds"), "term-pairs")
    a, b, a0, b0 = (F.col(c) for c in ("p_a", "p_b", "a0", "b0"))
    base = pairs.select("lang", "a", "b", (F.col("kinds") * gap(a0, b0)).alias("value"))
    alike = posted.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    alike = materialise(alike, "term-shares")
    of_a = pairs.join(alike.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", (F.col("m") * (gap(F.col("p"), b0) - gap(a0, b0))).alias("value"))
    of_b = pairs.join(alike.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", (F.col("m") * (gap(a0, F.col("p")) - gap(a0, b0))).alias("value"))
    by_a = _tiled(posted.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("p0").alias("a0"), "tile", "tiles"), "ta", "tb", True)
    by_b = _tiled(posted.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("p0").alias("b0"), "tile", "tiles"), "tb", "ta", False)
    both = by_a.join(by_b, ["lang", "term", "ta", "tb"]).where(once).select("lang", "a", "b", (gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0)).alias("value"))
    sums = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (of_a, of_b, both)]
    value = base.unionByName(sums[0]).unionByName(sums[1]).unionByName(sums[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    between = value.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    telling = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return between.withColumn("rank", rank).unionByName(telling.withColumn("rank", rank).where(F.col("rank") <= top))
