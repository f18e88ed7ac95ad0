"""Line dedup: lines whose normalised form is in many documents go from all of them.

Each document's lines are normalised and made distinct within its row, exploded, hashed, and the documents of each hash are
counted, so a line that every document has is pre-aggregated before the shuffle. Hashes over the threshold are joined with the
exploded lines; what goes back to a document is the positions of its dropped lines, and the rest is put together again by
position. Hashes have 128 bits (two of 64 under different seeds), so no line goes by chance.

The list of hashes is broadcast up to a counted size and joined by a shuffle beyond it. Texts are shuffled once, by their place
(file and row). Putting a text together takes time in proportion to it, however many of its lines go.

Defined results: every row is a document, whatever rows share its doc_id or lack one, so repeated rows count each; null and
empty texts are one empty line; a document that loses all lines has an empty text. Keys under min_chars stay (at least 1, so
empty lines always do). Empty tables give no rows. Columns of docs pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, known_size, materialise, placed, text_or_empty

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A document must have a line in common with so many documents, itself included, to lose it; shorter keys are kept.
MIN_DOCS, MIN_CHARS = 10, 1


def lines_of(text: Column | str) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n_docs of each line key that is in at least min_docs documents."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines_of("text"), line_key))).alias("key"))
    keys = keys.where(F.length("key") >= max(1, min_chars)).select(*_digest(F.col("key")))
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _without(lines: Column, positions: Column) -> Column:
    """lines without those at positions, which are sorted: the slices between them, so in linear time."""
    ends = lambda ls: F.zip_with(F.concat(F.array(F.lit(-1)), positions), F.concat(positions, F.array(F.size(ls))), lambda a, z: F.slice(ls, a + 2, z - a - 1))
    return F.transform(F.array(lines), lambda ls: F.flatten(ends(ls)))[0]


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs' columns with text cut, n_lines (before), and dropped array<int>: numbers of the lines that went, from 0.

    Where docs has columns of these names the new ones are called _n_lines and _dropped.
    """
    place, n_name, gone = fresh("place", docs), fresh("n_lines", docs), fresh("dropped", docs)
    rows = placed(docs, place)
    common = materialise(common_lines(rows, min_docs, min_chars).select("h1", "h2"), "common-lines")
    lines = rows.select(F.col(place).alias("at"), F.posexplode(lines_of("text")).alias("pos", "line"))
    lines = lines.select("at", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= max(1, min_chars))
    marks = lines.select("at", "pos", *_digest(F.col("key"))).join(known_size(common), ["h1", "h2"])
    marks = marks.groupBy("at").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    marks = marks.select(F.col("at").alias(f"{place}_"), F.col("positions").alias(gone))
    joined = rows.join(marks, rows[place] == marks[f"{place}_"], "left").drop(place, f"{place}_")
    positions = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_without(lines_of("text"), positions), "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.size(lines_of("text")).alias(n_name), positions.alias(gone))
