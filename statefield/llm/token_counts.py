"""Edit-aware token counts: a segment tree of pre-token runs per document.

Leaves are runs of chunks, which lie between single spaces where the pre-token pattern always cuts; every node has the
sums of characters and tokens below it. An edit descends by character sums to the leaves it touches, re-encodes only the
touched chunks and one chunk of context on either side, and updates the sums on the way up. The count equals that of
encoding the edited text anew, as a chunk before and after the touched ones keeps its outer boundary.

Defined results: null text counts as empty; an edit is (pos, delete, insert) in code points of the text as edited so far;
positions beyond the end count as the end, null or negative numbers as 0, null insert as empty; null edits are none.
Strings of special tokens are ordinary text here. Repeated rows are counted once each; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNSAFE, Encoder, encoder
from .common import small_batches

LEAF = 32
_CUT = re.compile(r"(?<=\S)(?= \S)")
SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, chunks long, chunks_encoded long"


def counter(path: str) -> Encoder:
    return encoder(path, special=False, plain=True)


def chunks_of(text: str) -> list[str]:
    """The parts of text between single spaces, each with the space before it."""
    if not text:
        return []
    if UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [*([first] if first else ()), *[" " + c for c in rest]]


class CountTree:
    """The token count of one text under edits."""

    def __init__(self, text: str, enc: Encoder, counts: list[int] | None = None, leaf: int = LEAF):
        self.enc = enc
        chunks = chunks_of(text)
        counts = self._counts(chunks) if counts is None else counts
        self.chunks, self.encoded = len(chunks), 0
        self.leaves = ["".join(chunks[i : i + leaf]) for i in range(0, len(chunks), leaf)] or [""]
        sums = [sum(counts[i : i + leaf]) for i in range(0, len(chunks), leaf)] or [0]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [""] * (self.base - len(self.leaves))
        pad = [0] * (self.base - len(sums))
        self.chars = [0] * self.base + [len(x) for x in self.leaves]
        self.tokens = [0] * self.base + sums + pad
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _counts(self, chunks: list[str]) -> list[int]:
        return [sum(v) for v in self.enc.counts(chunks)]

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that has the character at pos, and where it begins."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        i = self.base + leaf
        self.leaves[leaf], self.chars[i], self.tokens[i] = text, len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, pos: int, delete: int, insert: str) -> None:
        n = self.chars[1]
        pos = min(max(pos, 0), n)
        end = min(n, pos + max(delete, 0))
        first, start = self._find(pos)
        last = self._find(end)[0]
        while True:  # widened until a whole chunk lies on either side, or the text ends
            work = "".join(self.leaves[first : last + 1])
            cuts = [0, *(m.start() for m in _CUT.finditer(work)), len(work)]
            a, b = pos - start, end - start
            before = [c for c in cuts if c < a]
            after = [c for c in cuts if c > b]
            more_left = len(before) < 2 and first > 0
            more_right = len(after) < 2 and last < self.base - 1 and any(self.leaves[last + 1 :])
            if not more_left and not more_right:
                break
            if more_left:
                first -= 1
                start -= len(self.leaves[first])
            if more_right:
                last += 1
        lo = before[-2] if len(before) > 1 else 0
        hi = after[1] if len(after) > 1 else len(work)
        region = work[lo:a] + insert + work[b:hi]
        old, new = chunks_of(work[lo:hi]), chunks_of(region)
        tokens = sum(self.tokens[self.base + first : self.base + last + 1]) - sum(self._counts(old)) + sum(self._counts(new))
        self.encoded += len(new)
        self._set(first, work[:lo] + region + work[hi:], tokens)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)


def count_tokens(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Counts before and after the edits of each row; edits: array<struct<pos int, delete int, insert string>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = counter(path)
        for b in small_batches(batches, "text"):
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for doc, text, counts, todo in zip(b.column(0).to_pylist(), texts, enc.counts(texts), b.column(2).to_pylist()):
                tree = CountTree(text, enc, counts)
                n = tree.n_tokens
                for e in todo or ():
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append((doc, n, len(todo or ()), tree.n_tokens, tree.chars[1], tree.chunks, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col(edits).alias("edits")).mapInArrow(run, SCHEMA)


def standard_edits(text: str = "text"):
    """Three edits of each text, as a column: a note in the middle, a deletion at a quarter, a new ending."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    edit = lambda pos, delete, insert: F.struct(pos.cast("int").alias("pos"), F.lit(delete).alias("delete"), F.lit(insert).alias("insert"))
    return F.array(edit(F.floor(n / 2), 0, " [note 1]"), edit(F.floor(n / 4), 10, ""), edit(n - 1, 5, "... done"))
