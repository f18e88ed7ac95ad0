"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

Distinct words of a batch are inserted into a trie. A depth-first walk gives every node, which is a prefix, the last
token of its encoding and the node before that token: the last token is the one vocabulary entry that ends there and is
compatible with the last token of what precedes it, as an encoding is a chain of compatible neighbours. So shared
prefixes are encoded once, and a word's ids are read off by walking back. Nodes of one depth are taken together, as arrays;
long words go node by node. Encoded words stay in a bounded cache.

Before that, texts are cut at single spaces between other characters, where the pre-token pattern always cuts; what
lies between is looked up whole. Texts with white space runs that make this unsafe are matched by the pattern itself.

Defined results: null text counts as empty and gives no ids; strings of special tokens in a text give the special ids;
decoding replaces bytes that are no UTF-8 as the tokenizers library does, null ids give an empty text, and unknown ids raise.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cached words or chunks of one Python worker; beyond it the cache starts anew.
CACHE = 200_000
#: Bytes of text encoded at a time.
BATCH = 1 << 20
#: Longest word, in bytes, and fewest words that are encoded depth by depth.
LEVELS, FEW = 64, 64
#: Slots for pairs of tokens that were looked at in arrays, a power of two.
SLOTS = 1 << 20
UNSAFE = re.compile(r" (?:\s|\Z)")
#: Chunks of Latin words with marks behind them, line by line, which are cut without the full pattern; no apostrophes.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]+"
_PLAIN = re.compile(rf" ?{_LATIN}(?:{_MARKS})?(?:\n{_LATIN}(?:{_MARKS})?)*")
_PLAIN_WORDS = re.compile(rf" ?{_LATIN}|{_MARKS}|\n")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_names() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t.get("special")}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {bytes(names[c] for c in t): i for t, i in vocab.items()}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.known = np.zeros(self.size, bool)
        self.known[[*self.ids.values(), *self.special.values()]] = True
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.path = path
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}  # at most 4 * CACHE of them
        self._alone: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """The encoding by repeated merging of the lowest-ranked pair."""
        self.prepare()
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, i = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=(0, -1))
            if i < 0:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def prepare(self) -> None:
        """Reads the merges and makes the automaton, once: what takes ids from another encoder does without their memory."""
        if self.ends:
            return
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: rank and halves of the merge that makes it
        self.one_way = True  # whether each token is made by one merge only
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
            self.one_way &= vocab[a + b] not in self.parts
            self.parts[vocab[a + b]] = rank, vocab[a], vocab[b]
        self._suffixes()

    def _suffixes(self) -> None:
        """Automaton over the tokens' prefixes: `step` leads from state and byte on, `ends` has the tokens that end in a state, longest first."""
        self.edges: dict[int, int] = {}
        above, depth, own = [0], [0], [-1]
        for t, i in self.ids.items():
            state = 0
            for byte in t:
                key = state << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(own)
                    above.append(key)
                    depth.append(depth[state] + 1)
                    own.append(-1)
                state = self.edges[key]
            own[state] = i
        self.fail = [0] * len(own)
        self.ends = [()] * len(own)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, byte = above[state] >> 8, above[state] & 255
            f = self.fail[parent]
            while parent and f and f << 8 | byte not in self.edges:
                f = self.fail[f]
            self.fail[state] = f = self.edges.get(f << 8 | byte, 0) if parent else 0
            self.ends[state] = ((own[state], depth[state]), *self.ends[f]) if own[state] >= 0 else self.ends[f]
        self.step = dict(self.edges)
        if self.one_way:
            self._arrays()

    def _arrays(self) -> None:
        """Automaton and merges as arrays, for steps that take many nodes."""
        self.edge_keys = np.array(sorted(self.edges), np.int64)
        self.edge_to = np.array([self.edges[k] for k in self.edge_keys.tolist()], np.int32)
        self.fail_to = np.array(self.fail, np.int32)
        self.end_from = np.cumsum([0, *map(len, self.ends)])
        self.end_token, self.end_length = np.array([e for x in self.ends for e in x], np.int32).reshape(-1, 2).T.copy()
        merges = sorted((a * self.size + b, rank) for (a, b), (rank, _) in self.merges.items())
        self.merge_keys, self.merge_ranks = np.array(merges, np.int64).reshape(-1, 2).T.copy()
        self.part_rank, self.part_left, self.part_right = (np.full(self.size, -1, np.int64) for _ in range(3))
        for i, (rank, a, b) in self.parts.items():
            self.part_rank[i], self.part_left[i], self.part_right[i] = rank, a, b
        self.slot_keys, self.slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.alone = np.full(self.size, -1, np.int8)

    def advance_all(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """`advance` for arrays of states and bytes."""
        out, todo = np.zeros(len(states), np.int32), np.arange(len(states))
        while len(todo):
            keys = states.astype(np.int64) << 8 | data[todo]
            at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            found = self.edge_keys[at] == keys
            out[todo[found]] = self.edge_to[at[found]]
            again = ~found & (states > 0)
            todo, states = todo[again], self.fail_to[states[again]]
        return out

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens b can stand after tokens a, or, where a is -1, at the beginning."""
        out, first = np.zeros(len(a), bool), a < 0
        begin = b[first]
        for t in np.unique(begin[self.alone[begin] < 0]).tolist():
            self.alone[t] = self.starts(t)
        out[first] = self.alone[begin] > 0
        inner = np.flatnonzero(~first)
        keys = a[inner].astype(np.int64) * self.size + b[inner]
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % SLOTS
        fits, unknown = self.slot_fits[slots], np.flatnonzero(self.slot_keys[slots] != keys)
        if len(unknown):
            fits[unknown] = found = self._apart_all(a[inner[unknown]].astype(np.int64), b[inner[unknown]].astype(np.int64))
            where, kept = np.unique(slots[unknown], return_index=True)  # of several pairs with one slot a single one stays
            self.slot_keys[where], self.slot_fits[where] = keys[unknown[kept]], found[kept]
        out[inner] = fits
        return out

    def _apart_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_apart` for arrays."""
        out, todo, before = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), len(self.merges), np.int64)
        while len(todo):
            keys = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            left, right = self.part_rank[a], self.part_rank[b]
            across = (self.merge_keys[at] == keys) & (self.merge_ranks[at] < before)
            none = (left < 0) & (right < 0)
            out[todo[none & ~across]] = True
            go, undo = ~(across | none), right >= left
            before = np.where(undo, right + 1, left)[go]
            a, b, todo = np.where(undo, a, self.part_right[a])[go], np.where(undo, self.part_left[b], b)[go], todo[go]
        return out

    def advance(self, state: int, byte: int) -> int:
        """The state of the longest suffix, with this byte added, that is a prefix of a token."""
        key = state << 8 | byte
        while state and state << 8 | byte not in self.edges:
            state = self.fail[state]
        if len(self.step) > len(self.edges) + 4 * CACHE:
            self.step = dict(self.edges)
        self.step[key] = found = self.edges.get(state << 8 | byte, 0)
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a in an encoding."""
        known = self.pairs.get(a * self.size + b)
        if known is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            known = self._apart(a, b) if self.one_way else self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
            self.pairs[a * self.size + b] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undoes the merges of a and b beside their border, latest first, to see whether one across it would have come before."""
        before = len(self.merges)  # merges across the border that rank before this would have been taken
        while True:
            across = self.merges.get((a, b))
            if across is not None and across[0] < before:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if right is not None and (left is None or right[0] >= left[0]):
                before, b = right[0] + 1, right[1]  # of equal merges the one further left, across the border, comes first
            elif left is not None:
                before, a = left[0], left[2]
            else:
                return True

    def starts(self, a: int) -> bool:
        known = self._alone.get(a)
        if known is None:
            known = self._alone[a] = self.merged(self.bytes[a]) == [a]
        return known


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Trie:
    """Prefixes of the inserted words; nodes are numbered depth first, node 0 is the empty prefix."""

    def __init__(self, vocab: Vocabulary):
        vocab.prepare()
        self.vocab = vocab
        self.last: list[int] = [-1]
        self.back: list[int] = [-1]

    def encode(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word."""
        return {w: np.frombuffer(x, "<u4").tolist() for w, x in self.packed(words).items()}

    def packed(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each word, little-endian unsigned 32-bit."""
        words = sorted(words)
        short = [w for w in words if 0 < len(w) <= LEVELS] if self.vocab.one_way else []
        if len(short) < FEW:
            return self._walk(words)
        return self._walk([w for w in words if not 0 < len(w) <= LEVELS]) | dict(zip(short, self._levels(short)))

    def _levels(self, words: list[bytes]) -> list[bytes]:
        """Ids of sorted words, all nodes of a depth at a time. A node is new where a word leaves the one before it."""
        v, n = self.vocab, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        most = int(size.max())
        text = np.array(words, f"S{most}").view(np.uint8).reshape(n, most)
        same = text[1:] == text[:-1]
        shared = np.zeros(n, np.int64)
        shared[1:] = np.minimum(np.where(same.all(1), most, same.argmin(1)), np.minimum(size[1:], size[:-1]))
        nodes = 1 + int((size - shared).sum())
        states, last, back, tokens = np.zeros(nodes, np.int32), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        at, made = np.zeros((most + 1, n), np.int32), 1  # the node of each word at each depth
        for depth in range(1, most + 1):
            new = (shared < depth) & (size >= depth)
            at[depth] = made - 1 + np.cumsum(new)
            rows = np.flatnonzero(new)
            reached = v.advance_all(states[at[depth - 1, rows]], text[rows, depth - 1])
            states[made : made + len(rows)] = reached
            todo, k, stop = np.arange(len(rows)), v.end_from[reached], v.end_from[reached + 1]
            while len(todo):
                if (k >= stop).any():
                    row = rows[todo[np.argmax(k >= stop)]]
                    raise ValueError(f"no token ends {words[row][:depth]!r}")
                token, node = v.end_token[k], at[depth - v.end_length[k], rows[todo]]
                fits = v.fit_all(last[node], token)
                hit, before = made + todo[fits], node[fits]
                last[hit], back[hit], tokens[hit] = token[fits], before, tokens[before] + 1
                todo, k, stop = todo[~fits], k[~fits] + 1, stop[~fits]
            made += len(rows)
        node = at[size, np.arange(n)]
        ends = np.cumsum(tokens[node], dtype=np.int64)
        ids, where = np.zeros(int(ends[-1]), "<u4"), ends - 1
        while len(node):
            ids[where] = last[node]
            node, where = back[node], where - 1
            node, where = node[node > 0], where[node > 0]
        data, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _walk(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of sorted words. Sorted insertion visits the trie depth first; `path` holds the nodes above the current one."""
        out: dict[bytes, bytes] = {}
        vocab, last, back, size = self.vocab, self.last, self.back, self.vocab.size
        pairs, ends, follows, starts = vocab.pairs, vocab.ends, vocab.follows, vocab.starts
        path, states, before = [0], [0], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            state, step = states[shared], vocab.step
            for depth in range(shared + 1, len(word) + 1):
                state = step.get(state << 8 | word[depth - 1], -1)
                if state < 0:
                    state, step = vocab.advance(states[-1], word[depth - 1]), vocab.step
                for token, length in ends[state]:
                    node = path[depth - length]
                    if node:
                        fits = pairs.get(last[node] * size + token)
                        if fits is None:
                            fits = follows(last[node], token)
                    else:
                        fits = starts(token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                path.append(len(last))
                states.append(state)
                last.append(token)
                back.append(node)
            ids, node = [], path[-1]
            while node:
                ids.append(last[node])
                node = back[node]
            out[word] = array("I", ids[::-1]).tobytes()
            before = word
        return out


class _Cells(dict):
    """Chunk -> its ids, little-endian unsigned 32-bit. An unknown chunk gets an empty cell, which `new` lists for filling."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> bytearray:
        cell = self[chunk] = bytearray()
        self.new.append(chunk)
        return cell


class Encoder:
    """Encodes texts. Words come from the trie, or where `plain` is set from tiktoken with the same vocabulary."""

    def __init__(self, path: str, special: bool = True, plain: bool = False):
        self.vocab = vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.special = self.vocab.split_special if special else None
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=self.vocab.ids, special_tokens={}) if plain else None
        self.words: dict[str, bytes] = {}
        self.spaced = _Cells()  # by what follows a space
        self.other = _Cells()

    def _learn(self) -> None:
        """Fills the cells that are new."""
        todo = [(" " + c, self.spaced[c]) for c in self.spaced.new] + [(c, self.other[c]) for c in self.other.new]
        self.spaced.new, self.other.new = [], []
        if self.plain:
            for chunk, cell in todo:
                cell += array("I", self.plain.encode_ordinary(chunk)).tobytes()
            return
        if len(self.words) > CACHE:
            self.words.clear()
        cut = [(_PLAIN_WORDS.findall(c) if _PLAIN.fullmatch(c) else self.pattern.findall(c), cell) for c, cell in todo]
        known = self.words
        new = {w for words, _ in cut for w in words if w not in known}  # a set less the keys would walk all keys
        for w, ids in Trie(self.vocab).packed([w.encode() for w in new]).items():
            known[w.decode()] = ids
        for words, cell in cut:
            cell += b"".join([known[w] for w in words])

    def cells(self, texts: Iterable[str]) -> list[list[bytes | bytearray]]:
        """For each text the ids of its chunks, in order."""
        if len(self.spaced) > CACHE:
            self.spaced = _Cells()
        if len(self.other) > CACHE // 4:
            self.other = _Cells()
        spaced, other, out = self.spaced.__getitem__, self.other.__getitem__, []
        for text in texts:
            got: list[bytes | bytearray] = []
            parts = self.special.split(text) if self.special and text else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    got.append(array("I", [self.vocab.special[part]]).tobytes())
                elif part and UNSAFE.search(part):
                    got += map(other, _CUT.split(part))
                elif part:
                    first, *rest = part.split(" ")
                    if first:
                        got.append(other(first))
                    got += map(spaced, rest)
            out.append(got)
        if self.spaced.new or self.other.new:
            self._learn()
        return out

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        return [b"".join(v) for v in self.cells(texts)]

    def counts(self, texts: Iterable[str]) -> list[list[int]]:
        """For each text the number of ids of each of its chunks."""
        return [[len(c) // 4 for c in v] for v in self.cells(texts)]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.vocab.size or not self.vocab.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        table = self.vocab.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str, special: bool = True, plain: bool = False) -> Encoder:
    """The encoder of this Python process, with its caches."""
    return Encoder(path, special, plain)


def forget() -> None:
    """Drops the encoders of this Python process."""
    encoder.cache_clear()
    vocabulary.cache_clear()


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' doc_id with ids array<int>, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in small_batches(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(enc.ids(t or "" for t in b.column(1).to_pylist()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, text as decoded from the ids, one row for each row of docs: encode and decode in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in small_batches(batches, "text", BATCH):
            ids = enc.ids(t or "" for t in b.column(1).to_pylist())
            texts = pa.array([enc.decode(np.frombuffer(x, "<i4")) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), texts], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of encoded, and text decoded from its ids array<int>; a column named text is replaced."""
    keep = [c for c in encoded.columns if c != "text"]
    frame = encoded.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        at = keep.index("ids")
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [enc.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", text string"
    return frame.mapInArrow(run, schema)
