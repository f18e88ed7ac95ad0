"""Each registered query on the smallest driver tables, against its contract worked out by hand."""

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from statefield.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ask(spark):
    def run(name):
        df = queries.queries()[name](spark, SF)
        return dict(df.dtypes), df.collect()

    return run


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, ask):
    kinds, got = ask("op1_language_id")
    assert kinds["language"] == "string" and kinds["confidence"] == "double" and kinds["rejected"] == "boolean"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    told = {i: m[1] for i, h in pages.items() if (m := re.search(r'<html[^>]*\blang="?([a-z]+)', h or ""))}
    assert np.mean([r.language == told[r.page_id] for r in got if r.page_id in told]) > 0.95


def test_op2(ask, documents, library):
    kinds, got = ask("op2_bpe")
    assert (kinds["doc_id"], kinds["n_tokens"], kinds["ids_sha256"], kinds["decoded_sha256"]) == ("bigint", "bigint", "string", "string")
    want = []
    for i, t in documents:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def parted(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split(r"[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :])[0]


def test_op3(spark, ask):
    kinds, got = ask("op3_url_filter")
    assert all(kinds[c] == "string" for c in ("host", "path", "rule", "verdict"))
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for r in pages:
        host, path = parted(r.url)
        fits = [(len(h + p), h + p, v) for h, p, v in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[r.page_id] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_op4(ask, documents):
    import xxhash

    kinds, got = ask("op4_simhash")
    assert (kinds["doc_id"], kinds["fingerprint"], kinds["component_id"]) == ("bigint", "string", "bigint")
    prints = {}
    for i, t in documents:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).encode())
        s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    label = {i: i for i in prints}
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", label[i]) for i in ids)


def test_op5(spark, ask):
    kinds, got = ask("op5_ann")
    assert (kinds["query_id"], kinds["rank"], kinds["vec_id"], kinds["score"]) == ("bigint", "int", "bigint", "double")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    n = np.sqrt((x * x).sum(1))
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x * x[i]).sum(1) / (n * n[i])
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want |= {(int(ids[i]), k): (int(ids[j]), float(s[j])) for k, j in enumerate(best, 1)}
    assert {(r.query_id, r.rank): r.vec_id for r in got} == {k: v for k, (v, _) in want.items()} and len(got) == len(want)
    assert all(abs(r.score - want[r.query_id, r.rank][1]) < 1e-12 for r in got)


def test_op6(spark, ask):
    kinds, got = ask("op6_html_extract")
    assert (kinds["page_id"], kinds["text"], kinds["n_chars"]) == ("bigint", "string", "bigint")
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted((r.page_id, r.url) for r in got) == sorted(pages.items()) and all(r.n_chars == len(r.text) for r in got)
    assert all(t == " ".join(t.split()) and t for r in got if r.text for t in r.text.split("\n"))


def test_op7(ask, documents, library):
    _, got = ask("op7_token_counts")
    library.encode_special_tokens = True
    found, want = [], []
    for r in got:
        found.append((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited))
    for i, t in documents:
        n = len(t)
        e = t[: n // 2] + " [note 1]" + t[n // 2 :]
        e = e[: n // 4] + e[n // 4 + 10 :]
        at = min(max(n - 1, 0), len(e))
        e = e[:at] + "... done" + e[at + 5 :]
        want.append((i, *(len(library.encode(x, add_special_tokens=False).ids) for x in (t, e)), len(e)))
    library.encode_special_tokens = False
    assert sorted(found) == sorted(want)


def test_op8(ask, documents):
    _, got = ask("op8_substring_dedup")
    texts = dict(documents)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = [(s["start"], s["end"]) for s in json.loads(r.removed_spans)]
        assert len(spans) == r.n_removed
        left = "".join(texts[r.doc_id][a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), None]))
        assert (r.text or "").split() == left.split()
        for s, e in spans:  # what goes is in an earlier document
            part = texts[r.doc_id][s:e].lower().split()
            assert len(part) >= 25 and any(" ".join(part[:4]) in " ".join(t.lower().split()) for i, t in documents if i <= r.doc_id)


def test_op9(ask, documents, library):
    kinds, got = ask("op9_packing")
    assert set(kinds[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")) == {"bigint"}
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in documents}
    pieces, rooms = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        rooms[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((v, len(ids[k])) for k, v in pieces.items()), *((v, None) for v in rooms.values())]:
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == total if total is not None else at <= 1024
    assert set(pieces) == set(ids)
    filled = sum(map(len, ids.values()))
    assert len(rooms) * 1024 < 1.05 * filled + 8 * 1024


def test_op10(ask, documents):
    kinds, got = ask("op10_exact_dedup")
    assert (kinds["doc_id"], kinds["keep_id"], kinds["group_size"], kinds["kept"], kinds["text_sha256"]) == ("bigint", "bigint", "bigint", "boolean", "string")
    same = defaultdict(list)
    for i, t in documents:
        same[SPACE.sub(" ", t)].append(i)
    want = [(i, min(v), len(v), i == min(v), sha(t)) for t, v in same.items() for i in v]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))
