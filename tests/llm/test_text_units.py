"""Parts of the text operators that need no Spark session."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statefield.llm import ann, bpe, dom, html_extract, language_id, packing, simhash, substring_dedup, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "the", " hello", "'re", "'", "1", "23", "é", "—", "!", "<|endoftext|>", " ", "\x1f", "日本", "🙂", "\x85"]
texts = st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(library, plain):
    enc = bpe.Encoder(BPE, plain=plain)

    @settings(max_examples=300, deadline=None)
    @given(texts)
    def check(text):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(enc.ids([text])[0], "<u4")
        assert got.tolist() == want
        assert enc.decode(got.astype(np.int64)) == library.decode(want, skip_special_tokens=False)

    check()


def test_trie_equals_plain_merging():
    vocab, rng = bpe.vocabulary(BPE), random.Random(1)
    words = {"".join(rng.choice("abcdetion ") for _ in range(rng.randint(1, 14))).encode() for _ in range(500)}
    got = bpe.Trie(vocab).encode(words)
    assert all(got[w] == vocab.merged(w) for w in words)


def test_trie_by_depths_equals_the_walk_and_merging():
    vocab, rng = bpe.vocabulary(BPE), random.Random(2)
    words = {"".join(rng.choice("aebdtionéÿß\0 .") for _ in range(rng.randint(1, 30))).encode()[: bpe.LEVELS] for _ in range(800)}
    words |= {b"a", b"a\0", b"a\0\0", b"\0"}
    by_depth = dict(zip(sorted(words), bpe.Trie(vocab)._levels(sorted(words))))
    assert by_depth == bpe.Trie(vocab)._walk(sorted(words))
    assert all(np.frombuffer(by_depth[w], "<u4").tolist() == vocab.merged(w) for w in words)
    many = words | {b"x" * (bpe.LEVELS + 1), b""}
    assert bpe.Trie(vocab).packed(many) == bpe.Trie(vocab)._walk(sorted(many))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZéÿ×÷ªʯͰ.,!$%'\n 1_-"), max_size=12))
def test_chunks_of_latin_words_are_cut_as_by_the_full_pattern(chunk):
    if bpe._PLAIN.fullmatch(chunk):
        assert bpe._PLAIN_WORDS.findall(chunk) == bpe.regex.findall(bpe.PATTERN, chunk)


def test_lossy_decoding(library):
    enc = bpe.encoder(BPE)
    ids = np.array([enc.vocab.ids[b"\xe2"], enc.vocab.ids[b"\x82"], 64])
    assert enc.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    with pytest.raises(ValueError):
        enc.decode(np.array([10**6]))


@settings(max_examples=150, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 12), st.lists(st.sampled_from(PIECES), max_size=3).map("".join)), max_size=4))
def test_edited_counts_equal_a_full_count(text, edits):
    enc = token_counts.counter(BPE)
    tree = token_counts.CountTree(text, enc, leaf=2)
    for pos, delete, insert in edits:
        tree.edit(pos, delete, insert)
        q = min(pos, len(text))
        text = text[:q] + insert + text[q + delete :]
        assert tree.text == text
        assert tree.n_tokens == len(enc.ids([text])[0]) // 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=80))
def test_windows_hold_all_items_within_capacity(sizes):
    window, k = packing.pack_block(np.array(sizes), 1024)
    sums = np.bincount(window, weights=sizes, minlength=k)
    assert len(window) == len(sizes) and window.min() >= 0 and window.max() < k and sums.max() <= 1024


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 256, 400)
    sums = packing.difference(sizes, 50)[1]
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8


def test_pieces_cover_each_document_once():
    rng, p, docs = random.Random(3), packing._Packer(5, 1024, 256, 50), {}
    for d in range(120):
        docs[d] = np.arange(rng.choice([1, 3, 200, 1024, 2500]), dtype="<u4").tobytes()
        p.add(d, docs[d])
    p.flush()
    covered, room = {}, {}
    for doc, start, length, crc, n, seq, offset in p.rows:
        part = docs[doc][4 * start : 4 * (start + length)]
        assert crc == zlib.crc32(part) and n == len(docs[doc]) // 4
        covered.setdefault(doc, []).append((start, length))
        room.setdefault(seq, []).append((offset, length))
    for d, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(docs[d]) // 4
    for parts in room.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def naive_fingerprint(text, words=3):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB \t\x0b\né ", max_size=60))
def test_fingerprint(text):
    raw = text.encode()
    assert simhash.fingerprint(simhash.shingle_hashes(raw, 3)) == naive_fingerprint(raw)


def test_tiles_find_every_pair():
    rng = np.random.default_rng(5)
    a = np.unique(np.concatenate([rng.integers(0, 2**62, 300, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 60, 60, dtype=np.uint64))]))
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    got = {(int(i), int(j)) for x, y in simhash.near_pairs(a, 2, tile=16) for i, j in zip(x, y)}
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    assert got == want


def test_similar_links_span_the_components():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4], [9], [9])]
    member, root = simhash.similar_links(np.concatenate(sets), np.array([len(x) for x in sets]), 0.8)
    assert dict(zip(member.tolist(), root.tolist())) == {1: 0, 2: 0, 4: 3}


@pytest.mark.parametrize("similarity", [0.8, 0.9])
@pytest.mark.parametrize("n", [5, 90])
def test_similar_sets_share_a_key(similarity, n):
    rng, missed, pairs = np.random.default_rng(3), 0, 10_000
    for _ in range(pairs):
        both = -int(-2 * n * similarity / (1 + similarity) // 1)
        h = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        missed += not (simhash._keys(h[:n]) == simhash._keys(h[n - both :])).any()
    assert missed <= 2


def test_similar_texts_lie_within_the_radius():
    rng, beyond = np.random.default_rng(4), 0
    for _ in range(3000):
        h = rng.integers(0, 2**64, simhash.SHORT * 5 // 4, dtype=np.uint64)
        beyond += (simhash.fingerprint(h) ^ simhash.fingerprint(h[: simhash.SHORT])).bit_count() > simhash.WIDE
    assert beyond <= 1


def test_units_are_cut_alike_wherever_a_passage_stands():
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("aeiounrst") for _ in range(5)) for _ in range(70))
    one = {u[3] for u in substring_dedup.units("Start here. " + passage + " the end")}
    two = {u[3] for u in substring_dedup.units("something quite different before " + passage)}
    assert sum(len(u.split()) for u in one & two) >= substring_dedup.RUN_WORDS
    for s, e, n, u in substring_dedup.units("One two.  Three\n\nfour five. "):
        assert len(u.split()) == n


def test_runs_below_the_least_words_stay():
    text = "One two three four five. Six seven eight nine ten."
    marks = {i: {substring_dedup.digest(u[3])} for i, u in enumerate(substring_dedup.units(text))}
    assert substring_dedup.removed_runs(text, marks, run_words=11) == []
    assert substring_dedup.cut(text, substring_dedup.removed_runs(text, marks, run_words=10)) == ""
    assert substring_dedup.removed_runs(text, {0: {1}}, run_words=1) == []


@pytest.mark.parametrize("least, most", [(8, 20), (15, 24), (20, 45), (10**6, 10**6)])
def test_passages_inserted_within_sentences_go_whole(least, most):
    rng = random.Random(4)

    def prose(n):
        out, left = [], rng.randint(1, most)
        for _ in range(n):
            out.append("".join(rng.choice("aeiounrst") for _ in range(7)))
            left -= 1
            if not left:
                out[-1] += "."
                left = rng.randint(least, most)
        return out

    for _ in range(200):
        passage = prose(51)
        one, two = prose(150), prose(150)
        a, b = rng.randint(0, 150), rng.randint(0, 150)
        early, late = (" ".join(x[:i] + passage + x[i:]) for x, i in ((one, a), (two, b)))
        places = {substring_dedup.digest(u): (s, e) for s, e, n, u in substring_dedup.units(early) if n >= substring_dedup.UNIT_WORDS}
        around = {d: (substring_dedup._words_before(early, s), substring_dedup._words_after(early, e)) for d, (s, e) in places.items()}
        marks = {i: {substring_dedup.digest(u[3])} for i, u in enumerate(substring_dedup.units(late)) if substring_dedup.digest(u[3]) in around}
        spans = substring_dedup.removed_runs(late, marks, around=around)
        assert substring_dedup.cut(late, spans).split() == two


def test_exact_search_equals_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8))
    x[100:140] = x[50]
    ids, q = np.arange(700) * 3, np.arange(0, 700, 7)

    def search(relax):
        found = ann.Found(x[q], ids[q], 5)
        for part in (slice(0, 250), slice(250, 700)):
            ann.VPTree(ids[part], x[part], leaf=16).search(found, relax)
        return found

    exact = search(1.0)
    n = np.sqrt((x * x).sum(1))
    for i, a in enumerate(q):
        s = (x * x[a]).sum(1) / (n * n[a])
        order = [int(j) for j in np.lexsort((ids, -s)) if j != a][:5]
        assert exact.ids[i].tolist() == ids[order].tolist() and np.allclose(exact.scores[i], s[order])
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(search(3.0).ids.tolist(), exact.ids.tolist())]) > 0.5


def test_leaf_blocks():
    page = "<head><title>No</title></head><body><p>A &amp;\n b<b>c</b><p>D<br>e<div>f<a href=x>g</a></div><script>var a='</p>'</script><!-- h --><ul><li>i<li>j</ul>k"
    got = dom.blocks(page)
    assert [b.text for b in got] == ["A & bc", "D e", "fg", "i", "j", "k"]
    assert got[2].linked == 1 and got[3].path[-1][0] == "li"
    assert dom.blocks("") == [] and [b.text for b in dom.blocks("a < b <p")] == ["a < b <p"]


def test_crf_decodes_like_enumeration_and_extracts_unseen_layouts():
    import itertools

    crf = html_extract.ChainCRF({"x": 1.3, "y": -0.7}, [[0.2, -0.4], [-0.1, 0.5]], [0.1, -0.2])
    for feats in itertools.product([["x"], ["y"], ["x", "y"]], repeat=4):
        score = lambda y: crf.start[y[0]] + sum(sum(crf.weights[f] for f in b) * l for b, l in zip(feats, y)) + sum(crf.transition[p][c] for p, c in zip(y, y[1:]))  # noqa: B023, E731, E741
        assert score(crf.decode(list(feats))) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=4)))
    trained = html_extract.trained()
    held = html_extract.labelled_pages(150, 77)
    right = [a == b for blocks, y in held for a, b in zip(trained.decode(html_extract.features(blocks)), y)]
    assert np.mean(right) > 0.99
    assert html_extract.main_text("", trained) == ""


def hashes(text):
    return np.concatenate(list(language_id.trigrams(text)))


def test_trigrams_take_letters_only(monkeypatch):
    assert len(hashes("123 ... !!!")) == 0 and len(hashes("é")) > 0
    assert np.array_equal(hashes("ABC"), hashes("abc"))
    whole = hashes("ab cde, 12 fgh " * 9)
    monkeypatch.setattr(language_id, "SLICE", 5)
    assert np.array_equal(hashes("ab cde, 12 fgh " * 9), whole)
    assert language_id.plain_text("<script>x</script><p>h&eacute;<!-- no --></p>").split() == ["hé"]


@pytest.mark.parametrize("unit", ["<a ", "<script ", "<!--", "<![CDATA[", "<", "<div>x", "</p>", '<a "', "<html ", "<p><b>&", "<script>"])
@pytest.mark.parametrize("end", ["", ">"])
def test_malformed_pages_take_linear_time(unit, end):
    import time

    page = unit * 60_000 + end
    began = time.process_time()
    html_extract.main_text(page, html_extract.trained())
    language_id.plain_text(page)
    assert time.process_time() - began < 20


def test_what_follows_the_last_tag_is_text():
    text = lambda page: [b.text for b in dom.blocks(page)]
    assert text("<p>a</p>b <i c") == ["a", "b <i c"] and text("<p>a</p>b<!-- c") == ["a", "b"]
    assert text("a<!-- b > c") == ["a"] and text("a<![CDATA[ b > c") == ["a"] and text("a <!-- b --> c <p") == ["a c <p"]
    assert text("<script>a</script b") == []


@pytest.mark.parametrize("holder", ["{}", "<div id=inhalt>{}</div>", '<section class="contenu principal">{}</section>', "<center><font size=2>{}</font></center>", "<table><tr><td><table><tr><td width=80%>{}</td></tr></table></td></tr></table>", '<div class="b7f3 x-2"><section>{}</section></div>'])
def test_articles_without_known_holder(holder):
    """Layouts that no page to train on has: characters of the article found, and of what is found those of the article."""
    crf = html_extract.trained()
    both = found = there = 0
    for page, labels in html_extract.labelled_pages(120, 77, holder):
        for b, got, want in zip(page, crf.decode(html_extract.features(page)), labels):
            both, found, there = both + len(b.text) * (got and want), found + len(b.text) * got, there + len(b.text) * want
    assert both / there > 0.95 and both / found > 0.95


def test_bare_pages_have_text():
    crf = html_extract.trained()
    assert html_extract.main_text("<body><p>The first sentence is here, and calm.</p><p>The second one is long enough, too.</p></body>", crf) == "The first sentence is here, and calm.\nThe second one is long enough, too."
    table = "<body><ul><li><a href=/>Home</a><li><a href=/x>Blog</a></ul><table><tr><td><a href=1>One</a><td><h1>A title of it</h1><p>A paragraph of text, in full sentences. It goes on.</p></table><div class=footer>&copy; 2020 me</div>"
    assert html_extract.main_text(table, crf) == "A title of it\nA paragraph of text, in full sentences. It goes on."
