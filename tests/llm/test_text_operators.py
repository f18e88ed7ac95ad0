"""Text operators on Spark: results against brute force, and nulls, empty tables, ties, repeated rows, clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from statefield.llm import ann, bpe, common, exact_dedup, html_extract, language_id, packing, simhash, substring_dedup, token_counts, url_filter
from statefield.llm.components import connected_components

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 37}x{i}" for i in range(3000))
DOCS = [
    (1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, "x"), (5, "x"), (6, "other text here"), (7, LONG), (8, LONG + " tail"), (None, "a b c"), (None, None), (9, "\n \t"),
]
EXTRA = "fp string, digest string, node string, keep_id string, rank string, host string, key string, n string, band string, pos string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit("clash").alias(c.split()[0]) for c in EXTRA.split(", "))).cache()


def empty(df):
    return df.where("false")


def by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    return sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t])) for (i, _), t in zip(rows, norm)), key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_dedup(spark, docs, digest):
    got = exact_dedup.exact_dedup(docs, digest, batches=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == by_hand(DOCS)
    texts = len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in DOCS})
    assert sum(r.kept for r in got) == texts
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
@pytest.mark.parametrize("files", [True, False])
def test_later_tables_meet_the_stored_state(spark, tmp_path, digest, files):
    one, two = [(5, "a b"), (6, "c"), (7, "c ")], [(3, "c"), (4, "a  b"), (8, "new"), (9, "new"), (6, "c")]
    found = []
    for i, rows in enumerate((one, two)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if files:
            df.write.parquet(str(tmp_path / f"in{i}"))
            df = spark.read.parquet(str(tmp_path / f"in{i}"))
        found.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest, store=str(tmp_path / "store")).collect()))
    assert found[0] == [(5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)]
    assert found[1] == [(3, 3, 3, True), (4, 4, 2, True), (6, 3, 3, False), (8, 8, 2, True), (9, 8, 2, False)]


def test_exact_dedup_digest_and_kept_rows(spark, docs):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[1] == got[2] == hashlib.sha256(b"a b c").hexdigest() and got[9] == hashlib.sha256(b" ").hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.drop_copies(empty(docs)).count() == 0


def test_simhash_components(spark, docs):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_components(docs, tile=2).collect()}
    fps = {}
    for i, t in DOCS:
        fps.setdefault(np.uint64(simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 3))).astype(np.int64).item(), []).append(i)
    assert {fp for _, fp in got} == set(fps)
    u = {f: int(np.int64(f).astype(np.uint64)) for f in fps}
    for f, ids in fps.items():
        reach, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += [y for y in fps if (u[x] ^ u[y]).bit_count() <= 2]
        want = min((i for y in reach for i in fps[y] if i is not None), default=None)
        assert all(got[i, f] == want for i in ids)
    assert simhash.near_components(empty(docs)).count() == 0


def test_near_duplicates_and_components(spark, docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, tile=2, shingles=100).collect()}
    assert got[8] == got[7] == 7 and got[2] == got[1] == 1 and 6 not in got
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 6, 7, None, 9}
    assert simhash.near_duplicates(empty(docs)).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("tile, shingles", [(1024, 1 << 20), (6, 700)])
def test_near_duplicates_equal_brute_force(spark, tile, shingles):
    rng = np.random.default_rng(8)
    rows = []
    for group in range(12):
        words = [f"g{group}w{rng.integers(10**6)}" for _ in range(rng.choice([8, 40, 90, 160]))]
        for _ in range(30 if group == 3 else rng.integers(1, 6)):
            mine = list(words)
            for _ in range(rng.integers(0, 1 + len(words) // 25)):
                mine[rng.integers(len(mine))] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(mine)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile, shingles=shingles).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == label and len(got) > 40


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    assert len(got) == len(DOCS)
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in DOCS), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == want
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t in DOCS)
    assert bpe.decode(bpe.encode(empty(docs), BPE), BPE).count() == 0


def test_token_counts(spark, docs):
    edited = docs.withColumn("edits", F.when(F.col("doc_id") != 6, token_counts.standard_edits()))
    got = token_counts.count_tokens(edited, BPE).collect()
    enc = token_counts.counter(BPE)
    for r in got:
        t = next((t for i, t in DOCS if i == r.doc_id and r.doc_id is not None), None)
        if t is not None:
            assert r.n_tokens == len(enc.ids([t])[0]) // 4
    assert next(r for r in got if r.doc_id == 6).n_edits == 0 and len(got) == len(DOCS)
    assert token_counts.count_tokens(empty(edited), BPE).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs.repartition(2), BPE).collect()
    enc = bpe.encoder(BPE)
    assert sum(r.length for r in got) == sum(len(enc.ids([t or ""])[0]) // 4 + 1 for _, t in DOCS)
    rooms = {}
    for r in got:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 and sorted(v)[0][0] == 0 for v in rooms.values())
    assert packing.pack(empty(docs), BPE).count() == 0


def test_substring_dedup(spark, docs):
    passage = " ".join(f"Passage number {i} has its own words." for i in range(12))
    rows = [(1, "Start. " + passage), (2, passage + " End here."), (3, "Nothing shared at all."), (4, None), (5, ""), (None, passage), (2, passage + " End here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("pos", F.lit(2))
    got = sorted(((r.doc_id, r.text, [(x.start, x.end) for x in r.removed]) for r in substring_dedup.substring_dedup(df).collect()), key=str)
    want = [(1, rows[0][1], []), (2, "End here.", [(0, len(passage))]), (2, "End here.", [(0, len(passage))]), (3, rows[2][1], []), (4, None, []), (5, "", []), (None, passage, [])]
    assert got == sorted(want, key=str)
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == [*docs.columns, "removed"]
    assert substring_dedup.substring_dedup(empty(docs)).count() == 0


def runs_by_hand(docs, run_words):
    """Spans that go, found by comparing whole texts: docs is [(doc_id, text)] in order of doc_id."""
    first, out = {}, []
    for doc, text in docs:
        places = [m.span() for m in re.finditer(r"\S+", text)]
        words, at, runs, on = text.lower().split(), 0, [], False
        for pos, (_, _, n, unit) in enumerate(substring_dedup.units(text)):
            if n >= substring_dedup.UNIT_WORDS and unit in first:
                if not on:
                    runs.append([at, at, first[unit][:2], None])
                runs[-1][1], runs[-1][3], on = at + n, (first[unit][0], first[unit][1] + n), True
            elif n >= substring_dedup.UNIT_WORDS:
                first[unit], on = (words, at), False
            at += n
        spans = []
        for a, b, (w1, i), (w2, j) in runs:
            a0, b0 = a, b
            while a > 0 and i > 0 and a0 - a < substring_dedup.CONTEXT and words[a - 1] == w1[i - 1]:
                a, i = a - 1, i - 1
            while b < len(words) and j < len(w2) and b - b0 < substring_dedup.CONTEXT and words[b] == w2[j]:
                b, j = b + 1, j + 1
            while spans and spans[-1][1] >= a:
                a, b = min(a, spans[-1][0]), max(b, spans.pop()[1])
            spans.append((a, b))
        out.append((doc, [(places[a][0], places[b - 1][1]) for a, b in spans if b - a >= run_words]))
    return out


@pytest.mark.parametrize("run_words", [25, 0])
def test_substring_dedup_equals_brute_force(spark, run_words):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeioustr"), 6))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "\n" if rng.random() < 0.03 else "") for _ in range(n))
    passages = [prose(n) for n in (60, 51, 90, 30, 12, 6)]
    docs = []
    for i in range(60):
        parts = [prose(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[rng.integers(6)], prose(int(rng.integers(0, 40)))]
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, [(x.start, x.end) for x in r.removed]) for r in substring_dedup.substring_dedup(df, run_words=run_words).collect())
    want = runs_by_hand(docs, run_words)
    assert got == want and sum(len(s) for _, s in want) > 20


def test_substring_dedup_with_clashing_names(spark):
    names = ["removed", "doc", "_doc", "marks", "_marks", "around"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").select("doc_id", "text", *(F.lit("x").alias(c) for c in names))
    out = substring_dedup.substring_dedup(df)
    assert out.columns == [*df.columns, "_removed"] and sorted(map(tuple, out.collect())) == [(1, "a", *"xxxxxx", []), (2, None, *"xxxxxx", [])]


def test_passage_of_51_words_within_sentences(spark):
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:7] + ("." if i % 17 == 0 else "")
    one, two, passage = ([word(i) for i in range(*r)] for r in ((0, 60), (100, 160), (207, 258)))
    rows = [(i, " ".join(x[:n] + passage + x[n:])) for i, x, n in ((1, one, 25), (2, two, 40))]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: " ".join(two)}


RULES = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("example.org", "/en/1", "block"), url_filter.Rule("com", "/fr/", "allow"), url_filter.Rule("com", "/de/", "block")]


def test_url_rules_and_templates(spark):
    urls = ["HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://badexample.org/en/1", "http://x.com/fr/1", "http://com/de/2", "http://x.org", None, "nonsense", "http://a.net?q=/de/", "x://y://z/p"]
    good = [(1000 + i, f"http://mixed.net/good/{i}") for i in range(60)]
    bad = [(2000 + i, f"http://mixed.net/bad/page-{1000 + i}") for i in range(60)]
    df = spark.createDataFrame([*enumerate(urls), *good, *bad, (0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit(1))
    labels = spark.createDataFrame([(i, i >= 2000) for i, _ in good + bad], "page_id long, bad boolean")
    got = [r for r in url_filter.filter_urls(df, RULES, labels).collect()]
    assert len(got) == len(urls) + 121
    r = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got}
    assert r[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and r[1][2:] == ("example.org/en/1", "block")
    assert r[2][2:] == ("org/", "allow") and r[3][2:] == ("com/fr/", "allow") and r[4][2:] == ("com/de/", "block")
    assert r[5] == ("x.org", "", None, "allow") and r[6][:3] == r[7][:3] == ("", "", None) and r[8][:2] == ("a.net", "") and r[9][:2] == ("y:", "//z/p")
    assert {r[i][3] for i, _ in good} == {"allow"} and {r[i][3] for i, _ in bad} == {"block"}
    assert url_filter.filter_urls(df, RULES).count() == len(got)
    assert url_filter.filter_urls(empty(df), RULES, labels).count() == 0


def test_sections_of_a_hot_host_are_judged_by_their_labels(spark):
    urls = [f"http://h.net/sec{chr(97 + i % 26)}{chr(97 + i // 26)}/{w}" for i in range(40) for w in ("x", "y") for _ in range(40)]
    bad = [u.startswith("http://h.net/seccb/") or "secdb/x" in u for u in urls]
    df = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([*enumerate(bad)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, [], labels).collect()}
    assert [got[i] == "block" for i in range(len(urls))] == bad


def judged_by_hand(rows, most_children=32, heavy=0.05, z=2.0, smoothing=20.0, most_bad=0.5):
    """{(host, segments): (template, branch, bad share, rejected)} of [(host, segments, bad or None)], node by node."""

    def differs(x, n, all_x, all_n):
        if not n or n == all_n:
            return False
        p = all_x / all_n
        return abs(x / n - (all_x - x) / (all_n - n)) > z * (p * (1 - p) * (1 / n + 1 / (all_n - n))) ** 0.5

    def add(table, key, v):
        table[key] = tuple(a + b for a, b in zip(table.get(key, (0, 0, 0)), v))

    counts, out, hosts = {}, {}, {}
    for host, segs, bad in rows:
        add(counts, (host, segs), (1, bad is not None, bool(bad)))
        add(hosts, host, (1, bad is not None, bool(bad)))
    overall = sum(v[2] for v in hosts.values()) / max(1, sum(v[1] for v in hosts.values()))
    for host, (_, h_labelled, h_bad) in hosts.items():
        t = {segs: segs for h, segs in counts if h == host}
        for i in range(max(map(len, t))):
            nodes = {}
            for segs, path in t.items():
                if len(path) > i:
                    add(nodes.setdefault(path[:i], {}), path[i], counts[host, segs])
            wild = set()
            for up, children in nodes.items():
                total = sum(v[0] for v in children.values())
                light = {c for c, v in children.items() if len(children) > most_children and v[0] < heavy * total}
                below, like = {}, {}
                for segs, path in t.items():
                    if len(path) > i and path[:i] == up and path[i] in light:
                        for down in range(len(path) - i):
                            add(below, (path[i], path[i + 1 : i + 1 + down]), counts[host, segs])
                            add(like, path[i + 1 : i + 1 + down], counts[host, segs])
                wild |= {(up, c) for c in light} - {(up, c) for (c, rest), v in below.items() if differs(v[2], v[1], like[rest][2], like[rest][1])}
            t = {s: p[:i] + ("*",) + p[i + 1 :] if len(p) > i and (p[:i], p[i]) in wild else p for s, p in t.items()}
        leaves = {}
        for segs, path in t.items():
            add(leaves, path, counts[host, segs])
        b, level = {p: p for p in leaves}, {p: len(p) for p in leaves}
        for i in range(max(level.values()), 0, -1):
            parts, wholes = {}, {}
            for p in leaves:
                if level[p] == i:
                    add(parts, b[p], leaves[p])
                    add(wholes, b[p][: i - 1], leaves[p])
            for p in leaves:
                if level[p] == i:
                    v, w = parts[b[p]], wholes[b[p][: i - 1]]
                    b[p], level[p] = (b[p], 0) if differs(v[2], v[1], w[2], w[1]) else (b[p][: i - 1] + ("*",), i - 1)
        sums = {}
        for p in leaves:
            add(sums, b[p], leaves[p])
        host_share = (h_bad + smoothing * overall) / (h_labelled + smoothing)
        for segs, path in t.items():
            _, n, x = sums[b[path]]
            share = (x + smoothing * host_share) / (n + smoothing)
            out[host, segs] = ("/" + "/".join(path), "/" + "/".join(b[path]), round(share, 9), share > most_bad)
    return out


@pytest.mark.parametrize("small", [0, url_filter.SMALL, 3500])
def test_url_templates_equal_brute_force(spark, small):
    """Level by level, in one task a host, and both."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(4000):
        host, section, deep = f"h{rng.integers(3)}.net", rng.integers(45), rng.integers(0, 5)
        path = [f"s{chr(97 + section % 26)}{chr(97 + section // 26)}", *(str(rng.choice(["x", "y", "spam", "z"])) for _ in range(deep))]
        if rng.random() < 0.3:
            path.append(f"item-{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}")
        bad = None if rng.random() < 0.3 else bool(rng.random() < (0.9 if "spam" in path[1:3] or section in (5, 17) else 0.1))
        rows.append((i, f"http://{host}/{'/'.join(path)}", host, tuple(path), bad))
    want = judged_by_hand([r[2:] for r in rows])
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] is not None], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.filter_urls(df, [], labels, small=small).collect()}
    for i, _, host, segs, _ in rows:
        template, branch, share, rejected = want[host, segs]
        assert (got[i].template, got[i].branch, round(got[i].bad_share, 9), got[i].verdict) == (template, branch, share, "block" if rejected else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"} and len({r.branch for r in got.values()}) > 8


def test_a_spider_trap(spark):
    """Thousands of paths of up to 200 segments: nested ones, and ones of random words, which are wildcards at every level."""
    import time

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    nested = [f"http://trap.net/{'/'.join(['next', 'page'] * (i % 100 + 1))}/{word()}" for i in range(1500)]
    wild = [f"http://wild.net/{'/'.join(word() for _ in range(rng.randint(1, 200)))}" for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(nested + wild)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 3000, 2)], "page_id long, bad boolean")
    began = time.time()
    got = {r.page_id: r for r in url_filter.filter_urls(df, [], labels).collect()}
    assert len(got) == 3000 and time.time() - began < 60
    assert max(r.template.count("*") for r in got.values()) > 100
    few = [i for i in range(3000) if len((nested + wild)[i]) < 120 and i % 7 == 0]
    rows = [("trap.net" if i < 1500 else "wild.net", tuple((nested + wild)[i].split("/")[3:]), i % 3 == 0 if i % 2 == 0 else None) for i in few]
    want = judged_by_hand(rows)
    again = {r.page_id: r for r in url_filter.filter_urls(df.where(F.col("page_id").isin(few)), [], labels).collect()}
    for i, (host, segs, _) in zip(few, rows):
        assert (again[i].template, again[i].branch, round(again[i].bad_share, 9)) == want[host, segs][:3]


def test_url_templates_differ_below_the_fourth_segment(spark):
    urls = [f"http://h.net/en/2024/05/12/{w}/x{'/deep' * 3}" for w in ("spam", "news") for _ in range(40)]
    df = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "spam" in u) for i, u in enumerate(urls)], "page_id long, bad boolean")
    assert all((r.verdict == "block") == ("spam" in urls[r.page_id]) for r in url_filter.filter_urls(df, [], labels).collect())


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[20:30] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 6), (903, [None] * 6), (904, [float("nan")] + [1.0] * 5), (905, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=5, shard=80, block=3, most_groups=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    n = np.sqrt((x * x).sum(1))
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    for q, found in got.items():
        s = (x * x[q]).sum(1) / (n * n[q])
        order = [int(j) for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        assert [found[i][0] for i in range(1, 6)] == order
        assert np.allclose([found[i][1] for i in range(1, 6)], s[order])
    assert ann.nearest(empty(df), empty(df)).count() == 0 and ann.nearest(df, empty(df)).count() == 0
    twice = df.where("vec_id in (10, 20, 50)").union(df.where("vec_id = 50"))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(twice, twice.where("vec_id = 50"), k=5).collect()) == [(50, 1, 10), (50, 1, 10), (50, 2, 20), (50, 2, 20)]


def test_html_extract(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One &amp; two,  three.</p></article><footer>&copy; foot</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert got == [(1, "Title\nOne & two, three.")] * 2 + [(2, ""), (3, "")]
    assert html_extract.extract(empty(df)).count() == 0


def test_language_id(spark):
    en, fr = "the house and the garden with that thing ", "la maison et le jardin avec cette chose "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr", f"http://h{i % 3}.example.com/") for i in range(40)]
    model = language_id.fit_text(spark.createDataFrame(rows, "id long, text string, lang string, url string"))
    assert model.languages == ("en", "fr")
    ask = [(1, en, None, "http://h1.example.com/"), (2, fr, "fr", None), (3, None, "en", "http://x.fr/"), (4, "", None, None), (5, "123 !?", "fr", None), (1, en, None, "http://h1.example.com/")]
    df = spark.createDataFrame(ask, "id long, text string, lang string, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(1)).withColumn("letters", F.lit(1))
    got = sorted((r.id, r.language, r.rejected) for r in language_id.identify(df, model, "id", declared="lang", address="url").collect())
    assert [g for g in got if g[0] < 3] == [(1, "en", False), (1, "en", False), (2, "fr", False)] and all(g[2] for g in got if g[0] >= 3)
    assert language_id.identify(empty(df), model, "id", declared="lang", address="url").count() == 0
    unknown = language_id.fit_text(spark.createDataFrame([], "id long, text string, lang string"))
    assert unknown.languages == ()
    assert sorted((r.id, r.language, r.rejected) for r in language_id.identify(df, unknown, "id").collect()) == [(i, None, i >= 3) for i in (1, 1, 2, 3, 4, 5)]


def test_language_fusion_equals_the_formula(spark):
    words = {"en": "the house and the garden with that thing ", "fr": "la maison et le jardin avec cette chose "}
    labelled = spark.createDataFrame([(i, words[x] * (1 + i % 3), x) for i in range(30) for x in words], "id long, text string, lang string")
    model = language_id.fit_text(labelled)
    rows = [(i, words["en" if i % 4 else "fr"][: 3 + 7 * i], "fr" if i % 5 == 0 else None, f"https://w{i % 3}.site{i % 2}.{'fr' if i % 6 == 1 else 'com'}/p") for i in range(24)]
    rows += [(50, "", "en", "https://w0.site0.com/"), (51, None, None, None), (50, "", "en", "https://w0.site0.com/")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, url string")
    names, log = model.languages, np.log
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own, share, places = [], [], []
    for _, text, lang, url in rows:
        ll, letters = model.evidence(text or "")
        host = (url or "").split("://")[-1].split("/")[0]
        suffix = host.rsplit(".", 1)[-1] if "." in host else ""
        for told, trust in ((lang, language_id.DECLARED), (language_id.SUFFIXES.get(suffix), language_id.SUFFIX)):
            if told in names:
                ll = ll + np.array([log(trust) if x == told else log((1 - trust) / (len(names) - 1)) for x in names])
        own.append(ll)
        share.append(soft(ll) if letters else 0 * ll)
        places.append(("", suffix, ".".join(host.split(".")[-2:]), host))
    want = []
    for i, row in enumerate(rows):
        prior = np.full(len(names), 1 / len(names))
        for level in range(4):
            rest = sum((share[j] for j in range(len(rows)) if j != i and places[j][: level + 1] == places[i][: level + 1]), np.zeros(len(names)))
            prior = (rest + language_id.STRENGTH * prior) / (rest.sum() + language_id.STRENGTH)
        p = soft(own[i] + log(prior))
        want.append((row[0], names[int(p.argmax())], round(float(p.max()), 9)))
    got = [(r.id, r.language, round(r.confidence, 9)) for r in language_id.identify(df, model, "id", declared="lang", address="url").collect()]
    assert sorted(got) == sorted(want)


def test_every_language_has_its_own_sample(spark):
    rows = [(i, f"text {i}", "en" if i % 50 else "fr") for i in range(400)] + [(1, "text 1", "en")] * 20
    got = language_id.training_rows(spark.createDataFrame(rows, "id long, text string, lang string"), 12).collect()
    assert sum(r.lang == "en" for r in got) == 12 and sum(r.lang == "fr" for r in got) == 8 and len({(r.lang, r.text) for r in got}) == 20


def test_groups_span_batches(spark):
    df = spark.createDataFrame([(i // 7, i) for i in range(50)], "k int, v long").coalesce(1)
    got = df.mapInArrow(lambda b: (g.combine_chunks().to_batches()[0].slice(0, 1) for x in [[y for z in b for y in (z.slice(0, 3), z.slice(3))]] for g in common.groups(x, ["k"])), "k int, v long")
    assert [(r.k, r.v) for r in got.collect()] == [(k, 7 * k) for k in range(8)]


def test_near_copies_of_long_texts(spark):
    """Components of many shingles, whose spans are large numbers."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(130):
        w = list(base)
        for _ in range(20):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(f"y{i}" for i in range(6000))))
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in left.collect()) == [0, 500]


def test_near_duplicates_are_rows_not_doc_ids(spark):
    rng = random.Random(9)
    a, c, d = ([f"{x}{rng.randrange(10**6)}" for _ in range(200)] for x in "acd")
    near = lambda w: " ".join([*w[:90], "other", *w[91:]])
    rows = [(1, " ".join(a), "r1"), (2, near(a), "r2"), (2, " ".join(c), "r3"), (3, near(c), "r4"), (4, " ".join(d), "r5"), (4, near(d), "r6"), (None, " ".join(a), "r7"), (5, None, "r8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string")
    left = [r.place for r in simhash.drop_near_duplicates(docs).collect()]
    assert len(left) == len(set(left)) == 5 and {"r1", "r3", "r7", "r8"} < set(left) and len({"r5", "r6"} & set(left)) == 1
    found = simhash.near_duplicates(docs.drop("place")).collect()
    assert sorted((r.doc_id, r.component_id, r.stays) for r in found if r.doc_id != 4) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]
