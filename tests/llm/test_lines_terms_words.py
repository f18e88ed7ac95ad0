"""Line dedup, the divergence audit and spelling variants against brute force, with edge cases."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from statefield.llm import divergence, line_dedup, queries, spelling

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_divergence_audit"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(t) for c, t in want.dtypes.items()}
    assert sorted(got.itertuples(index=False)) == sorted(want[got.columns].itertuples(index=False))


def lines_by_hand(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(BLANK).translate(ASCII_LOWER)
    split = [(t or "").split("\n") for t in texts]
    docs = collections.Counter(k for ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= max(1, min_chars)}
    return [("\n".join(x for x in ls if key(x) not in gone), len(ls), [i for i, x in enumerate(ls) if key(x) in gone]) for ls in split]


def some_texts(seed):
    rng = random.Random(seed)
    lines = ["", " ", "Home", "home\t", "\x0bHOME\r", "ÀB", "àb", "Àb ", "All rights reserved.", "a b", "a  b", " home"] + [f"line {i}" for i in range(40)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return [*texts, None, "", "\n", "\n\n\n", texts[0], texts[0], "home", "x\n" * 5000 + "home\n" + "end"]


def plain(rows, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize(("min_docs", "min_chars"), [(3, 1), (10, 1), (3, 5), (1, 1)])
def test_lines_equal_brute_force(spark, tmp_path, min_docs, min_chars):
    texts = some_texts(min_docs)
    ids = [i // 2 if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    want = sorted((str(i), "None" if t is None else cut, str(n), str(gone)) for (i, t), (cut, n, gone) in zip(zip(ids, texts), lines_by_hand(texts, min_docs, min_chars)))
    for source in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = line_dedup.line_dedup(source, min_docs, min_chars).collect()
        assert plain(got, "doc_id", "text", "n_lines", "dropped") == want


def test_lines_pass_other_columns_and_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a\nb", 5, [1], "m", "p"), (None, None, None, None, None, None), (2, "A \nc", 6, [], "m", "q")], "doc_id long, text string, n_lines int, dropped array<int>, _metadata string, place string")
    monkeypatch.setattr(line_dedup, "known_size", lambda df: df)  # the way taken for long lists
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_docs=2).collect()}
    assert got[1].text == "b" and got[2].text == "c" and got[None].text is None
    assert got[1].n_lines == 5 and got[1]["_n_lines"] == 2 and got[1]["_dropped"] == [0] and got[None]["_n_lines"] == 1
    assert (got[2].dropped, got[2]["_metadata"], got[2].place) == ([], "m", "q")
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def audit_by_hand(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[w.translate(ASCII_LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    out = []
    for lang in {x for _, x, _ in rows}:
        docs, count = collections.Counter(), collections.defaultdict(collections.Counter)
        sources = {s for _, x, s in rows if x == lang}
        for (_, x, s), ts in zip(rows, terms):
            if x == lang:
                docs.update(set(ts))
                count[s].update(ts)
                count[None].update(ts)
        kept = [t for t, n in docs.items() if n >= min_docs]
        total = {s: sum(count[s][t] for t in kept) for s in [*sources, None]}
        p = {s: {t: 1 + 10**9 * (count[s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in [*sources, None]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            telling = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", sorted(telling, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Apfel", "apfel", "Über", "über", "日本", "𝔸b", "x1y", " w", "the"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for _ in range(250):
        s = rng.choice("abcdefgh") if rng.random() < 0.6 else "hot"
        some = rng.sample(words, 12) if s != "hot" else words[:20]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), s))
    return [*rows, (None, None, None), (None, "en", "mute"), ("solo solo", "xx", "only"), ("one", "yy", "a"), ("two", "yy", "b"), *rows[:5]]


@pytest.mark.parametrize(("min_docs", "top", "tile"), [(10, 10, 512), (1, 3, 2), (4, 10, 1)])
def test_audit_equals_brute_force(spark, min_docs, top, tile):
    rows = audit_rows(tile)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value int")
    got = divergence.audit(docs, min_docs, top, tile)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, min_docs, top)


def test_audit_of_little(spark, monkeypatch):
    kind = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], kind)).collect() == []
    rows = [("rare", "en", "a"), ("words", "en", "b"), (None, "en", None)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, kind)).collect())) == audit_by_hand(rows, 10, 10)
    monkeypatch.setattr(divergence, "HELD", 3)  # tasks hand on their counts again and again
    rows = audit_rows(7)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, kind), 2, 5).collect())) == audit_by_hand(rows, 2, 5)


def test_shares_of_counts_beyond_a_long(spark):
    row = spark.range(1).select(divergence.share(*(divergence.F.lit(x).cast("long") for x in (7_000_000_000_000, 9_000_000_000_000, 1_000_000_000))).alias("p")).first()
    assert row.p == 1 + 10**9 * (7_000_000_000_000 + 2) // (9_000_000_000_000 + 2_000_000_000)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, letters=7, occurrences=2, ratio=10):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= letters and c >= occurrences}
    out, form = {}, {}
    for w, c in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * c else None
        out[w] = (c, len(close))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), c, k, words[form[w]] if form[w] else -1) for w, (c, k) in out.items())


def plain_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def variant_rows(seed):
    rng = random.Random(seed)
    stems = ["letters", "aaaaaaa", "aaabbbb", "Éclairs", "abababab", "straße×n", "zürichs"]
    def changed(w):
        i, c = rng.randrange(len(w)), rng.choice("aàbe")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
    texts = []
    for d in range(80):
        words = []
        for _ in range(30):
            w = rng.choice(stems)
            for _ in range(rng.choice([0] * 12 + [1, 1, 2, 3])):
                w = changed(w)
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((rng.choice([d, d, None, 3]), rng.choice([" ", "-", "1", "Ā", "日"]).join(words)))
    return [*texts, (1, None), (None, ""), (5, "q" * 3000 + " " + "q" * 3000), (6, "q" * 2999 + " " + "q" * 2999), *texts[:3]]


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0xFFF0000000000007, 0])
def test_variants_equal_brute_force(spark, mask):
    """Also where most keys collide."""
    rows = variant_rows(1 if mask else 2)
    if not mask:
        rows = rows[:15]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = spelling.spelling_variants(docs, mask=mask)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert plain_variants(got) == variants_by_hand(rows)


def test_variant_chains_and_ties(spark):
    counts = {"chainaa": 2, "chainab": 40, "chainac": 40, "chainacd": 800, "chainxcd": 16000}
    doc_id = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in counts))
    rows = [(doc_id, " ".join(w for w, n in counts.items() for _ in range(n)))]
    want = variants_by_hand(rows)
    assert plain_variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert {w: (f, r) for w, f, r, *_ in want}["chainaa"] == ("chainab", "chainab") and {w: r for w, _, r, *_ in want}["chainac"] == "chainxcd"
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_are_those_of_the_shortened_words():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 7, 8, 40)]
    flat = np.frombuffer(b"".join(words), np.uint8)
    number, place, key = spelling.deletion_keys(flat, np.array([len(w) for w in words]))
    for i, at, k in zip(number.tolist(), place.tolist(), key.tolist()):
        rest = words[i] if at < 0 else words[i][:at] + words[i][at + 1 :]
        alone = spelling.deletion_keys(np.frombuffer(rest, np.uint8), np.array([len(rest)]))[2]
        assert k == int(alone[0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_op13_on_driver_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.queries()["op13_spelling_variants"](spark, SF)
    assert plain_variants(got) == variants_by_fast_hand(rows)


def variants_by_fast_hand(rows):
    """variants_by_hand with near words sought among all words with one letter less, as far as they are words or share it."""
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = collections.defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    close = collections.defaultdict(set)
    for g in by.values():
        for a in g:
            close[a] |= {b for b in g if b != a and near(a, b)}
    best = {w: min(close[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), c, len(close[w]), words[form[w]] if form[w] else -1) for w, c in words.items())


def test_op11_digest_of_empty(spark, tmp_path):
    spark.createDataFrame([(i, "Same line \nsame LINE") for i in range(10)] + [(10, None), (11, "own")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.queries()["op11_line_dedup"](spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[i].n_dropped == 2 and got[i].kept_sha256 == empty for i in range(10))
    assert (got[10].n_lines, got[10].n_dropped, got[10].kept_sha256) == (1, 0, empty)
    assert got[11].kept_sha256 == hashlib.sha256(b"own").hexdigest()
