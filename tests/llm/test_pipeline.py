"""Stages of the corpus pipeline, one by one and together."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import runs_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from statefield.llm import substring_dedup


def test_language_is_decided_row_by_row(spark):
    clean = ["the cat sat on the mat and looked at the moon", "der Hund liegt auf dem Bett und schaut den Mond an"]
    rows = [(i, clean[i % 2] + f" {i}", ("en", "de")[i % 2], "web") for i in range(20)]
    rows += [(None, clean[0], "en", "web"), (None, "", "en", "web"), (3, "12 34", "de", "web"), (50, None, None, None), (51, "...", "en", "web"), (51, "...", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:21], key=str)


def similar_groups(rows):
    """The smallest doc_id of each document's group: shingles of five words, Jaccard similarity of 0.8 or more."""
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_the_whole_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    words = {x: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(400)] for x, letters in (("en", "thesando"), ("de", "cheinürz"))}
    prose = lambda x, n: " ".join(rng.choice(words[x]) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    shared = {x: prose(x, 60) for x in words}
    rows = []
    for i in range(90):
        x = ("en", "de")[i % 2]
        kind = rng.integers(6) if i > 8 else 5
        old = rows[rng.integers(len(rows))][1] if rows else ""
        if kind == 0:
            text = old.replace(" ", "  ", 3)
        elif kind == 1 and len(old.split()) > 40:
            w = old.split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = f"{prose(x, 30)} {shared[x]} {prose(x, 20)}"
        else:
            text = prose(x, int(rng.integers(5, 120)))
        rows.append((i, text, x, f"{x}.example", len(text)))
    rows += [(100, None, "en", "en.example", 0), (101, "12 34 !", "de", "de.example", 7), (102, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = r.doc_tokens
    kept, seen = [], set()
    for i, t, *_ in rows[:90]:
        if (n := re.sub(r"[\x20\x09-\x0D]+", " ", t)) not in seen:
            kept.append((i, t))
            seen.add(n)
    groups = similar_groups(kept)
    unlike = [(i, t) for i, t in kept if groups[i] == i]
    assert len(unlike) < len(kept) < 90
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    texts, cuts = dict(unlike), 0
    for i, spans in runs_by_hand(unlike, 25):
        left = substring_dedup.cut(texts[i], spans)
        cuts += bool(spans)
        if not spans or left.strip():
            want[i] = len(lib.encode(left, add_special_tokens=False).ids) + 1
    assert got == want and cuts > 3


def test_stages_take_empty_tables_and_clashing_names(spark):
    rows = [(1, "the cat sat on the mat and looked at the moon", "en", "web", 45), (None, None, None, None, None), (2, "", "en", None, 0)]
    names = ["id", "_id", "sha", "digest", "gone", "_gone", "doc", "marks", "around", "row", "_row", "removed", "keep_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit("x").alias(c) for c in names))
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == docs.columns and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == df.count()


def test_the_pipeline_leaves_other_queries_tables(spark, tmp_path):
    """Results made before a run can be read after it; the run leaves no tables but its own result."""
    import os

    from statefield.llm import queries

    sf = "/root/testdata/sf0.001"
    names = ("op1_language_id", "op4_simhash", "op8_substring_dedup", "op10_exact_dedup", "op11_line_dedup", "op12_divergence_audit", "op13_spelling_variants")
    before = {n: queries.queries()[n](spark, sf) for n in names}
    shared = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(shared))
    small = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    small.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() and all(df.count() for df in before.values())
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - there] == ["packing"]
