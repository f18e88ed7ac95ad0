"""The text operators' queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, exact_dedup, html_extract, language_id, line_dedup, packing, simhash, spelling, substring_dedup, token_counts, url_filter
from .shipping import ship

#: A tokenizer file; every node has it, and it isn't part of this repository.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: The rules given for op3.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages from text, markup, address suffix and host; the text model is fitted on labelled documents."""
    model = language_id.fit_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language_id.identify(table(spark, sf_dir, "pages"), model, "page_id", text="html", address="url", markup=True)
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "letters", "rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the text decoded from them."""
    both = bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages: the given rules, then templates by labelled purity."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, marks)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, up to 2 differing bits."""
    found = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector whose id is divisible by 50; relax 1, so exact."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, relax=1.0)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, by segment trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.standard_edits().alias("edits"))
    return token_counts.count_tokens(docs, BYTE_BPE)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that an earlier document has, and the spans that went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.substring_dedup(docs)
    return found.select("doc_id", "text", F.size("removed").alias("n_removed"), F.to_json("removed").alias("removed_spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents by streaming keyed state."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 documents have."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), kept.alias("kept_sha256"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source of a language from each other one, and its ten most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=10, top=10)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' number, their form and the root of its chain."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), letters=7, occurrences=2, ratio=10)


OP10_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10),
m AS (SELECT doc, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.key IS NULL), '') AS kept FROM k LEFT JOIN h ON k.key = h.key GROUP BY doc)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM m JOIN d USING (doc)
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
lv AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (gn.total + 2 * lv.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (t.n + 2) // (lv.total + 2 * lv.v) AS BIGINT) AS q
    FROM g JOIN t USING (lang) JOIN lv USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
b AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(b.value, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN b ON b.lang = g.lang AND b.source = g.source AND b.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Query]:
    found = (
        op1_language_id,
        op2_bpe,
        op3_url_filter,
        op4_simhash,
        op5_ann,
        op6_html_extract,
        op7_token_counts,
        op8_substring_dedup,
        op9_packing,
        op10_exact_dedup,
        op11_line_dedup,
        op12_divergence_audit,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_divergence_audit": OP12_SQL}
