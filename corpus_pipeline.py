"""Corpus pipeline: language ID, exact dedup, near-dedup, substring dedup and packing of the documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statefield.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from statefield.llm.common import drop_table, drop_tables, fresh, is_noted, materialise, noting
from statefield.llm.queries import BYTE_BPE
from statefield.llm.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `lang` counts as declared, `source` as the host.

    Every row is decided by itself, whatever rows share its doc_id or lack one: null and empty texts go, as do texts without
    letters. Rows are told apart by a digest of the columns that evidence comes from; those equal in all of them and in doc_id
    have one verdict. Without any declared language only rows without letters go. Empty tables give empty ones.
    """
    ship(spark)
    model = language_id.fit_text(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    row, gone_id, gone_digest = (fresh(c, docs) for c in ("row", "gone", "digest"))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    key = F.struct("doc_id", F.unhex(F.sha2(F.concat(*(x for c in known for x in (F.length(c), F.lit(":"), c))), 256)).alias("digest"))
    found = language_id.identify(docs.withColumn(row, key), model, row, declared="lang", address="source")
    gone = found.where("rejected").select(F.col(f"{row}.doc_id").alias(gone_id), F.col(f"{row}.digest").alias(gone_digest)).distinct()
    gone = materialise(gone, "language-gone")
    same = docs["doc_id"].eqNullSafe(gone[gone_id]) & (key["digest"] == gone[gone_digest])
    return docs.join(gone, same, "left_anti")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id, nulls last; null texts are empty. Empty tables give empty ones."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id: shingles of five words, similarity of 0.8 or more.

    Every row is a document of its own, whatever rows share its doc_id; of those with the smallest one stays. Rows without doc_id,
    text or words stay. Empty tables give empty ones.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier documents have; those of which nothing is left go.

    Null and empty texts stay as they are, as do rows without doc_id. Empty tables give empty ones.
    """
    ship(spark)
    found = substring_dedup.substring_dedup(docs)
    left = (F.size(found.columns[-1]) == 0) | (F.trim("text") != "")
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024; null and empty texts are one closing token. Empty tables give no rows."""
    ship(spark)
    return packing.pack(docs, BYTE_BPE, keep=False)


#: Tables of the stage called last, where stages are called one by one.
_last: list[DataFrame] = []


def _noted(stage, first: bool):
    """A stage whose own tables are noted, by run() or else here: the next stage then drops them, and no one else's.

    Called one by one, stages belong to one run at a time, and each result has to be written before the next stage is called.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        if is_noted():
            return stage(spark, docs, sf_dir)
        if not first:
            drop_tables(_last)
        _last = []
        with noting(_last):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]
STAGES = [(name, _noted(stage, i == 0)) for i, (name, stage) in enumerate(STAGES)]

#: SQL can't express the trained language model, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again as the next one's documents.

    Once a stage is written, its own tables and the documents it had go; tables of other queries stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        own: list[DataFrame] = []
        with noting(own):
            kept = materialise(stage(spark, docs, sf_dir), name, temporary=False)
        drop_tables(own)
        drop_table(docs)
        docs = kept
    return docs
