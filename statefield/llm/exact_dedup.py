"""Exact dedup by stateful streaming: disk-backed keyed state without expiry.

A file stream runs over the digests of all rows, a part of them in each micro-batch. Its state store (RocksDB, so on disk,
no watermark, so no expiry) keeps for each digest the stable identifier of the row that stays, its content locator (file
and row) and the number of rows. With a store folder the state outlives the run, and later tables meet what earlier ones
left. The state is read back as a table; the bytes of every row whose digest is another row's too are fetched by their
locators and compared, and rows under a digest whose bytes differ are grouped by their bytes instead.

Defined results: null text counts as empty; texts are equal when identical after white space runs became one space;
of equal texts the smallest doc_id stays, null doc_ids last; of repeated rows with one doc_id and one text exactly one
is kept. Empty tables give empty results. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, known_size, materialise, new_path, note, text_or_empty

#: Rows of the list of hits up to which it is broadcast: some 30 MB.
WIDE_ROWS = 250_000
#: The state is on disk; without preallocation, as many partitions have a small state each. All states of an executor share one
#: cache, so that their number doesn't add to its memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _stay(locator: Column) -> Column:
    """Order of preference: smallest doc_id, nulls last, then the row's place; the locator rides along."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("run"), F.col("row_id"), locator.alias("locator"))


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _located(docs: DataFrame, kept: str | None) -> DataFrame:
    """doc_id, text, locator of each row; rows that aren't read from files are written first, into the folder `kept` if there is one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    try:
        return rows.select("doc_id", "text", _locator().alias("locator"))
    except AnalysisException:
        if kept is None:
            return materialise(rows, "dedup-texts").select("doc_id", "text", _locator().alias("locator"))
        path = f"{kept}/texts-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return docs.sparkSession.read.schema(rows.schema).parquet(path).select("doc_id", "text", _locator().alias("locator"))


def _streamed_state(rows: DataFrame, path: str, checkpoint: str, max_files: int) -> DataFrame:
    """Runs the stream over the written digests that are new and returns its state: digest, stay, n."""
    spark = rows.sparkSession
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max_files)
    keyed = reader.parquet(path).groupBy("digest").agg(F.min(_stay(F.col("locator"))).alias("stay"), F.count(F.lit(1)).alias("n"))
    run = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    buffer = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key.digest").alias("digest"), F.col("value")[buffer[0]].alias("stay"), F.col("value")[buffer[1]].alias("n"))


def exact_dedup(docs: DataFrame, digest=sha256, batches: int = 2, store: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest: Column -> Column, of the normalised text. batches: micro-batches that the digests come in. store: a folder that
    keeps digests, state and the texts of tables that aren't read from files; rows then also count against those of earlier
    runs with that folder, whose files must still be there. What those runs returned stands.
    """
    spark = docs.sparkSession
    base = store or new_path(spark, "dedup-store")
    path, checkpoint = f"{base}/digests", f"{base}/state"
    located = _located(docs, store)
    run = f"{_runs(spark, path):09d}" if store else ""
    rows = located.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", digest(normalised("text")).alias("digest"), "locator", F.lit(run).alias("run"))
    rows.write.mode("append").parquet(path)
    every = spark.read.schema(rows.schema).parquet(path)
    if store is None:
        note(every, base)
    mine = every.where(F.col("run") == run)
    if mine.isEmpty():
        return mine.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    with _state_store(spark):
        state = _streamed_state(rows, path, checkpoint, max(1, -(-len(every.inputFiles()) // batches)))
        same_row = (F.col("stay.run") == F.col("run")) & (F.col("stay.row_id") == F.col("row_id"))
        grouped = mine.join(state, "digest").select("row_id", "doc_id", "digest", "locator", F.col("stay.doc_id").alias("keep_id"), F.col("stay.locator").alias("keep"), F.col("n").alias("group_size"), same_row.alias("kept"))
        grouped = materialise(grouped, "dedup-groups")
    out = grouped.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    differ = _clashes(grouped)
    if differ is None:
        return out
    again = _by_bytes(every.join(differ, "digest", "left_semi"))
    again = again.where(F.col("run") == run)
    return out.join(differ.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").unionByName(again.select(*out.columns))


def _runs(spark: SparkSession, path: str) -> int:
    """The number of runs that a store has seen."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return 0
    return int(spark.read.parquet(path).agg(F.max("run")).first()[0] or -1) + 1


def _fetched(rows: DataFrame) -> DataFrame:
    """rows with norm, the normalised text at their locator; only the files that have such rows are read, and only their texts.

    Files go by a number, a hash under a seed that tells the files at hand apart.
    """
    rows, seed = materialise(rows, "dedup-places"), 0
    number = lambda c: F.xxhash64(c, F.lit(seed))
    numbered = lambda: rows.select("locator.file").distinct().select("file", number("file").alias("n")).collect()
    files = numbered()
    while len({r.n for r in files}) < len(files):
        seed += 1
        files = numbered()
    texts = rows.sparkSession.read.schema("text string").parquet(*(unquote(r.file) for r in files))
    texts = texts.select("text", number("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    places = materialise(rows.select(*(c for c in rows.columns if c != "locator"), number("locator.file").alias("file"), F.col("locator.row").alias("row")), "dedup-numbered")
    found = texts.join(known_size(places, WIDE_ROWS), (F.col("at_file") == F.col("file")) & (F.col("at_row") == F.col("row")))
    return found.select(*places.columns, normalised("text").alias("norm"))


def _clashes(grouped: DataFrame) -> DataFrame | None:
    """Digests under which the bytes of the hits and of the row that stays aren't all equal, None if there are none.

    The least and the largest text of each digest are found part by part, so a hot digest is pre-aggregated.
    """
    hits = grouped.where("group_size > 1")
    places = hits.select("digest", "locator").unionByName(hits.where(~F.col("kept")).select("digest", F.col("keep").alias("locator"))).distinct()
    places = materialise(places, "dedup-hits")
    if places.isEmpty():
        return None
    ends = _fetched(places).groupBy("digest").agg(F.min(F.col("norm").cast("binary")).alias("least"), F.max(F.col("norm").cast("binary")).alias("most"))
    differ = materialise(ends.where("least <> most").select("digest"), "dedup-clashes")
    return None if differ.isEmpty() else differ


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Results of rows grouped by digest and bytes."""
    texts = materialise(_fetched(rows), "dedup-clash-texts")
    groups = texts.groupBy("digest", "norm").agg(F.min(_stay(F.lit(None))).alias("stay"), F.count(F.lit(1)).alias("group_size"))
    kept = (F.col("stay.run") == F.col("run")) & (F.col("stay.row_id") == F.col("row_id"))
    return texts.join(groups, ["digest", "norm"]).select("run", "doc_id", F.col("stay.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names."""
    id_, sha, own = fresh("id", docs), fresh("sha", docs), fresh("digest", docs)
    found = materialise(exact_dedup(docs), "dedup-found")
    per_id = found.groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("kept")).alias("dropped"))
    mixed = materialise(per_id.where(((F.col("rows") > 1) | F.col(id_).isNull()) & (F.col("dropped") > 0)).select(id_), "dedup-mixed")
    gone = materialise(per_id.where((F.col("rows") == 1) & (F.col("dropped") == 1) & F.col(id_).isNotNull()).select(id_), "dedup-gone")
    same = lambda df, ids: df["doc_id"].cast("long").eqNullSafe(ids[id_])
    out = docs.join(known_size(gone), docs["doc_id"].cast("long") == gone[id_], "left_anti")
    if mixed.isEmpty():
        return out
    stay = found.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    odd = out.join(mixed, same(out, mixed), "left_semi").withColumn(own, sha256(normalised("text")))
    odd = odd.join(stay, odd["doc_id"].cast("long").eqNullSafe(stay[id_]) & (odd[own] == stay[sha]), "left_semi").dropDuplicates(["doc_id", own])
    return out.join(mixed, same(out, mixed), "left_anti").unionByName(odd.select(*docs.columns))
