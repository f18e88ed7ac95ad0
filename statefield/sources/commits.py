"""Appends that take effect as a whole or not at all: staged files, and a log of commits that names the batches.

A batch is written to a folder of its own and counts from the moment a numbered commit file names that folder. Commit files are
renamed into place, which fails where the number is taken: then another writer was first, and the batch is compared with what
that one has added and tries the next number. A batch whose name is in the log has been committed before and is left alone, so
repeated micro-batches add nothing; the files of batches that failed are never read. Keys stay unique, the first commit wins.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import new_rows

KEYS = ("date", "code")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path, and the file system and conf it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return p, p.getFileSystem(conf), conf


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The log: number, batch and folder of each commit, in order. It has one short file for each batch."""
    p, fs, _ = _hadoop(spark, f"{path}/_commits")
    if not fs.exists(p) or not [f for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")]:
        return []
    found = spark.read.schema("number long, batch string, folder string").json(f"{path}/_commits/*.json")
    return [r.asDict() for r in found.orderBy("number").collect()]


def read_committed(spark: SparkSession, path: str, schema, log: list[dict] | None = None) -> DataFrame:
    """The rows of all committed batches."""
    log = commits(spark, path) if log is None else log
    folders = [f"{path}/data/{c['folder']}" for c in log]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str, log: list[dict], keys: tuple[str, ...] = KEYS) -> str:
    """Writes the rows whose keys the log's batches don't have, into a new folder; its name."""
    folder = uuid.uuid4().hex
    new_rows(rows, read_committed(rows.sparkSession, path, rows.schema, log), keys).write.parquet(f"{path}/data/{folder}")
    return folder


def publish(spark: SparkSession, path: str, number: int, batch: str, folder: str) -> bool:
    """Puts a commit file in its place; False if the number is taken."""
    final, fs, conf = _hadoop(spark, f"{path}/_commits/{number:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"number": number, "batch": batch, "folder": folder}).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    never = spark.sparkContext._gateway.new_array(options, 1)
    never[0] = options.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, never)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        fs.delete(draft, False)
        return False


def append_batch(rows: DataFrame, path: str, batch: str, keys: tuple[str, ...] = KEYS, attempts: int = 20) -> bool:
    """Adds the rows with new keys as a batch (K3); False if a batch of that name is there already."""
    spark = rows.sparkSession
    for _ in range(attempts):
        log = commits(spark, path)
        if any(c["batch"] == batch for c in log):
            return False
        folder = stage(rows, path, log, keys)
        if publish(spark, path, log[-1]["number"] + 1 if log else 0, batch, folder):
            return True
        p, fs, _ = _hadoop(spark, f"{path}/data/{folder}")
        fs.delete(p, True)
    raise RuntimeError(f"batch {batch}: others were first {attempts} times")


def clean(spark: SparkSession, path: str) -> int:
    """Removes the folders of batches that were never committed; run it while no one writes. Returns their number."""
    p, fs, _ = _hadoop(spark, f"{path}/data")
    named = {c["folder"] for c in commits(spark, path)}
    left = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in named] if fs.exists(p) else []
    for folder in left:
        fs.delete(folder, True)
    return len(left)
