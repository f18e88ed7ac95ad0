"""Shared helpers: tables in the shared folder, projections, grouped iteration over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster has none, so that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="statefield-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Where the tables that a pipeline's stage makes for its own use are noted; None outside of one.
_noted: ContextVar[list[DataFrame] | None] = ContextVar("noted tables", default=None)


@contextlib.contextmanager
def noting(tables: list[DataFrame]) -> Iterator[None]:
    """Notes the temporary tables made in this context, and in no other, so that whoever runs it can drop them."""
    token = _noted.set(tables)
    try:
        yield
    finally:
        _noted.reset(token)


def is_noted() -> bool:
    return _noted.get() is not None


def note(df: DataFrame, path: str) -> DataFrame:
    """df as a temporary table at path."""
    df._statefield_path = path
    if (tables := _noted.get()) is not None:
        tables.append(df)
    return df


def materialise(df: DataFrame, name: str, temporary: bool = True) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if temporary:
        return note(out, path)
    out._statefield_path = path
    return out


def drop_tables(tables: list[DataFrame]) -> None:
    """Drops what was noted. Call it only when all that was made from them has been written."""
    while tables:
        drop_table(tables.pop())


def drop_table(df: DataFrame) -> None:
    """Removes a table that materialise wrote and that no later plan reads; once more does nothing."""
    path = getattr(df, "_statefield_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Rows of a list of ids up to which it is broadcast: some 32 MB as a hashed relation.
BROADCAST_ROWS = 1_000_000


def known_size(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written list of a few numbers a row, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(name: str, df: DataFrame) -> str:
    """A column name like `name` that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def placed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells each row from all others: its file, as 128 bits, and its row there.

    The column is the same in every plan over these files. Rows that aren't read from files are written first.
    """
    path = F.col("_metadata.file_path")
    place = F.struct(F.xxhash64(path).alias("f1"), F.xxhash64(F.lit(1), path).alias("f2"), F.col("_metadata.row_index").alias("row"))
    if "_metadata" in docs.columns:  # it hides the files' own
        hidden = fresh("metadata", docs)
        return placed(docs.withColumnRenamed("_metadata", hidden), name).withColumnRenamed(hidden, "_metadata")
    try:
        return docs.select(*(docs[c] for c in docs.columns), place.alias(name))
    except AnalysisException:
        return materialise(docs, "placed").select("*", place.alias(name))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `most` bytes of a text column, so that memory doesn't follow the texts' lengths."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, z - a)
            a = z


def give_back() -> None:
    """Returns what this Python process has freed to the system; Spark keeps its workers for the tasks after, each with all it ever took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which a worker keeps no freed memory."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches that are sorted by keys; a run may span batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).combine_chunks() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if last is not None and key != last:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held) if len(held) > 1 else held[0]
