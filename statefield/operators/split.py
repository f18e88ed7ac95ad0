"""Windows over histories of any length: rows by number in blocks, ranks and running counts by ranges.

A window over a code keeps all its rows in one task. Here rows are dealt by ranges of their order, numbered within each part,
and the numbers of the parts before are added, which is a table of at most one row a part. With its number a row belongs to
a block of `rows` rows of its code; the last rows of a block, as many as windows reach back, go along to the next as its halo.
Windows by code and block then give every row but the halo what windows by code would. Ranks among all rows of a code come
from the same numbering by value; what is kept of them are the values at which bins begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions.columns import counted, encode
from ..sources.sinks import written
from . import features

#: Rows of a block.
ROWS = 100_000


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _values(c: pa.Array) -> np.ndarray:
    return np.asarray(c.to_pylist(), object) if c.null_count or not pa.types.is_primitive(c.type) else c.to_numpy(zero_copy_only=False)


def _changed(b: pa.RecordBatch, at: list[int], last: tuple | None) -> np.ndarray:
    """Whether each row differs from the one before in columns `at`; last: those values of the row before the batch."""
    out = np.zeros(b.num_rows, bool)
    for i in at:
        v = _values(b.column(i))
        out[1:] |= v[1:] != v[:-1]
    out[0] = last is None or tuple(b.column(i)[0].as_py() for i in at) != last
    return out


def numbered(df: DataFrame, keys: list[str], order: str, counted: str | None = None) -> DataFrame:
    """df with n_rows, the number of rows before each within its keys, n_less, that of rows with a lesser `order`, and n_marked.

    n_marked counts the rows up to and with each where the boolean column `counted` is true; without one it is null. Rows are
    dealt by ranges, so keys of any number of rows are spread; the result is written, as its numbers hang on the dealing.
    """
    kept = df.columns
    at, by = [kept.index(k) for k in keys], [kept.index(c) for c in (*keys, order)]
    mark = kept.index(counted) if counted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_key, last_both = TaskContext.get().partitionId(), None, None
        rows = less = marked = 0
        for b in batches:
            if not b.num_rows:
                continue
            n, place = b.num_rows, np.arange(b.num_rows)
            new_key, new_value = _changed(b, at, last_key), _changed(b, by, last_both)
            began = np.maximum.accumulate(np.where(new_key, place, -1))  # where the row's key began in this batch, or -1
            own = np.where(began < 0, place + rows, place - began)
            stepped = np.maximum.accumulate(np.where(new_value, place, -1))
            below = np.where(stepped < 0, less, own[stepped])
            ones = np.asarray(b.column(mark).to_pylist(), bool).astype(np.int64) if mark is not None else np.zeros(n, np.int64)
            upto = np.cumsum(ones)
            seen = upto + marked
            inside = began >= 0
            seen[inside] = upto[inside] - (upto - ones)[began[inside]]
            rows, less, marked = int(own[-1]) + 1, int(below[-1]), int(seen[-1])
            last_key, last_both = (tuple(b.column(i)[n - 1].as_py() for i in x) for x in (at, by))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), *(pa.array(x.astype(np.int64)) for x in (own, below, seen))], [*kept, "_part", "_own", "_less", "_marked"])

    dealt = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    found = written(dealt.mapInArrow(run, f"{_ddl(df)}, _part int, _own long, _less long, _marked long"), "numbered")
    # only a part's first key has rows in parts before
    ends = found.groupBy("_part", *keys).agg(F.max("_own").alias("rows"), F.max("_marked").alias("marked"))
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", *keys, several.alias("parts"), F.sum(F.col("rows") + 1).over(before).alias("rows_before"), F.sum("marked").over(before).alias("marked_before"))
    ends = written(ends.where("parts > 1 and rows_before is not null").drop("parts"), "numbered-ends")
    out = found.join(F.broadcast(ends), ["_part", *keys], "left")  # at most one row a part
    plus = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0))
    marked = plus("_marked", "marked_before") if counted else F.lit(None).cast("long")
    return out.select(*kept, plus("_own", "rows_before").alias("n_rows"), plus("_less", "rows_before").alias("n_less"), marked.alias("n_marked"))


def in_blocks(rows: DataFrame, how, reach: int, size: int = ROWS) -> DataFrame:
    """how(rows) by blocks: rows has code and n_rows; how works on windows by code and reaches back at most `reach` rows."""
    if reach >= size:
        raise ValueError("blocks must be longer than windows reach back")
    block = F.floor(F.col("n_rows") / size)
    to = F.when(F.pmod("n_rows", F.lit(size)) >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = rows.withColumn("_block", F.explode(to)).withColumn("code", F.struct("code", "_block"))
    found = how(dealt).where(F.floor(F.col("n_rows") / size) == F.col("_block"))
    return found.withColumn("code", F.col("code.code")).drop("_block")


def z_scores(panel: DataFrame, p: Params = DEFAULT, size: int = ROWS) -> DataFrame:
    """features.raw_features and z_scores of codes with any number of rows."""
    rows = numbered(panel, ["code"], "date").drop("n_less", "n_marked")
    reach = p.w_z + max(p.w_sigma, p.w_liq) + 1
    return in_blocks(rows, lambda df: features.z_scores(features.raw_features(df, p), features.Z, p.w_z), reach, size).drop("n_rows")


#: Keys whose tables of one row each are broadcast; beyond that a key's rows are dealt over SALTS parts.
KEYS, SALTS = 100_000, 64


def beside(df: DataFrame, small: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with what small has for its keys, one row a key; an exchange by key alone would put all rows of a key in one task."""
    small = written(small, name)
    if small.count() <= KEYS:
        return df.join(F.broadcast(small), keys, "left")
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return dealt.join(small.select("*", salts).hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def bin_starts(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """code, starts map<column, array of k - 1 values>: the least value of each bin from 1 on, null where no row is in it or above."""
    long = df.select("code", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), counted(c).alias("value")) for c in cols))).alias("x"))
    ranked = numbered(long.select("code", "x.name", "x.value").where("value is not null"), ["code", "name"], "value")
    count = ranked.groupBy("code", "name").agg(F.max("n_rows").alias("last"))  # one less than the number of rows
    # bin j begins with the first value of which k times the lesser ones exceed j times the others
    first = [F.min(F.when(F.col("n_less") * k > F.col("last") * j, F.col("value"))).alias(f"s{j}") for j in range(1, k)]
    starts = beside(ranked, count, ["code", "name"], "split-counts").groupBy("code", "name").agg(*first)
    return starts.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("name", F.array(*(f"s{j}" for j in range(1, k)))))).alias("starts"))


def discretize(df: DataFrame, cols: list[str] = features.Z, p: Params = DEFAULT) -> DataFrame:
    """features.discretize of codes with any number of rows."""
    starts = bin_starts(df, [f"z_{c}" for c in cols], p.bins)
    joined = beside(df, starts, ["code"], "split-starts")

    def bin_of(c: str) -> Column:
        above = F.filter(F.col("starts")[f"z_{c}"], lambda x: x <= counted(f"z_{c}"))
        return F.when(F.col(f"z_{c}").isNotNull(), F.size(above).cast("long")).alias(f"bin_{c}")

    out = joined.select(*df.columns, *(bin_of(c) for c in cols))
    return out.withColumn("state_id", encode([F.col(f"bin_{c}") for c in cols], p.bins))


def state_vector(panel: DataFrame, p: Params = DEFAULT, size: int = ROWS) -> DataFrame:
    """features.state_vector of codes with any number of rows."""
    return discretize(written(z_scores(panel, p, size), "split-z"), features.Z, p)


def sequences(df: DataFrame, valid: str = "valid") -> DataFrame:
    """latent.sequences of codes with any number of rows."""
    rows = numbered(df.withColumn("_gap", ~F.col(valid)), ["code"], "date", "_gap")
    out = rows.where(F.col(valid)).withColumn("seq_id", F.concat_ws("|", F.col("code").cast("string"), "n_marked"))
    return out.select(*df.columns, "seq_id")
