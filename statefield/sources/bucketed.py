"""Panels as bucketed tables: rows of a code lie in one bucket, so joins by code and date and windows by code need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .sinks import scratch
from .tables import joined_panel

#: Lets tables that are bucketed by code meet on code and date as they are.
SUBSET_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_bucketed(df: DataFrame, name: str, buckets: int = 200) -> str:
    """Writes df as a table in the shared folder, bucketed by code and sorted by code and date; the table's own name.

    One file a bucket. Tables that are to meet need like numbers of buckets, such that a bucket of the widest one fits a task. All
    rows of a code come to one task here and later on: where a code may have too many rows for that, joined_panel on plain tables
    lets adaptive splitting take its share, and split.py the windows.
    """
    table, path = f"{name}_{uuid.uuid4().hex}", scratch(df.sparkSession, f"bucketed-{name}")
    df.repartition(buckets, "code").sortWithinPartitions("code", "date").write.bucketBy(buckets, "code").sortBy("code", "date").option("path", path).saveAsTable(table)
    return table


def drop_bucketed(spark: SparkSession, *names: str) -> None:
    """Takes tables out of the catalog; their files stay in the shared folder until it is cleared."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def bucketed_session(spark: SparkSession) -> SparkSession:
    """A session over the same tables that plans joins on what buckets already give; spark itself keeps its settings."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set(SUBSET_KEYS, "false")
    return own


def joined_buckets(spark: SparkSession, raw: str, states: str, regimes: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """joined_panel of three bucketed tables, without an exchange (S4, J1, J2); columns: what to read of a table, by its name."""
    own = bucketed_session(spark)
    read = lambda t: own.table(t).select(*(columns or {}).get(t, ["*"])).hint("merge")
    return joined_panel(read(raw), read(states), read(regimes))
