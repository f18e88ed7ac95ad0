"""Streaming ingest of landed daily files by idempotent micro-batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.commits import append_batch
from ..sources.sinks import append_new


def ingest(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Appends all landed files' new (date, code) rows to target and stops; a repeated micro-batch appends nothing."""
    landed = spark.readStream.schema(schema).parquet(landing)
    return landed.writeStream.foreachBatch(lambda df, _: append_new(df, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_committed(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str, name: str) -> StreamingQuery:
    """As ingest, into a log of commits: several streams, each with its own name, may write to one target at a time (K3)."""
    landed = spark.readStream.schema(schema).parquet(landing)
    write = lambda df, batch: append_batch(df, target, f"{name}-{batch}")
    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
