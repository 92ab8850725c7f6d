"""Streaming ingest: new files become new rows, once per message."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from letterloom.operators.ingest import insert_or_ignore


def ingest(spark: SparkSession, source: DataFrame, out: str, state: str, key: str, order: list[str], interval: str | None = None, buckets: int = 64):
    """Starts a query that appends each batch's new keys to the parquet table ``out``.

    First writer wins on ``key``: a batch keeps its first row per key that the table does not hold
    yet, so running a source twice changes nothing. The table is partitioned by a hash of the key, and
    a batch reads only the partitions its own keys fall into. Without ``interval`` all there is now is
    read and the query ends. Rows with a null key are left out.
    """
    schema = StructType([*source.schema.fields, StructField("key_bucket", IntegerType())])

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in fresh.select("key_bucket").distinct().collect()]  # at most ``buckets``
        existing = batch.sparkSession.read.schema(schema).parquet(out).where(F.col("key_bucket").isin(touched))
        insert_or_ignore(fresh, existing, key, order).write.mode("append").partitionBy("key_bucket").parquet(out)

    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("key_bucket").parquet(out)
    writer = source.writeStream.foreachBatch(append).option("checkpointLocation", state)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the parquet files at ``path``, a file or a folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return reader.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(path))
    return reader.parquet(path)
