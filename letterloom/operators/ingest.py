"""Incremental tables: first writer wins, upserts, change detection, backlogs, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null key are left out."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n")


def insert_or_ignore(new: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: first per key and not there yet."""
    return first_of(new, key, order).join(existing.select(key).distinct(), key, "left_anti")


def backlog(items: DataFrame, key: str, done: DataFrame, done_key: str) -> DataFrame:
    """Items without a result; a crash leaves nothing stuck, for the next run finds them again."""
    return items.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def latest_scan(scans: DataFrame, path: str, at: str, tie: str) -> DataFrame:
    """The newest row of every path."""
    return scans.where(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(F.struct(*[c for c in scans.columns if c != path]), F.struct(at, tie)).alias("r")).select(path, "r.*")


def changed(scans: DataFrame, path: str, at: str, tie: str, looked_at: list[str]) -> DataFrame:
    """Rows in whose ``looked_at`` columns the same path's scan before differs; first scans are none."""
    w = Window.partitionBy(path).orderBy(at, tie)
    before = F.lag(F.struct(*looked_at)).over(w)
    return scans.where(F.col(path).isNotNull()).withColumn("__before", before).where(F.col("__before").isNotNull() & ~F.col("__before").eqNullSafe(F.struct(*looked_at))).drop("__before")
