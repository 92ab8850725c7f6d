"""Sinks: CSV, JSON lines and observed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``df`` as CSV with a header; ``one_file`` only for reports small enough for one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").csv(path)


CELLS = ["message_id", "attachment_path", "page", "table_index", "row_index", "year", "column", "value"]


def write_cells(cells: DataFrame, path: str) -> None:
    """Numeric table cells as CSV with the eight columns of ``CELLS``, in as many files as there are tasks."""
    write_csv(cells.select(*CELLS), path)


def write_totals(totals: DataFrame, path: str) -> None:
    """Yearly totals as CSV (year, metric, total), in order, as one file: a row per year and metric."""
    write_csv(totals.select("year", "metric", "total").orderBy("year", "metric"), path, one_file=True)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls included as absent keys."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def counted(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df`` with its row count observed as it runs, read from the observation after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
