"""Numbers, years and date ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_number(cell: Column) -> Column:
    """Number in a table cell: ``1.234`` 1.234, ``1,234`` 1234, ``1,23`` 1.23, ``1.234,56`` 1234.56; else null.

    A currency sign and spaces are ignored. A comma with three digits after it parts thousands, one
    with one or two digits is a decimal mark, any other use of it is no number.
    """
    s = F.regexp_replace(cell, r"[€$£\s ]", "")
    plain = (
        F.when(s.rlike(r"^-?\d{1,3}(?:\.\d{3})+,\d+$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(s.rlike(r"^-?\d{1,3}(?:,\d{3})+$"), F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike(r"^-?\d{1,3},\d{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(s.rlike(r"^-?\d+(?:\.\d+)?$"), s)
    )
    return plain.cast("double")


def row_year(cells: Column, default: Column) -> Column:
    """Year of a table row: four digits in a year column, else the first 19xx or 20xx in any cell, else the default."""
    named = F.filter(F.map_entries(cells), lambda e: F.lower(e["key"]).rlike("year|år|ano"))
    explicit = F.regexp_extract(F.get(named, 0)["value"], r"(\d{4})", 1)
    anywhere = F.regexp_extract(F.array_join(F.map_values(cells), " "), r"((?:19|20)\d{2})", 1)
    return F.coalesce(F.when(explicit != "", explicit.cast("int")), F.when(anywhere != "", anywhere.cast("int")), default)


def time_boost(at: Column, start: Column, end: Column, weight: float, softness: float = 1.0) -> Column:
    """Boost of an instant by one date hypothesis: the weight inside the range, decaying by months outside."""
    days = F.least(F.abs(F.datediff(at, start)), F.abs(F.datediff(at, end)))
    decay = F.pow(F.lit(2.71828), -(days / F.lit(30.0)) / F.lit(2 * max(softness, 0.1)))
    return F.when(at.isNull(), 0.0).when((at >= start) & (at <= end), weight).otherwise(weight * decay)


def best_time_boost(at: Column, hypotheses: Column, softness: float = 1.0, most: int = 3) -> Column:
    """Highest boost over the first ``most`` hypotheses, an array of struct(from, to, weight) with ISO days; 0 for none."""
    each = F.transform(F.slice(hypotheses, 1, most), lambda h: time_boost(at, F.to_date(h["from"]), F.to_date(h["to"]), h["weight"], softness))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def generic_headers(row: Column) -> Column:
    """The cells of a table's first row as column names; ``col_1``, ``col_2``, ... if all are empty."""
    return F.when(F.forall(row, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""), F.transform(row, lambda _, i: F.concat(F.lit("col_"), (i + 1).cast("string")))).otherwise(F.transform(row, lambda c: F.coalesce(c, F.lit(""))))


def fitted(row: Column, width: Column) -> Column:
    """A row's cells, filled up with empty ones or cut to ``width``."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def needs_ocr(length: Column, pages: Column, per_page: int = 120) -> Column:
    """Whether a file's text is too sparse to be its own: by page where pages are known, else in all."""
    return F.when(pages > 0, length / pages < per_page).otherwise(length < 2 * per_page)
