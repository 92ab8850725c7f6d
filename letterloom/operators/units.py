"""Measured cells of loosely written tables, brought to common units.

A cell's unit is recorded in the cell itself, in a unit column of its row, in its column's header or
in a note of its table; the nearest record wins in that order. Which quantity a column measures is
learned over all tables: the headers' base names vote with the units written beside them anywhere.

Where the writing leaves a reading open (``1.234`` with either decimal mark, gallons of two
countries, a table without any recorded unit), candidates are scored by the logarithmic residual of
a physical identity and the smallest residual wins; solutions that fit equally well are flagged as
not unique. Two kinds of identity are used: within a column all values are the same quantity, so a
reading must agree with the level of the other tables' values under that base name
(:func:`convert_quantities`), and across columns a product such as mass = density x volume must hold
(:func:`solve_identity`, :func:`mass_and_volume`).
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.session import cut

#: quantity -> (spellings separated by commas, factor to the common unit, offset added first)
UNITS: dict[str, list[tuple[str, float, float]]] = {
    "mass": [
        ("kg,kgs,kilo,kilos,kilogram,kilograms,kilogramm,kilogramme,kilogrammes", 1, 0), ("g,gr,gram,grams,gramm,gramme,grammes", 1e-3, 0), ("mg,milligram,milligrams", 1e-6, 0),
        ("t,to,tonne,tonnes,tonnen,tons,metric ton,metric tons", 1e3, 0), ("lb,lbs,pound,pounds,#", 0.45359237, 0), ("oz,ounce,ounces", 0.028349523125, 0),
        ("lb # oz,lbs # oz,pounds # ounces", 0.45359237, 0), ("st,stone", 6.35029318, 0), ("cwt", 50.80234544, 0), ("short ton,short tons", 907.18474, 0), ("long ton,long tons", 1016.0469088, 0),
    ],
    "length": [
        ("m,mtr,mtrs,meter,meters,metre,metres,metro,metros,mètre,mètres", 1, 0), ("mm,millimetre,millimetres,millimeter,millimeters", 1e-3, 0), ("cm,centimetre,centimetres,centimeter,centimeters", 1e-2, 0),
        ("dm", 0.1, 0), ("km,kilometre,kilometres,kilometer,kilometers", 1e3, 0), ("in,inch,inches,zoll,\"", 0.0254, 0), ("ft,foot,feet,'", 0.3048, 0), ("ft # in,feet # inches,' # \"", 0.3048, 0),
        ("yd,yds,yard,yards", 0.9144, 0), ("mi,mile,miles", 1609.344, 0), ("nmi,nm,nautical miles", 1852, 0),
    ],
    "volume": [
        ("l,ltr,ltrs,liter,liters,litre,litres,litro,litros", 1, 0), ("ml,millilitre,millilitres,milliliter,milliliters", 1e-3, 0), ("cl", 1e-2, 0), ("dl", 0.1, 0), ("hl,hectolitre,hectolitres,hectoliter,hectoliters", 100, 0),
        ("m3,cbm,cu m,cubic metre,cubic metres,cubic meter,cubic meters", 1e3, 0), ("cm3,ccm,cc", 1e-3, 0), ("fl oz,floz,fluid ounce,fluid ounces", 0.0295735295625, 0),
        ("us gal,us gallon,us gallons", 3.785411784, 0), ("gal,gals,gallon,gallons", 3.785411784, 0), ("imp gal,uk gal,imperial gallon,imperial gallons", 4.54609, 0),
        ("ft3,cu ft,cubic feet,cubic foot", 28.316846592, 0), ("pt,pint,pints", 0.473176473, 0), ("qt,quart,quarts", 0.946352946, 0), ("bbl,barrel,barrels", 158.987294928, 0),
    ],
    "energy": [
        ("kwh,kw h,kilowatt hour,kilowatt hours,kilowatt-hour,kilowatt-hours", 1, 0), ("wh,watt hour,watt hours", 1e-3, 0), ("mwh,megawatt hour,megawatt hours", 1e3, 0), ("gwh", 1e6, 0),
        ("j,joule,joules", 1 / 3.6e6, 0), ("kj,kilojoule,kilojoules", 1 / 3600, 0), ("mj,megajoule,megajoules", 1 / 3.6, 0), ("gj,gigajoule,gigajoules", 1e3 / 3.6, 0),
        ("therm,therms,thm", 29.3071070172, 0), ("mmbtu", 293.071070172, 0), ("btu", 293.071070172e-6, 0), ("kcal", 1.163e-3, 0),
    ],
    "area": [
        ("m2,sqm,sq m,sq mtr,qm,square metre,square metres,square meter,square meters", 1, 0), ("cm2,sq cm,sqcm", 1e-4, 0), ("mm2", 1e-6, 0), ("km2,sq km", 1e6, 0), ("ha,hectare,hectares,hektar", 1e4, 0),
        ("ac,acre,acres", 4046.8564224, 0), ("ft2,sqft,sq ft,square foot,square feet", 0.09290304, 0), ("in2,sq in", 6.4516e-4, 0), ("yd2,sq yd", 0.83612736, 0),
    ],
    "temperature": [
        ("c,°c,deg c,degc,degrees c,celsius,º c,ºc,degrees celsius", 1, 0), ("f,°f,deg f,degf,degrees f,fahrenheit,degrees fahrenheit", 5 / 9, -32), ("k,°k,kelvin,deg k", 1, -273.15),
    ],
}
#: Spellings that stand for several units: the alternative factors, scored by residuals.
ALTERNATIVES: dict[str, list[float]] = {"gal": [4.54609], "gals": [4.54609], "gallon": [4.54609], "gallons": [4.54609], "tons": [907.18474, 1016.0469088], "pt": [0.56826125], "pint": [0.56826125], "pints": [0.56826125]}
#: Words for a power of ten before a unit in a header.
SCALES = {"k": 1e3, "tsd": 1e3, "000": 1e3, "'000": 1e3, "thousand": 1e3, "thousands": 1e3, "tausend": 1e3, "mil": 1e3, "milliers": 1e3, "miles": 1e3, "mio": 1e6, "million": 1e6, "millions": 1e6, "mill": 1e6, "mn": 1e6, "millones": 1e6}

_GAP = "[ \\u00a0\\u202f\\u2009]"
_NUMBER = rf"\d{{1,3}}(?:(?:{_GAP}|['’.,])\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
_CELL = rf"^\s*(?:[\p{{L}}~≈<>=±][\p{{L}}~≈<>=±. ]*?)??\s*([-−+]?)({_NUMBER})\s*([^\d\s](?:.*\S)?)?\s*$"
_ASIDE = r"(?i)\s*(?:\((?:est|approx|ca|geschätzt|estim)[^()]*\)|\b(?:net|netto|gross|brutto|est|approx)\b\.?)\s*$"
_NAMES = sorted({n for units in UNITS.values() for names, _, _ in units for n in names.split(",") if "#" not in n[1:]}, key=len, reverse=True)
_UNIT = "(?:" + "|".join(re.escape(n).replace("\\ ", r"\.? ?").replace("2", "[2²]").replace("3", "[3³]") + r"\.?" for n in _NAMES) + ")"
_SCALE = r"(?:(?:x ?|[×*] ?)(10+)|(tsd|mio|mill|mil|mn|thousands?|tausend|millions?|millones|milliers|'?000|k(?= )))[.]? ?(?:of |de |d')?"
_HEADER_UNIT = rf"(?iu)^(.+?)(?: in | en |, ?| / | ?\(| ?\[| )(?:in |en )?(?:{_SCALE})?({_UNIT})[)\]]?$"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup() -> Column:
    """Map from spelling to struct(quantity, factor, offset), written as one expression."""
    entries = [(name, q, f, o) for q, units in UNITS.items() for names, f, o in units for name in names.split(",")]
    return F.expr("map(" + ", ".join(f"{_text(name)}, named_struct('quantity', {_text(q)}, 'factor', {float(f)!r}D, 'offset', {float(o)!r}D)" for name, q, f, o in entries) + ")")


def _scale_map() -> Column:
    return F.expr("map(" + ", ".join(f"{_text(k)}, {v!r}D" for k, v in SCALES.items()) + ")")


def _factor_map(options: Mapping[str, Sequence[tuple[float, float]]]) -> Column:
    """Map from a key to its array of struct(factor, offset)."""
    return F.expr("map(" + ", ".join(f"{_text(k)}, array(" + ", ".join(f"named_struct('factor', {float(f)!r}D, 'offset', {float(o)!r}D)" for f, o in fs) + ")" for k, fs in options.items()) + ")")


def spelling(unit: Column) -> Column:
    """A unit's text in the form the table of units is keyed by."""
    s = F.translate(F.lower(F.trim(unit)), "²³ ″”’′", "23 \"\"''")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\d+(?:[.,]\d+)? ?(?=oz|in|ounces|inches|\")", "# "), r"\.", ""), r"\s+", " "))


def unit_of(unit: Column) -> Column:
    """struct(quantity, factor, offset) of a unit's text, null if it is none."""
    return F.try_element_at(_lookup(), spelling(unit))


def _numbers(text: Column) -> Column:
    """The readings of a written number: one per decimal mark it can have."""
    s = F.regexp_replace(text, rf"(?:{_GAP}|['’])", "")
    dot, comma = F.regexp_replace(s, ",", ""), F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    both = s.contains(".") & s.contains(",")
    last_comma = s.rlike(r",\d+$")
    one_mark = s.rlike(r"^\d{1,3}[.,]\d{3}$")
    many = s.rlike(r"([.,])\d{3}\1")
    whole = F.regexp_replace(s, "[.,]", "")
    return (
        F.when(both, F.array(F.when(last_comma, comma).otherwise(dot)))
        .when(many, F.array(whole))
        .when(one_mark & ~s.startswith("0"), F.array(whole, F.regexp_replace(s, ",", ".")))
        .otherwise(F.array(F.regexp_replace(s, ",", ".")))
    )


TABLE = ["message_id", "attachment_path", "table_index"]


def read_cells(rows: DataFrame) -> DataFrame:
    """One row per cell with a number or a unit: row_id, table key, column_name, base, sign, number, cell/header units, bare unit, note."""
    cells = rows.select("row_id", F.coalesce("message_id", F.lit("")).alias("message_id"), F.coalesce("attachment_path", F.lit("")).alias("attachment_path"), F.coalesce("table_index", F.lit(-1)).alias("table_index"), F.explode("data").alias("column_name", "value")).where(F.trim("value") != "")
    # Headers recur in every row of a table: each is read once and joined back.
    power = F.coalesce(F.regexp_extract("column_name", _HEADER_UNIT, 2).try_cast("double"), F.try_element_at(_scale_map(), F.lower(F.regexp_extract("column_name", _HEADER_UNIT, 3))), F.lit(1.0))
    known = F.col("header_unit").isNotNull()
    headers = cells.select("column_name").distinct().withColumn("__u", F.regexp_extract("column_name", _HEADER_UNIT, 4)).withColumn("header_unit", unit_of(F.col("__u")))
    headers = headers.select(
        "column_name", "header_unit", F.when(known, power).otherwise(1.0).alias("header_power"), spelling(F.col("__u")).alias("header_spelling"),
        F.lower(F.trim(F.when(known, F.regexp_extract("column_name", _HEADER_UNIT, 1)).otherwise(F.col("column_name")))).alias("base"),
    )
    cells = cells.withColumn("tail", F.regexp_replace(F.regexp_extract("value", _CELL, 3), _ASIDE, "")).withColumn("found", F.regexp_extract("value", _CELL, 2))
    cells = cells.withColumn("cell_spelling", spelling(F.col("tail"))).withColumn("bare_spelling", spelling(F.col("value")))
    cells = cells.withColumn("cell_unit", F.try_element_at(_lookup(), F.col("cell_spelling"))).withColumn("bare_unit", F.try_element_at(_lookup(), F.col("bare_spelling")))
    return cells.join(headers, "column_name").select(
        "row_id", *TABLE, "column_name", "value", "base", "cell_unit", "cell_spelling", "header_unit", "header_power", "header_spelling", "bare_unit", "bare_spelling",
        F.when(F.col("bare_unit").isNull() & ((F.col("tail") == "") | F.col("cell_unit").isNotNull()), F.when(F.col("found") != "", F.col("found"))).alias("digits"),  # m2 is a unit, no number
        F.regexp_extract("value", _CELL, 1).isin("-", "−").alias("negative"),
    )


#: "weights given in kg", "NB: lengths = metres", "All areas in hectares unless marked".
_NOTE = r"(?i)(?:\bin|=|:|\ben|\bem)\s+([\p{L}°\"'#][\p{L}\d .²³°\"'-]*?)(?=\s*(?:;|,|\.?\s*$|unless\b|except\b|sauf\b|salvo\b|wenn\b|falls\b|sofern\b|soweit\b|si\b|se\b|\())"


def table_notes(rows: DataFrame) -> DataFrame:
    """Units that notes record for whole tables: table key, quantity, unit. One row per table and quantity."""
    texts = rows.select(*(F.coalesce(c, F.lit(-1 if c == "table_index" else "")).alias(c) for c in TABLE), F.explode(F.map_values("data")).alias("note")).where(F.length("note") > 8)
    named = texts.select(*TABLE, F.explode(F.regexp_extract_all("note", F.lit(_NOTE), 1)).alias("unit"))
    known = named.withColumn("note_unit", unit_of(F.col("unit"))).where("note_unit IS NOT NULL")
    return known.groupBy(*TABLE, F.col("note_unit.quantity").alias("quantity")).agg(F.min(F.struct("note_unit", spelling(F.col("unit")).alias("s"))).alias("n")).select(*TABLE, "quantity", "n.note_unit", F.col("n.s").alias("note_spelling"))


def convert_quantities(rows: DataFrame, quantity_units: DataFrame) -> DataFrame:
    """The measured cells of ``rows`` in common units.

    Columns: row_id, column_name, quantity, value (double, common unit), recorded (where the unit
    stood: cell, row, column, table or null), is_common (recorded as the common unit at scale 1),
    unique (no other reading fits as well) and residual (log10 from the level of the same base name).
    Cells without a number give no row; quantities that ``quantity_units`` lacks are left out; null
    keys are keys of their own; repeated rows give the same result each. Nothing depends on columns
    beyond row_id, message_id, attachment_path, table_index and data.
    """
    cells = cut(read_cells(rows))
    votes = cells.select("base", F.coalesce("cell_unit.quantity", "header_unit.quantity").alias("quantity"), F.col("digits").isNotNull().alias("n")).where("quantity IS NOT NULL AND n")
    learned = votes.groupBy("base", "quantity").count().groupBy("base").agg(F.max_by("quantity", F.struct("count", "quantity")).alias("learned"))
    bare = cells.where("bare_unit IS NOT NULL AND digits IS NULL")
    row_units = bare.groupBy("row_id", *TABLE, F.col("bare_unit.quantity").alias("quantity")).agg(F.min(F.struct("bare_unit", "bare_spelling")).alias("r")).select("row_id", *TABLE, "quantity", F.col("r.bare_unit").alias("row_unit"), F.col("r.bare_spelling").alias("row_spelling"))
    measured = (
        cells.where("digits IS NOT NULL")
        .join(learned, "base", "left")
        .withColumn("quantity", F.coalesce("cell_unit.quantity", "header_unit.quantity", "learned"))
        .where("quantity IS NOT NULL")
        .join(quantity_units.select("quantity").where("quantity IS NOT NULL").distinct(), "quantity", "left_semi")
        .join(row_units, ["row_id", *TABLE, "quantity"], "left")
        .join(table_notes(rows), [*TABLE, "quantity"], "left")
    )
    own, by_row, by_column, by_table = (F.col(c).isNotNull() for c in ("cell_unit", "row_unit", "header_unit", "note_unit"))

    def first(cell: Column, row: Column, column: Column, note: Column) -> Column:
        return F.when(own, cell).when(by_row, row).when(by_column, column).when(by_table, note)

    measured = measured.withColumn("recorded", first(*map(F.lit, ("cell", "row", "column", "table")))).withColumn("unit", first(*map(F.col, ("cell_unit", "row_unit", "header_unit", "note_unit"))))
    measured = measured.withColumn("spelled", first(*map(F.col, ("cell_spelling", "row_spelling", "header_spelling", "note_spelling")))).withColumn("power", F.when(F.col("recorded") == "column", F.col("header_power")).otherwise(1.0))
    return _choose(measured)


def _choose(measured: DataFrame) -> DataFrame:
    """Scores every reading (decimal mark x unit) by its log residual from the level of its base name."""
    every = _factor_map({q: list(dict.fromkeys((float(f), float(o)) for _, f, o in units)) for q, units in UNITS.items()})
    others = _factor_map({name: [(f, 0.0) for f in fs] for name, fs in ALTERNATIVES.items()})
    written = F.array(F.struct((F.col("unit.factor") * F.col("power")).alias("factor"), F.col("unit.offset").alias("offset")))
    none = F.array().cast("array<struct<factor:double,offset:double>>")
    units = F.when(F.col("unit").isNotNull(), F.concat(written, F.coalesce(F.try_element_at(others, F.col("spelled")), none))).otherwise(F.try_element_at(every, F.col("quantity")))
    extra = F.when(F.col("spelled").rlike("^(?:lb|lbs|pounds) #"), F.regexp_extract("value", r"(\d+(?:[.,]\d+)?) ?(?:oz|ounces)", 1)).when(F.col("spelled").rlike("^(?:ft|feet|') ?#"), F.regexp_extract("value", r"(\d+(?:[.,]\d+)?) ?(?:in|inches|[\"”″])", 1))
    sixteenth = F.when(F.col("spelled").rlike("^[lp]"), 16.0).otherwise(12.0)
    added = F.coalesce(F.regexp_replace(extra, ",", ".").try_cast("double") / sixteenth, F.lit(0.0))
    df = measured.withColumn("numbers", _numbers(F.col("digits"))).withColumn("units", units).withColumn("added", added)
    sign = F.when(F.col("negative"), -1.0).otherwise(1.0)
    df = df.withColumn("readings", F.flatten(F.transform("numbers", lambda n: F.transform("units", lambda u: ((n.try_cast("double") + F.col("added")) * sign + u["offset"]) * u["factor"]))))
    # Kelvin scale keeps temperatures positive for logarithms; the rest is measured from zero.
    zero = F.when(F.col("quantity") == "temperature", 273.15).otherwise(0.0)
    level_of = lambda v: F.log10(F.greatest(v + zero, F.lit(1e-9)))
    certain = df.where("size(readings) = 1").groupBy("base").agg(F.percentile_approx(level_of(F.get("readings", 0)), 0.5, 1000).alias("level"))
    df = df.join(certain, "base", "left").withColumn("scored", F.array_sort(F.transform("readings", lambda v: F.struct(F.abs(level_of(v) - F.col("level")).alias("residual"), v.alias("v")))))
    best, second = F.get("scored", 0), F.get("scored", 1)
    is_common = F.col("recorded").isNotNull() & (F.col("unit.factor") * F.col("power") == 1.0) & (F.col("unit.offset") == 0)
    unique = (F.size("readings") == 1) | (second["residual"] - best["residual"] > 0.5)
    return df.select("row_id", "column_name", "quantity", best["v"].alias("value"), "recorded", is_common.alias("is_common"), F.coalesce(unique, F.lit(False)).alias("unique"), best["residual"].alias("residual"))


def foreign_units(rows: DataFrame, quantity_units: DataFrame) -> DataFrame:
    """(row_id, column_name) of numbers whose recorded unit is not the common one at scale 1."""
    return convert_quantities(rows, quantity_units).where("recorded IS NOT NULL AND NOT is_common").select("row_id", "column_name").distinct()


def mass_and_volume(rows: DataFrame, quantity_units: DataFrame) -> DataFrame:
    """Tables with a mass and a volume in their rows, tested for mass = density x volume with water's density.

    One row per table: the units under which its numbers, as converted, keep to the identity best, the
    residual left, and whether no other combination comes as near. Rows with several masses or volumes
    take part with the largest of each.
    """
    values = convert_quantities(rows, quantity_units).where("quantity IN ('mass', 'volume')")
    wide = values.groupBy("row_id").agg(*(F.max(F.when(F.col("quantity") == q, F.col("value"))).alias(q) for q in ("mass", "volume")))
    keyed = rows.select("row_id", *(F.coalesce(c, F.lit(-1 if c == "table_index" else "")).alias(c) for c in TABLE)).join(wide, "row_id").withColumn("density", F.lit(1.0))
    units = {"mass": {"kg": 1.0, "g": 1e-3, "t": 1e3, "lb": 0.45359237}, "density": {"kg/l": 1.0}, "volume": {"l": 1.0, "m3": 1e3, "ml": 1e-3, "gal": 3.785411784}}
    return solve_identity(keyed, TABLE, "mass", ["density", "volume"], units)


def solve_identity(df: DataFrame, keys: Sequence[str], product: str, factors: Sequence[str], candidates: Mapping[str, Mapping[str, float]], tolerance: float = 0.02) -> DataFrame:
    """The unit combination per group under which ``product = factor x factor ...`` holds best.

    ``candidates`` gives each column's possible units with their factors to the common units (for
    example density = mass / volume in kg/l). Every combination is scored per group by the mean
    absolute log10 residual over its rows; sums are combined map-side, so a hot group is no single
    task's work. Returns keys, unit_<column> for each column, residual, rows, and ``unique``: whether
    no other combination comes within ``tolerance`` of it. Rows with a null or non-positive value
    take no part; a group without any other row gives no result.
    """
    columns = [product, *factors]
    combos: list[tuple[tuple[str, ...], float]] = [((), 0.0)]
    for i, c in enumerate(columns):
        combos = [((*names, u), shift + (1 if i == 0 else -1) * math.log10(f)) for names, shift in combos for u, f in candidates[c].items()]
    gap = reduce(lambda a, b: a - b, [F.log10(F.col(f"`{c}`").cast("double")) for c in columns])
    usable = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`{c}`") > 0, F.lit(False)) for c in columns])
    sums = df.where(usable).withColumn("__gap", gap).groupBy(*keys).agg(F.count("*").alias("rows"), *(F.avg(F.abs(F.col("__gap") + shift)).alias(f"__r{i}") for i, (_, shift) in enumerate(combos)))
    scored = F.array_sort(F.array(*(F.struct(F.col(f"__r{i}").alias("residual"), *(F.lit(u).alias(f"unit_{c}") for c, u in zip(columns, names, strict=True))) for i, (names, _) in enumerate(combos))))
    best, second = F.get("scored", 0), F.get("scored", 1)
    return sums.withColumn("scored", scored).select(*keys, *(best[f"unit_{c}"].alias(f"unit_{c}") for c in columns), best["residual"].alias("residual"), "rows", F.coalesce(second["residual"] - best["residual"] > tolerance, F.lit(True)).alias("unique"))
