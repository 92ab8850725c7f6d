import math

import pytest

from letterloom.operators import units

SCHEMA = "row_id long, message_id string, attachment_path string, page int, table_index int, row_index int, data map<string,string>, year int, quantity string, value string"
QUANTITIES = [("mass", "kg"), ("length", "m"), ("volume", "l"), ("energy", "kWh"), ("area", "m2"), ("temperature", "degC")]


def rows_of(tables):
    out, n = [], 0
    for t, rows in enumerate(tables):
        for i, data in enumerate(rows):
            n += 1
            out.append((n, "m", f"a{t}", 1, 0, i, data, None, "clash", "clash"))
    return out


@pytest.fixture(scope="module")
def quantities(spark):
    return spark.createDataFrame(QUANTITIES, "quantity string, common_unit string")


def test_reading_cells(spark, quantities):
    tables = [
        [{"Masse": "27 lb 7 oz", "Qty": "3"}, {"Masse": "about 1 613,2 kilos", "Qty": "4"}, {"Masse": "n/a"}, {"Masse": None}],
        [{"Masse (x10 Kg)": "5,5"}, {"Masse (x10 Kg)": "3 kg"}],
        [{"Item": "All areas in hectares unless marked", "Area": ""}, {"Item": "x", "Area": "0,5"}, {"Item": "y", "Area": "20 m²"}],
        [{"Area": "10", "Unit": "ft²"}, {"Area": "10", "Unit": "cm2"}, {"Area": "", "Unit": ""}],
        [{"Temp.": "285 Kelvin"}, {"Temp.": "50 °F"}, {"Temp.": "-3,5 °C net"}],
        [{"Masse": "12"}, {"Date": "2023-02-18"}],
        [{"Heat supplied kWh": "3"}, {"Heat supplied (kilowatt hours)": "4"}, {"Energy [in millions of kWh]": "0.002"}],
    ]
    df = spark.createDataFrame(rows_of(tables), SCHEMA)
    got = {(r["row_id"], r["column_name"]): r for r in units.convert_quantities(df, quantities).collect()}
    assert math.isclose(got[1, "Masse"]["value"], (27 + 7 / 16) * 0.45359237)
    assert math.isclose(got[2, "Masse"]["value"], 1613.2) and got[2, "Masse"]["is_common"]
    assert math.isclose(got[5, "Masse (x10 Kg)"]["value"], 55) and not got[5, "Masse (x10 Kg)"]["is_common"]
    assert got[6, "Masse (x10 Kg)"]["recorded"] == "cell" and got[6, "Masse (x10 Kg)"]["is_common"]
    assert math.isclose(got[8, "Area"]["value"], 5000) and got[8, "Area"]["recorded"] == "table"
    assert math.isclose(got[10, "Area"]["value"], 0.9290304) and got[10, "Area"]["recorded"] == "row"
    assert math.isclose(got[13, "Temp."]["value"], 11.85) and math.isclose(got[14, "Temp."]["value"], 10) and math.isclose(got[15, "Temp."]["value"], -3.5)
    assert got[16, "Masse"]["recorded"] is None and not got[16, "Masse"]["unique"]
    assert math.isclose(got[20, "Energy [in millions of kWh]"]["value"], 2000)
    assert not any(k[1] in ("Qty", "Date", "Unit", "Item") for k in got)
    found = {(r["row_id"], r["column_name"]) for r in units.foreign_units(df, quantities).collect()}
    assert found == {(1, "Masse"), (5, "Masse (x10 Kg)"), (8, "Area"), (10, "Area"), (11, "Area"), (13, "Temp."), (14, "Temp."), (20, "Energy [in millions of kWh]")}
    assert units.foreign_units(df.limit(0), quantities).count() == 0


def test_open_decimal_mark_is_chosen_by_residual(spark, quantities):
    tables = [[{"Depth": f"{v} m"} for v in ("1200", "1500", "1350")], [{"Depth": "1.234 m"}]]
    got = {r["row_id"]: r for r in units.convert_quantities(spark.createDataFrame(rows_of(tables), SCHEMA), quantities).collect()}
    assert got[4]["value"] == 1234 and got[4]["unique"]


def test_identity(spark):
    rows = [("a", 2.0 * v * 1000, 2.0, v) for v in (1.0, 3.0, 5.0)] + [("b", 5.0, 0.0, None)]
    df = spark.createDataFrame(rows, "g string, mass double, density double, volume double")
    out = units.solve_identity(df, ["g"], "mass", ["density", "volume"], {"mass": {"kg": 1, "g": 1e-3}, "density": {"kg/l": 1}, "volume": {"l": 1, "ml": 1e-3}}).collect()
    assert [(r["g"], r["unit_mass"], r["unit_volume"], r["unique"], r["rows"]) for r in out] == [("a", "g", "l", True, 3)]
    even = spark.createDataFrame([("a", 2.0 * v, 2.0, v) for v in (1.0, 3.0)], df.schema)
    same = units.solve_identity(even, ["g"], "mass", ["density", "volume"], {"mass": {"kg": 1e3, "g": 1}, "density": {"kg/l": 1}, "volume": {"l": 1e3, "ml": 1}}).collect()
    assert not same[0]["unique"]  # kg with l holds as well as g with ml


def test_mass_and_volume(spark):
    from letterloom.operators import units

    rows = [(i, "m", "a", 0, {"Weight (t)": f"{2 + i}.5", "Volume (m3)": f"{2 + i}.5"}) for i in range(8)] + [(100 + i, "m", "b", 0, {"Weight (kg)": f"{3 + 7 * i}.5"}) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id long, message_id string, attachment_path string, table_index int, data map<string,string>")
    quantities = spark.createDataFrame([("mass", "kg"), ("volume", "l")], "quantity string, common_unit string")
    got = units.mass_and_volume(df, quantities).collect()
    assert [(r["attachment_path"], r["unit_mass"], r["unit_volume"], r["rows"]) for r in got][0][0] == "a" and len(got) == 1
    assert got[0]["residual"] < 1e-9 and not got[0]["unique"]  # kg with l, g with ml and t with m3 fit alike
    assert units.mass_and_volume(df.limit(0), quantities).count() == 0
