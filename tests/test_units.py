import random

import pytest
from pyspark.sql import functions as F

from cataloom.functions import units

VECTORS = {
    "10mm": ("10", "mm"), "1 m": ("1000", "mm"), "120 VAC": ("120", "V"), "24 VDC": ("24", "V"), "120/240 V": ("120/240", "V"), "120-277 VAC": ("120-277", "V"), "20-30 VAC/DC": ("20-30", "VAC/DC"),
    "800 CFM": ("800", "CFM"), "800 CFM @ 0.5 in. wc": ("800 CFM @ 0.5 in. wc", None), "1/2-14 NPT": ("0.5-14 NPT", None), "3.5 tons": ("42000", "BTU/h"), "100 millmeters": ("100", "mm"), "PN-1234-A": ("PN-1234-A", None),
    "   ": ("", None), "1/2 inch": ("0.5", "in"), "2 ft": ("24", "in"), "1 1/2 inch": ("1.5", "in"), "20-30 A": ("20-30", "A"), "1-2 m": ("1000-2000", "mm"), "37 to 102 deg F": ("37-102", "°F"), "-40 to 185 deg F": ("-40-185", "°F"),
    "-40-185 deg F": ("-40-185", "°F"), "1,200 CFM": ("1200", "CFM"), "1,234,567 CFM": ("1234567", "CFM"), "1000 PSI": ("1000", "psi"), "2 bar": ("2", "bar"), "102 deg F": ("102", "°F"), "−40 °F": ("-40", "°F"), "20-30 XYZ": ("20-30", "XYZ"),
    "1,5 mm": ("1,5 mm", None), "5.4 sq in": ("5.4", "sq in"), "5.4 SQ IN": ("5.4", "sq in"), "12 sq ft": ("12", "sq ft"), "10 sq m": ("10", "sq m"), "250 sq cm": ("250", "sq cm"), "2.5 square feet": ("2.5", "sq ft"), "10 m": ("10000", "mm"),
    "10/16 mm": ("10-16", "mm"), "20/30 A": ("20-30", "A"), "1/2 m": ("1000-2000", "mm"), "3/4 in": ("0.75", "in"), "120 kVA": ("120", "kVA"), "50-100 kVA": ("50-100", "kVA"), "25 deg C": ("25", "°C"), "25 °C": ("25", "°C"), "20-30 deg C": ("20-30", "°C"),
    "40%": ("40", "%"), "20-30 %": ("20-30", "%"), "90 deg": ("90", "°F"), "1/3 HP": ("0.333", "HP"), "1075 RPM": ("1075", "RPM"), "3/4 in NPT": ("0.75", "in"), "150 lb-in": ("150", "lb-in"), "10 kA": ("10", "kA"), "1500 lux": ("1500", "lux"),
    "25 cSt": ("25", "cSt"), "20 to 25": ("20-25", None), "1-10": ("1-10", None), "10 mm DIN": ("10", "mm"), "5.4 sq in mount": ("5.4", "sq in"), "3/4": ("0.75", None), "1/16 inch": ("0.0625", "in"), "-1/3": ("-0.333", None), "1/0 AWG": ("1/0 AWG", None),
    "2 ton hoist": ("24000", "BTU/h"), "120 to 240 VAC": ("120-240", "V"), "1 1/2-11.5 NPT": ("1 1/2-11.5 NPT", None), "80 psig": ("80", "psi"), "5 VA": ("5", "VA"), "3 in.": ("3", "in."),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(r,) for r in VECTORS], "raw_value string")
    return {r.raw_value: (r.value, r.unit) for r in units.normalized(rows).collect()}


@pytest.mark.parametrize("raw", VECTORS)
def test_vector(found, raw):
    assert found[raw] == VECTORS[raw]


def test_angular_fields_and_null(spark):
    rows = spark.createDataFrame([("90 deg", "rotation_angle"), ("90-180 deg", "rotation"), ("45 deg", "valve_stroke"), (None, "x")], "raw_value string, f string")
    got = {(r.raw_value, r.f): (r.value, r.unit) for r in units.normalized(rows, field="f").collect()}
    assert got == {("90 deg", "rotation_angle"): ("90", "deg"), ("90-180 deg", "rotation"): ("90-180", "deg"), ("45 deg", "valve_stroke"): ("45", "deg"), (None, "x"): ("", None)}


def test_given_values_stay(spark):
    rows = [("37 to 102 °F (2.8 to 38.9 °C)", "37 to 102", "°F", "t"), ("120 VAC 60Hz", "120", "VAC", "v"), ("2 feet", "2", "feet", "l"), ("2 ft", "2 ft", "ft", "l"), ("45 deg", "45", "deg", "rotation"),
            ("", "x", "bar", "p"), (None, None, None, None), ("10 mm", " ", "mm", "l"), ("5 qqq", "5", "qqq", "z")]
    frame = spark.createDataFrame(rows, "raw_value string, nv string, nu string, f string")
    got = {r.raw_value: (r.value, r.unit) for r in units.normalized_or_given(frame, "raw_value", "nv", "nu", "f").collect()}
    assert got == {rows[0][0]: ("37 to 102", "°F"), rows[1][0]: ("120", "V"), "2 feet": ("2", "ft"), "2 ft": ("24", "in"), "45 deg": ("45", "deg"), "": ("x", "bar"), None: ("", None), "10 mm": ("10", "mm"), "5 qqq": ("5", "qqq")}


def test_closest_alias_equals_comparing_all():
    draw = random.Random(6)
    for _ in range(400):
        token = draw.choice([*units.ALIASES, "volts per", "unknown"])
        at = draw.randrange(len(token) + 1)
        token = token[:at] + draw.choice(["", "x", "s", "ee"]) + token[at + draw.randint(0, 2) :]
        top = max((units.similarity(token, alias), -i, name) for i, (alias, name) in enumerate(units.ALIASES.items()))
        assert units.closest(token) == (top[2] if token and top[0] >= 85 else None)


def test_columns_of_the_caller_stay(spark):
    rows = [("2 foott", "c", "x", "y"), ("N/A", "c", "x", "y"), (None, "c", "x", "y"), (" ", "c", "x", "y"), ("3", "c", "x", "y")]
    df = spark.createDataFrame(rows, "raw_value string, canonical string, token string, _t string")
    for made in (units.normalized(df), units.normalized_by_value(df)):
        got = {r.raw_value: (r.canonical, r.token, r._t, r.value, r.unit) for r in made.collect()}
        assert got == {"2 foott": ("c", "x", "y", "24", "in"), "N/A": ("c", "x", "y", "N/A", None), None: ("c", "x", "y", "", None), " ": ("c", "x", "y", "", None), "3": ("c", "x", "y", "3", None)}


def test_the_grammar_is_worked_out_for_distinct_texts_only(spark, capsys):
    """The plan over the rows joins values that are written, and has none of the grammar's patterns."""
    rows = spark.createDataFrame([(i, f"{i % 3} ft") for i in range(9)] + [(9, "N/A"), (10, None)], "row_id int, raw_value string")
    got = units.normalized_by_value(rows)
    got.explain("extended")
    assert "NPSM" not in capsys.readouterr().out
    assert {r.row_id: (r.value, r.unit) for r in got.collect()} == {i: (str(i % 3 * 12), "in") for i in range(9)} | {9: ("N/A", None), 10: ("", None)}


def test_rows_of_one_known_unit_are_dealt_to_all_tasks(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(400).selectExpr("id", "if(id % 10 = 0, 'millmeters', if(id % 10 = 1, '', 'ft')) as token", "map('a', id) as m")
        got = units.resolved(rows, "token", "name").select("id", "name", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.name for r in got} == {i: {0: "millimeter", 1: None}.get(i % 10, "foot") for i in range(400)}
    assert len({r.p for r in got if r.name == "foot"}) == 4
