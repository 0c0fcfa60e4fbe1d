import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from eventloom.operators import units as U


@pytest.fixture(scope="module")
def tables(spark, table):
    entities = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "C"), (4, "C")], "id long, site string")
    site_units = spark.createDataFrame([("A", "glucose", "mg/dL"), ("B", "glucose", "mmol/L"), ("B", "temperature", "degF")], "site string, quantity string, unit string")
    return entities, table("units"), site_units


STATED = [
    ("lab", "glucose, mg/dL control", 100, "mg/dL", 100.0), ("lab", "5,5 mmol/L Glucose", None, "mmol/L", 5.5), ("lab", "GLUCOSE = 6.1 mM", None, "mmol/L", 6.1), ("lab", "glucose_mmol_L", 4.5, "mmol/L", 4.5),
    ("lab", "creatinine (µmol per litre)", 90, "umol/L", 90.0), ("lab", "Creatinine [micromol/L]", 91, "umol/L", 91.0), ("lab", "haemoglobin 135gm/L", None, "g/L", 135.0), ("lab", "hemoglobin: g per dL", 13, "g/dL", 13.0),
    ("vital", "Temperature 37.4°C", None, "degC", 37.4), ("vital", "temp, deg F", 99, "degF", 99.0), ("vital", "98,4 Fahrenheit temp", None, "degF", 98.4), ("vital", "height in", 70, "in", 70.0), ("vital", "Height in inches", 70, "in", 70.0),
    ("vital", "Height 1.46metres", None, "m", 1.46), ("vital", "weight: 72479 gm", None, "g", 72479.0), ("vital", "207.0 LB Weight", None, "lb", 207.0), ("vital", "weight", 70, None, 70.0), ("lab", "glucose control", 7, None, 7.0),
    ("medication", "bisadol, oral, q8h, mg", 430, "mg", 430.0), ("medication", "riboxime 8.1 mg, PO, BID", None, "mg", 8.1), ("medication", "marcatrin, oral, daily, 3100µg", None, "mcg", 3100.0), ("medication", "celdazide (g), IV, stat", 2, "g", 2.0),
]


def test_parsing(events, tables):
    e = events([(1, "2021-01-01", c, t, v) for c, t, v, _, _ in STATED])
    got = {r["src"]: (r["stated"], r["value"]) for r in U.readings(e, tables[1]).collect()}
    assert got == {k: (u, x) for k, (_, _, _, u, x) in enumerate(STATED)}


def test_no_case(events, tables):
    rows = [("lab", "glucose, mg/dL", None), ("lab", "glucose, mg/dL", float("nan")), ("lab", None, 5), ("lab", "sodium", 5), ("note", "glucose 5 mmol/L", None), ("medication", "kentotrin, oral, daily, mL", 340), ("lab", "haptoglobin", 3)]
    assert U.readings(events([(1, "2021-01-01", *r) for r in rows]), tables[1]).count() == 0


def test_harmonise(events, tables):
    stated = [(i, "2020-01-01", "lab", "glucose, mg/dL", 60 + i % 220) for i in range(10, 250)]
    rows = [
        (1, "2021-01-01", "lab", "glucose", 110), (1, "2021-01-02", "lab", "glucose", 6.5), (2, "2021-01-01", "lab", "glucose", 6.5), (2, "2021-01-02", "lab", "glucose", 120), (3, "2021-01-01", "lab", "glucose", 7.0),
        (4, "2021-01-01", "lab", "glucose", 130), (2, "2021-01-01", "lab", "glucose, mmol/L", 7.5), (2, "2021-01-01", "lab", "glucose, mmol/L", 7.5), (1, "2021-01-03", "lab", "glucose", 100000),
        (9, "2021-01-03", "medication", "bisadol, IV, stat, g", 0.5), (9, "2021-01-03", "medication", "bisadol, IV, stat, mg", 500),
    ]
    e = events(rows + stated)
    h = {r["src"]: r for r in U.harmonise(e, *tables).collect() if r["src"] < len(rows)}
    assert [h[k]["recorded"] for k in range(7)] == ["mg/dL", "mmol/L", "mmol/L", "mg/dL", "mmol/L", "mg/dL", "mmol/L"]
    assert 7 not in h and h[8]["recorded"] is None and h[8]["value"] == 100000
    assert h[1]["common_value"] == pytest.approx(6.5 * 18.016) and h[9]["common_value"] == 500.0
    found = rows_of(U.foreign_units(e, *tables), "src", "unit")
    assert found == [(1, "mmol/L"), (2, "mmol/L"), (4, "mmol/L"), (6, "mmol/L"), (9, "g")]


def test_sources_are_linked_scaled_and_snapped(spark, events, table):
    rows, ents = [], []
    for i in range(200):
        ents.append((i, "F" if i % 2 else "C"))
        level = 36.0 + (i * 7 % 40) / 10
        rows.append((i, "2021-01-01", "vital", "temp, degC", level))
        rows.append((i, "2021-01-02", "vital", "temp", level * 1.8 + 32 if i % 2 else level))
    e, u = events(rows), table("units")
    site = spark.createDataFrame(ents, "id long, site string")
    v = U.readings(e, u).join(site, "id")
    bounds = U._conversions(u).join(U.reach(U._per_entity(v), u), ["quantity", "unit"], "left").groupBy("quantity").agg(F.collect_list(F.struct("unit", "factor", "shift", "low", "high", "common_unit")).alias("_units"))
    edges = U.source_edges(U._known(v, bounds), u)
    got = {(r["site"], r["to"]): r for r in edges.collect()}
    assert got["F", "degC"]["links"] == 100
    assert got["F", "degC"]["scale"] == pytest.approx(1 / 1.8, rel=0.02) and got["F", "degC"]["offset"] == pytest.approx(-17.78, abs=0.7)
    found = rows_of(U.source_units(edges, u), "site", "label", "unit", "step")
    assert found == [("C", "?degC", "degC", 1), ("F", "?degF", "degF", 1)]
    assert rows_of(U.site_usual_units(e, site, u), "site", "unit", "links") == [("C", "degC", 100), ("F", "degF", 100)]


def test_units_spread_through_the_graph(spark, table):
    """A source without stated neighbours takes its unit from a solved one; one without links from
    all stated values."""
    u, q = table("units"), [1.0, 2.0, 3.0]
    edge = lambda label, to, links, k: ("A", "weight", label, to, links, k, 0.0, [x / k for x in q], q, False)
    rows = [edge("?kg", "lb", 9, 2.2046), edge("?kg|lb", "?kg", 8, 0.4536), edge("?lb", "?kg", 2, 0.4536), edge("?lb", None, 2, 0.4536)]
    e = spark.createDataFrame(rows, "site string, quantity string, label string, `to` string, links long, scale double, offset double, y array<double>, x array<double>, _shifted boolean")
    assert rows_of(U.source_units(e, u), "label", "unit", "step") == [("?kg", "kg", 1), ("?kg|lb", "lb", 2), ("?lb", "lb", 0)]


def test_empty(spark, events, tables):
    none = events([])
    assert U.harmonise(none, *tables).count() == 0
    assert U.foreign_units(events([(1, "2021-01-01", "lab", "glucose", 6)]), tables[0].limit(0), tables[1].limit(0), tables[2].limit(0)).count() == 0


def test_extra_columns_that_clash(spark, events, tables):
    e = events([(2, "2021-01-01", "lab", "glucose, mmol/L", 7.5)]).selectExpr("*", "1 as src", "2 as value", "'x' as unit", "3 as _units", "'y' as site")
    assert rows_of(U.foreign_units(e, *tables), "src", "unit") == [(0, "mmol/L")]
