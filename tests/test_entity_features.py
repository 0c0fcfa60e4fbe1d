import datetime as dt
import math
from collections import defaultdict

from conftest import rows_of

from eventloom.operators import entity_features as E

NAMES = [
    ("lab", "139 MG/DL GLUCOSE", "glucose"), ("lab", "haemoglobin, g/L control", "hemoglobin"), ("lab", "Free T4", "free_t4"), ("lab", "free_t4 control", "free_t4"), ("vital", "heart_rate: bedside", "heart_rate"), ("vital", "temp_degC", "temperature"),
    ("medication", "bisadol (mg), IV, stat", "bisadol"), ("diagnosis", "dx / K51.3", "k513"), ("diagnosis", "dx/K513", "k513"), ("flowsheet", "DEVICE:checked", "device"), ("note", "anything", "note"),
    ("admission", "admitted to bay 6 / S-100649", "admitted_to_bay"), ("discharge", "STAY 100652 TRANSFER_OUT", "transfer_out"), ("demographic", "merged with 12", "merged_with"), ("flowsheet", None, "none"), ("other", "--", "unnamed"), ("lab", "", "unnamed"),
]


def test_names(events, table):
    e = events([(1, None, c, t, None) for c, t, _ in NAMES])
    got = [r[0] for r in e.orderBy("_src").select(E.event_name(table("units"))).collect()]
    assert got == [n for _, _, n in NAMES]


def test_slips(spark):
    often = [("lab", n, 1000) for n in ("sodium", "mcv", "aa")] + [("diagnosis", "k513", 1000)]
    seldom = ["soium", "sodimu", "soddium", "sodiun", "osdium", "sodiu", "potassium", "rdw", "sodimum", "dosium", "mc", "mcvx", "a", "x" * 200]
    rows = often + [("lab", n, 3) for n in seldom] + [("diagnosis", "k531", 3), ("lab", "mcw", 51)]
    names = spark.createDataFrame(rows, "class string, name string, count long")
    got = rows_of(E._slips(names, ["soium"]), "class", "name", "other")
    assert got == [("lab", n, "mcv") for n in ("mc", "mcvx")] + [("lab", n, "sodium") for n in ("osdium", "soddium", "sodimu", "sodimum", "sodiu", "sodiun")]


def places(table):
    return {(r["class"], r["name"]): r["type_name"] for r in table[1].collect()}


def brute(df, types, as_of):
    rows = {(r["id"], r["time"], r["class"], r["text_value"], "nan" if r["numeric_value"] is not None and math.isnan(r["numeric_value"]) else r["numeric_value"], r["name"]) for r in df}
    out = defaultdict(lambda: [0, None, 0.0])
    for i, t, c, _, v, n in rows:
        cell = out[i, types[c, n]]
        cell[0] += 1
        cell[1] = t if cell[1] is None or (t is not None and t > cell[1]) else cell[1]
        cell[2] += 0.0 if v in (None, "nan") else v
    return {k: (n, None if t is None else int((as_of - t).total_seconds()), round(v, 6)) for k, (n, t, v) in out.items()}


def test_against_brute_force(table):
    demo, units = table("demo"), table("units")
    types = places(E.type_table(demo, units))
    as_of = dt.datetime(2025, 1, 1)
    us = int((as_of - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    want = brute(demo.withColumn("name", E.event_name(units)).collect(), types, as_of)
    got = {(r["id"], r["type"]): (r["n"], r["since_s"], round(r["total"], 6)) for r in E.feature_cells(demo, units, us).collect()}
    assert got == want
    few = {(r["id"], r["type"]): (r["n"], r["since_s"], round(r["total"], 6)) for r in E.feature_cells(demo, units, us, max_types=40).collect()}
    assert few == want
    wide = E.entity_features(demo, units, us)
    assert wide.count() == demo.select("id").distinct().count()
    assert wide.selectExpr("sum(n_rows)").first()[0] == demo.select("id", "time", "class", "text_value", "numeric_value").distinct().count()


def test_columns_layout_overflow_and_nulls(spark, events, table):
    rows = [(1, "2021-01-01", "lab", "sodium", 1), (1, "2021-01-01", "lab", "sodium", 1), (1, None, "lab", "zinc", float("nan")), (None, "2021-01-03", "lab", "zinc", 2), (2, "2021-01-02", None, None, None)]
    e = events(rows).selectExpr("*", "5 as n", "6 as total", "7 as _id", "8 as n_rows")
    wide = E.entity_features(e, table("units"), layout="columns")
    got = {r["id"]: r for r in wide.collect()}
    assert got[1]["n__lab:sodium"] == 1 and got[1]["total__lab:sodium"] == 1.0 and got[1]["since_s__lab:sodium"] == 172800
    assert got[1]["n__lab:zinc"] == 1 and got[1]["since_s__lab:zinc"] is None and got[1]["total__lab:zinc"] == 0.0
    assert got[None]["total__lab:zinc"] == 2.0 and got[2]["n__none:none"] == 1 and got[2]["n_rows"] == 1
    few = E.feature_cells(e, table("units"), max_types=1)
    assert len({r["type"] for r in few.collect()}) == 3
    assert rows_of(few.groupBy("id").sum("n"), "id", "sum(n)") == [(1, 2), (2, 1), (None, 1)]
    assert E.entity_features(events([]), table("units")).count() == 0


def test_real_types_one_letter_apart_stay_and_misspellings_go(events, table):
    rows = [(k % 3, None, "lab", "mcv", 280 + k % 9) for k in range(3000)] + [(100 + k, None, "lab", "mch", 10 + k) for k in range(12)] + [(7, None, "lab", "mcg", 4000)]
    rows += [(k % 40, None, "vital", "weight", 70 + k % 9) for k in range(2500)] + [(k, None, "vital", "height", 70 + k % 9) for k in range(20)]
    # as many values as the frequent type has, but of other ids
    rows += [(k % 50, None, "flowsheet", "mood: fair", k % 5) for k in range(2000)] + [(1000 + k, None, "flowsheet", "food: fair", k % 5) for k in range(15)]
    rows += [(k % 40, None, "lab", "sodium", 130 + k % 10) for k in range(2000)] + [(k, None, "lab", "sodimu", 130 + k) for k in range(9)] + [(3, None, "lab", "sdium", 133)]
    types = places(E.type_table(events(rows), table("units")))
    of = lambda c, n: types[c, n]
    assert [of("lab", n) for n in ("mcv", "mch", "mcg", "sodium", "sodimu", "sdium")] == ["lab:mcv", "lab:mch", "lab:mcg", "lab:sodium", "lab:sodium", "lab:sodium"]
    assert [of("vital", n) for n in ("weight", "height")] == ["vital:weight", "vital:height"]
    assert [of("flowsheet", n) for n in ("mood", "food")] == ["flowsheet:mood", "flowsheet:food"]


def test_more_names_than_are_broadcast(events, table, monkeypatch):
    monkeypatch.setattr(E, "MAX_NAMES", 2)
    e = events([(k % 3, None, "lab", f"item {'abcdefg'[k % 7]}", k) for k in range(70)])
    got = rows_of(E.feature_cells(e, table("units"), max_types=3).groupBy("type").sum("n"), "type", "sum(n)")
    assert got == [(f"lab:item_{c}", 10) for c in "abcdefg"]
