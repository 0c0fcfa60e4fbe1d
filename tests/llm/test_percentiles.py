import math

import numpy as np
import pytest
from conftest import rows_of

from eventloom.llm import percentiles as P

CUTS = {"p10": 100, "p50": 500, "p99": 990}


def rank_error(v, q, cut):
    s = np.sort(v)
    # a value read from counters is cut to 20 bits of the mantissa
    near = abs(q) * 2e-6 + 1e-300
    lo, hi = np.searchsorted(s, q - near) / len(s), np.searchsorted(s, q + near, "right") / len(s)
    return max(0.0, lo - cut / 1000, cut / 1000 - hi)


def test_encoding_keeps_order():
    v = np.array([-math.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 1e-300, 2.5, 1e300, math.inf])
    u = P.encode(v)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5]
    assert (P.decode(u) == v).all()


@pytest.mark.parametrize("make", [lambda r: r.normal(0, 1, 150_000), lambda r: r.lognormal(3, 2, 150_000), lambda r: np.where(r.random(150_000) < 0.7, 5.0, r.normal(9, 3, 150_000)), lambda r: r.uniform(-1e6, 1e6, 150_000)])
def test_counters_keep_the_stated_error(make):
    v = make(np.random.default_rng(4))
    cells = P.add_pairs(np.zeros(P.CELLS, np.int64), P.encode(v), np.ones(len(v), np.int64))
    q, stated = P._quantiles_of_cells(cells, [10, 50, 250, 500, 750, 950, 990])
    assert stated < 0.02
    assert max(rank_error(v, x, c) for x, c in zip(q, [10, 50, 250, 500, 750, 950, 990])) <= stated


def test_counters_add_up_and_delete():
    r = np.random.default_rng(5)
    a, b = r.normal(0, 1, 30_000), r.normal(5, 1, 30_000)
    one = lambda v: np.ones(len(v), np.int64)
    both = P.add_pairs(P.add_pairs(np.zeros(P.CELLS, np.int64), P.encode(a), one(a)), P.encode(b), one(b))
    again = P.add_pairs(np.zeros(P.CELLS, np.int64), P.encode(np.r_[a, b]), one(np.r_[a, b]))
    assert (both == again).all()
    P.add_pairs(both, P.encode(b), -one(b))
    assert (both == P.add_pairs(np.zeros(P.CELLS, np.int64), P.encode(a), one(a))).all()


def test_groups_days_and_deletions(spark):
    r = np.random.default_rng(6)
    rows = [(g, d, float(x)) for g, n in (("small", 40), ("large", 20_000), (None, 5)) for d in range(3) for x in r.lognormal(2, 1, n)]
    df = spark.createDataFrame(rows, "g string, d int, x double").repartition(6)
    days = P.merged(P.sketch(df, ["g", "d"], "x"), ["g", "d"])
    whole = {x["g"]: x for x in P.quantiles(P.merged(days, ["g"]), ["g"], CUTS).collect()}
    for g in ("small", "large", None):
        v = np.array([x for k, _, x in rows if k == g])
        assert whole[g]["n"] == len(v)
        for name, cut in CUTS.items():
            if g == "large":
                assert 0 < whole[g]["rank_error"] < 0.02 and rank_error(v, whole[g][name], cut) <= whole[g]["rank_error"]
            else:
                assert whole[g]["rank_error"] == 0 and whole[g][name] == np.sort(v)[max(0, -(-len(v) * cut // 1000) - 1)]
    gone = P.sketch(df.filter("d = 2").selectExpr("g", "x", "-1 as w"), ["g"], "x", "w")
    left = {x["g"]: x for x in P.quantiles(P.merged(days.drop("d").unionByName(gone), ["g"]), ["g"], CUTS).collect()}
    v = np.array([x for k, d, x in rows if k == "small" and d < 2])
    assert left["small"]["n"] == 80 and left["small"]["p50"] == np.sort(v)[39]


def test_odd_input(spark, events):
    e = events([(1, "2021-01-01", "lab", "x", v) for v in (1, 1, None, float("nan"), 2, -0.0)] + [(1, None, "lab", None, 7), (1, "2021-01-01", "lab", "y", 3), (1, "2021-01-01", "lab", "y", 3)])
    got = rows_of(P.event_percentiles(e, {"m": 500}), "class", "text_value", "n", "m", "rank_error")
    assert got == [("lab", "x", 3, 1.0, 0.0), ("lab", "y", 1, 3.0, 0.0), ("lab", None, 1, 7.0, 0.0)]
    assert P.event_percentiles(events([])).count() == 0
    clash = e.selectExpr("*", "1 as n", "2 as pairs", "3 as _v", "4 as day")
    assert rows_of(P.event_percentiles(clash, {"m": 500}), "class", "text_value", "n", "m", "rank_error") == got
    assert P.quantiles(P.merged(P.sketch(e.selectExpr("class", "numeric_value", "cast(0 as int) as w"), ["class"], "numeric_value", "w"), ["class"]), ["class"], CUTS).count() == 0


def test_counters_for_every_group_and_their_check(spark):
    r = np.random.default_rng(8)
    rows = [(g, float(x)) for g, n in (("a", 400), ("b", 3), (None, 1)) for x in np.round(r.normal(50, 9, n), 1)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = P.quantiles(P.merged(P.sketch(df, ["g"], "x", kept=0), ["g"], kept=0), ["g"], CUTS)
    checked = P.rank_check(got, df, ["g"], "x", CUTS).collect()
    assert len(checked) == 9 and all(c["counters"] and c["within"] for c in checked)
    off = got.withColumn("p50", got["p50"] * 1.5)
    assert {(c["g"], c["within"]) for c in P.rank_check(off, df, ["g"], "x", CUTS).collect() if c["percentile"] == "p50"} == {("a", False), ("b", False), (None, False)}
