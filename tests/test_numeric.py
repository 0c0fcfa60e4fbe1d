import math

import numpy as np
import pyarrow as pa
import pytest

from eventloom.functions.scalars import log_normal_below
from eventloom.config import TokenizerConfig
from eventloom.operators import numeric
from eventloom.operators.numeric import edges_by_group, exact_percentiles, histogram, moments, quantile_edges, ranked


def edges(values, n_bins, clip=(1, 99)):
    u, c = np.unique(np.asarray(values, float), return_counts=True)
    return quantile_edges(u, c, n_bins, clip)


@pytest.mark.parametrize("values, n_bins, want", [
    (range(10, 22), 4, [11.5, 16.5, 19.5]), ([1, 2, 3, 4], 2, [2.5]), ([*range(50, 86, 3), *range(100, 136, 3)], 5, [54.5, 75.5, 113.5, 128.5]),
    ([5] * 700 + [10] * 200 + [20] * 50 + [7.5] * 20 + [15] * 15 + [25] * 10 + [30] * 5, 15, [6.25, 8.75, 12.5, 17.5, 22.5]), ([3600] * 11, 4, []), ([], 4, []), ([1, 2], 1, []),
])
def test_golden_edges(values, n_bins, want):
    assert edges(list(values), n_bins) == want


def test_point_mass_keeps_its_own_bin():
    r = np.random.default_rng(0)
    v = np.r_[np.zeros(1800), r.uniform(1, 2, 200)]
    e = edges(v, 20)
    assert len(e) == 19 and np.bincount(np.digitize(v, e))[0] == 1800 and all(a < b for a, b in zip(e, e[1:]))


def test_percentiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    v = np.round(r.lognormal(1, 1, 501), 2).tolist()
    df = spark.createDataFrame([("a", None, x) for x in v] + [("b", "t", 1.0), ("b", "t", float("nan")), ("b", "t", None)], "class string, text_value string, x double")
    h = ranked(histogram(df, ["class", "text_value"], df["x"]), ["class", "text_value"])
    got = {r["class"]: r for r in exact_percentiles(h, ["class", "text_value"], {"p1": 1.0, "p50": 50.0, "p99": 99.0}).collect()}
    assert [got["a"][k] for k in ("p1", "p50", "p99")] == [float(np.percentile(v, q)) for q in (1, 50, 99)]
    assert got["b"]["p50"] == 1.0 and got["b"]["n"] == 1
    m = {r["class"]: r for r in moments(h, ["class", "text_value"], 1.0, 99.0).collect()}["a"]
    x = np.clip(v, np.percentile(v, 1), np.percentile(v, 99))
    assert m["mean"] == pytest.approx(x.mean()) and m["var"] == pytest.approx(x.var()) and m["mu"] == pytest.approx(np.log(x).mean()) and m["sigma2"] == pytest.approx(np.log(x).var())
    assert m["alpha"] * m["beta"] == pytest.approx(x.mean()) and (m["vmin"], m["vmax"]) == (x.min(), x.max())


def test_log_of_normal_tail():
    z = np.array([-40.0, -20.0, -19.9, -5.0, 0.0, 3.0, 9.0])
    got = log_normal_below(z)
    assert got[4] == pytest.approx(math.log(0.5)) and got[0] == pytest.approx(-804.608442, abs=1e-5) and got[1] == pytest.approx(-203.917155, abs=1e-5)
    assert abs(got[1] - got[2]) < 2.1 and -1e-18 < got[6] < 0


def test_edges_of_many_groups(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(None if k == 0 else f"g{k}", float(x)) for k in range(30) for x in np.round(r.gamma(2, 10, 20 + 40 * k), 1 if k % 2 else 0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    h = ranked(histogram(df, ["k"], df["x"]), ["k"])
    got = {x["k"]: x["edges"] for x in edges_by_group(h, ["k"], TokenizerConfig(n_bins=7)).collect()}
    assert got == {k: edges([x for g, x in rows if g == k], 7) for k in {g for g, _ in rows}}


def all_steps(values, n_bins, clip=(1, 99)):
    """The edges from whole arrays, each step as it is stated."""
    x = np.sort(np.asarray(values, float))
    low, high = np.percentile(x, clip[0]), np.percentile(x, clip[1])
    u, c = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
    gaps = set(np.minimum(np.searchsorted(u, np.quantile(x, np.linspace(clip[0] / 100, clip[1] / 100, n_bins - 1))), len(u) - 2).tolist())
    while len(gaps) < min(n_bins - 1, len(u) - 1):
        bounds = [-1, *sorted(gaps), len(u) - 1]
        mass, a, b = max((int(c[a + 1 : b + 1].sum()), a + 1, b) for a, b in zip(bounds, bounds[1:]) if b - a > 1)
        gaps.add(a + int(np.argmin(np.abs(2 * np.cumsum(c[a:b]) - mass))))
    return [(u[g] + u[g + 1]) / 2 for g in sorted(gaps)]


@pytest.mark.parametrize("in_memory", [10**9, 50_000])
@pytest.mark.parametrize("same", [0, 150_000])
def test_edges_of_a_group_with_very_many_values(in_memory, same, monkeypatch):
    monkeypatch.setattr(numeric, "IN_MEMORY", in_memory, raising=False)
    v = np.r_[np.random.default_rng(10).lognormal(3, 2, 450_000), np.full(same, 20.0)]
    u, c = np.unique(v, return_counts=True)
    cols = {"k": ["a"] * len(u), "v": u, "c": c, "upto": np.cumsum(c), "n": np.full(len(u), len(v)), "n_distinct": np.full(len(u), len(u)), "low": np.zeros(len(u)), "high": np.ones(len(u))}
    batches = pa.table(cols).to_batches(max_chunksize=10_000)
    (out,) = numeric._edge_stream(["k"], 10, (1, 99))(iter(batches))
    assert out.column(1).to_pylist() == [all_steps(v, 10)]


def test_edges_equal_all_steps_with_ties():
    r = np.random.default_rng(11)
    for k in range(300):
        v = np.round(r.gamma(0.7, 4, int(r.integers(2, 400))), int(r.integers(0, 3)))
        n_bins = int(r.integers(2, 25))
        if len(np.unique(v[(v >= np.percentile(v, 1)) & (v <= np.percentile(v, 99))])) > 1:
            assert edges(v, n_bins) == all_steps(v, n_bins), k


def test_hot_groups_in_blocks_give_the_same(spark, monkeypatch):
    from eventloom.operators import distfit

    r = np.random.default_rng(12)
    rows = [(g, float(x)) for g, n in ((None, 400), ("a", 300), ("b", 6)) for x in np.r_[r.normal(3, 40, n), [0.0, -0.5, 5.0, 5.0]]]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)

    def all_of():
        h = ranked(histogram(df, ["k"], df["x"]), ["k"])
        tables = [h.drop("_hot"), edges_by_group(h, ["k"], TokenizerConfig()), numeric.moments(h, ["k"], 1.0, 99.0), numeric.levels_by_group(h, ["k"], 12), distfit.recommend(df, ["k"], "x")]
        show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
        return [sorted(tuple(map(show, t)) for t in d.collect()) for d in tables]

    one = all_of()
    monkeypatch.setattr(numeric, "HOT_VALUES", 50)
    assert "_hot" in ranked(histogram(df, ["k"], df["x"]), ["k"]).columns and all_of() == one
