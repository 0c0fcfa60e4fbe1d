import numpy as np
from conftest import rows_of

from eventloom.operators.spikes import _stuck, flag_source, implausible


def series(n, seed=0, level=80.0, sd=2.0):
    return np.round(np.random.default_rng(seed).normal(level, sd, n), 1)


def flags(v, low=20.0, high=250.0):
    v = np.asarray(v, float)
    return [np.flatnonzero(m).tolist() for m in flag_source(v, low, high, len(set(v.tolist())) > 1)]


def test_spikes_of_one_to_three_readings():
    v = series(120)
    v[10], v[40:42], v[70:73] = 110, (120, 118), (50, 49, 52)
    assert flags(v)[2] == [10, 40, 41, 70, 71, 72]


def test_lasting_change_and_drift_are_no_spikes():
    v = np.r_[series(60, 1), series(60, 2, level=120)]
    assert flags(v)[2] == []
    assert flags(series(300, 3) + np.linspace(0, 40, 300))[2] == []


def test_no_false_alarm_in_many_sources():
    assert sum(len(flags(series(200, s))[2]) for s in range(40)) == 0


def test_impossible_and_stuck():
    v = series(60, 4)
    v[5], v[20:28], v[40:47] = 300, 81.5, 80.5
    i, s, k = flags(v)
    assert i == [5] and s == list(range(20, 28)) and k == []
    assert flags([20, 250, 19.9, 250.1])[0] == [2, 3]


def test_constant_source_is_not_stuck():
    assert flags([70.0] * 30) == [[], [], []]
    assert flags([]) == [[], [], []] and flags([500.0]) == [[0], [], []]


def test_table(spark, events):
    limits = spark.createDataFrame([("heart_rate", 20.0, 250.0), ("spo2", 40.0, 100.0)], "quantity string, low double, high double")
    v = series(80, 5).tolist()
    v[30] = 140.0
    rows = [(1, f"2021-01-{1 + k // 24:02d}T{k % 24:02d}:00:00", "vital", "heart_rate: wearable", x) for k, x in enumerate(v)]
    rows += [(1, None, "vital", "spo2", 101), (1, None, "vital", "spo2", 101), (1, "2021-01-01", "vital", "spo2", None), (1, "2021-01-01", "vital", "spo2", float("nan")), (1, "2021-01-01", "lab", "spo2", 300), (1, "2021-01-01", "vital", None, 300), (None, "2021-01-01", "vital", "SpO2 : x", -1), (1, "2021-01-01", "vital", "weight", 900)]
    e = events(rows)
    want = [(30, "spike"), (80, "impossible"), (86, "impossible")]
    assert rows_of(implausible(e, limits), "src", "kind") == want
    assert rows_of(implausible(e.selectExpr("*", "1 as _v", "2 as kind", "3 as _cell", "4 as src"), limits), "src", "kind") == want
    assert implausible(events([]), limits).count() == 0 and implausible(e, limits.limit(0)).count() == 0


def test_a_hot_source_in_cells_gives_what_one_piece_gives(spark, events):
    limits = spark.createDataFrame([("heart_rate", 20.0, 250.0)], "quantity string, low double, high double")
    v = series(3000, 6)
    for k in range(50, 2950, 97):
        v[k : k + 1 + k % 3] += 45
    v[700:760] = 80.5
    v[1500] = 300
    rows = [(7, f"2021-{1 + k // 700:02d}-{1 + k % 700 // 25:02d}T{k % 25 % 24:02d}:{(k % 25 // 24) * 30:02d}:00", "vital", "heart_rate", float(x)) for k, x in enumerate(v)]
    e = events(rows + [(8, "2021-01-01", "vital", "heart_rate", 80)])
    whole = rows_of(implausible(e, limits), "src", "kind")
    assert len(whole) > 90 and rows_of(implausible(e, limits, cell_rows=400), "src", "kind") == whole


def test_cells_use_the_scatter_of_the_source(spark, events):
    """Calm in one half, noisy in the other: cut in cells, the same readings are flagged."""
    limits = spark.createDataFrame([("heart_rate", 20.0, 250.0)], "quantity string, low double, high double")
    v = np.r_[series(1500, 7, sd=0.5), series(1500, 8, sd=5.0)]
    v[200:2800:130] += 30
    v[205:2805:260] += 6
    rows = [(7, f"2021-01-{1 + k // 720:02d}T{k % 720 // 60:02d}:{k % 60:02d}:00", "vital", "heart_rate", float(x)) for k, x in enumerate(v)]
    e = events(rows)
    one = rows_of(implausible(e, limits), "src", "kind")
    assert len(one) > 5 and rows_of(implausible(e, limits, cell_rows=250), "src", "kind") == one


def test_vanishing_innovation_variance_against_runs():
    r = np.random.default_rng(9)
    for _ in range(50):
        v = np.repeat(r.integers(0, 3, 60) / 10 + 70, r.integers(1, 13, 60))
        edge = np.r_[0, np.flatnonzero(np.diff(v) != 0) + 1, len(v)]
        want = np.zeros(len(v), bool)
        for a, b in zip(edge[:-1], edge[1:]):
            want[a:b] = b - a >= 8
        assert (_stuck(v) == want).all()
