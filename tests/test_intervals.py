import random

from conftest import rows_of

from eventloom.operators.intervals import periods_and_gaps, stay_periods, stays

SPANS = "id long, start long, end long"


def brute(rows):
    out = []
    by = {}
    for i, a, b in rows:
        if i is not None and a is not None and b is not None and b >= a:
            by.setdefault(i, []).append((a, b))
    for i, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(i, "period", a, b) for a, b in merged]
        out += [(i, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def test_overlap_nest_touch_apart(spark):
    rows = [(1, 0, 10), (1, 2, 5), (1, 10, 12), (1, 20, 20), (1, 30, 40), (1, 30, 40), (2, 5, 4), (2, None, 3), (None, 1, 2), (3, 7, 7)]
    assert rows_of(periods_and_gaps(spark.createDataFrame(rows, SPANS), block=8), "id", "kind", "start", "end") == brute(rows)


def test_random_against_brute_force_with_a_hot_entity_over_many_blocks(spark):
    r = random.Random(3)
    rows = [(1 if r.random() < 0.4 else r.randrange(2, 30), a := r.randrange(-500, 2000), a + r.randrange(0, 40)) for _ in range(900)]
    for block in (7, 100, 10**6):
        assert rows_of(periods_and_gaps(spark.createDataFrame(rows, SPANS), block=block), "id", "kind", "start", "end") == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert periods_and_gaps(spark.createDataFrame([], SPANS)).count() == 0
    df = spark.createDataFrame([(1, 0, 5, "x", 3)], SPANS + ", kind string, _t int")
    assert rows_of(periods_and_gaps(df), "id", "kind", "start", "end") == [(1, "period", 0, 5)]


def test_stays(events):
    e = events([
        (1, "2021-01-01T00:00:00", "admission", "admitted; stay 100001", None), (1, "2021-01-02T00:00:00", "discharge", "stay 100001: home", None),
        (1, "2021-01-02T00:00:00", "discharge", "stay 100001: home", None), (1, "2021-01-02T00:00:00", "admission", "admitted to bay 6 / S-100002", None),
        (1, "2021-01-03T00:00:00", "discharge", "left [100002]", None), (1, None, "admission", "admitted [100003]", None), (1, "2021-02-03T00:00:00", "discharge", "left [100003]", None),
        (2, "2021-01-05T00:00:00", "admission", "admitted [100004]", None), (2, "2021-01-01T00:00:00", "discharge", "left [100004]", None), (2, "2021-01-05T00:00:00", "admission", None, None),
        (3, "1969-12-31T23:59:50", "admission", "x 1000009", None), (3, "1970-01-01T00:00:05", "discharge", "y 1000009", None), (3, "1970-01-01T00:00:05", "lab", "1000009", 3),
    ])
    assert stays(e).count() == 3
    assert rows_of(stay_periods(e), "id", "kind", "start_s", "end_s") == [(1, "period", 1609459200, 1609632000), (3, "period", -10, 5)]
