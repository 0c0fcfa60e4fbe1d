"""The window engine against a row-by-row interpreter of the same rules."""

import datetime as dt
import random

import pytest

from eventloom.config import TokenizerConfig
from eventloom.operators.timeline import birth_dates, clinical, timeline, whole_second_gaps


def interpret(rows, config, births):
    """rows: (id, time, class, text, number, src). Yields src -> (sos, dt_us, state, milestone, age)."""
    out, last = {}, None
    born = dict(births)
    for i, t, c, x, _, src in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or dt.datetime.min, r[5])):
        birth = c == config.birth_date_class and x == config.birth_date_text_value
        sos = birth or i != last
        if sos:
            prev, state, mark, age = None, config.initial_state, None, None
        last = i
        if birth:
            born[i] = t if t is not None else born.get(i)
            out[src] = (True, None, None, None, None)
            continue
        gap = ms = shown = None
        was = state
        if t is not None and prev is not None and t > prev:
            gap = (t - prev) // dt.timedelta(microseconds=1)
            kind = (config.milestone_per_state or {}).get(state, "none")
            if kind != "none":
                since = (t.hour - config.milestone_shift_start) % 24
                iso = t.isocalendar()
                token, key = {
                    "week": (f"week_{iso[1]}", iso[:2]), "month": (f"month_{t.month}", (t.year, t.month)), "daily": (f"day_{iso[2]}", t.date()),
                    "12hr": (f"12hr_{since // 12}", (t.date(), since // 12)), "8hr": (f"8hr_{since // 8}", (t.date(), since // 8)),
                }[kind]
                if key != mark:
                    ms = f"<|ms_{token}|>"
                mark = key
        for s, classes in (config.state_transitions or {}).items():
            if c in classes:
                state, mark = s, None
        if t is not None and born.get(i) is not None:
            years = (t - born[i]) // dt.timedelta(days=365)
            if 0 <= years <= 120 and years != age:
                shown = age = years
        prev = t or prev
        out[src] = (sos, gap, was, ms, shown)
    return out


def random_rows(seed, n=700):
    r = random.Random(seed)
    start = dt.datetime(2020, 12, 20)
    rows = []
    for k in range(n):
        i = r.randrange(1, 25)
        t = None if r.random() < 0.04 else start + dt.timedelta(seconds=r.choice([r.randrange(40 * 86400), r.randrange(86400), 3600]), microseconds=r.choice([0, 0, 500]))
        kind = r.random()
        if kind < 0.05:
            rows.append((i, None if r.random() < 0.2 else dt.datetime(1950 + i, 3, 1) if r.random() < 0.6 else t, "demographic", "birth_date", None, k))
        else:
            rows.append((i, t, r.choice(["lab", "admission", "discharge", "icu", "demographic"]), r.choice(["a", None]), None, k))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["week", "month", "daily", "12hr", "8hr"])
def test_against_interpreter(spark, kind):
    from conftest import EVENTS

    config = TokenizerConfig(state_transitions={"in": ["admission", "icu"], "unit": ["icu"], "out": ["discharge"]}, initial_state="start", milestone_per_state={"in": kind, "start": kind, "unit": "daily"}, milestone_shift_start=7)
    rows = random_rows(len(kind) * 7 + ord(kind[0]))
    df = spark.createDataFrame(rows, EVENTS)
    births = birth_dates(df, config)
    known = {r["id"]: r["birth"] for r in births.collect()}
    got = {r["_src"]: (r["_sos"], r["_dt_us"], None if r["_birth"] else r["_state"], r["_ms"], r["_age"]) for r in timeline(df, config, births).collect()}
    assert got == interpret(rows, config, known)


def test_one_exchange_by_id(spark):
    from conftest import EVENTS

    config = TokenizerConfig(state_transitions={"in": ["admission"]}, milestone_per_state={"in": "8hr"})
    df = spark.createDataFrame(random_rows(1, 50), EVENTS)
    plan = timeline(df, config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_histories_in_blocks_give_the_same(spark, table, monkeypatch):
    """Every id beyond ten rows goes in blocks of an hour."""
    from eventloom.operators import decode, encode, running
    from eventloom.operators.training import train
    from eventloom.sources.events import canonical

    e = canonical(table("demo").filter("id % 3 = 0"))
    e = e.unionByName(e.limit(40).selectExpr("id", "cast(null as timestamp_ntz) as time", "class", "text_value", "numeric_value", "_src + 1000000000000 as _src"))
    c = TokenizerConfig(milestone_per_state={"inpatient": "8hr", "outpatient": "week"}, state_transitions={"inpatient": ["admission"], "outpatient": ["discharge"]}, initial_state="outpatient", text_mode_default="concept")
    rows = lambda df: sorted(map(str, df.collect()))
    births = birth_dates(e, c)
    one, gaps, model = rows(timeline(e, c, births)), rows(whole_second_gaps(e, c)), train(e, c)
    stream = encode.encode(e, model)
    whole, index, back = rows(stream), rows(encode.global_row_index(e)), decode.decode(stream, model)
    near = lambda df: sorted((str(r["id"]), r["_src"], r["class"], str(r["text_value"]), str(r["numeric_value"]), round(r["time"].timestamp(), 3)) for r in df.collect())
    back = near(back)
    monkeypatch.setattr(running, "HOT_ROWS", 10)
    monkeypatch.setattr(running, "BLOCK_SRC", 50)
    hot = running.hot_ids(e)
    assert hot is not None and hot.count() > 5
    assert rows(timeline(e, c, births, hot)) == one
    assert rows(whole_second_gaps(e, c, running.hot_ids(clinical(e, c)))) == gaps
    assert rows(encode.encode(e, model)) == whole and rows(encode.global_row_index(e)) == index
    assert near(decode.decode(stream, model, hot=running.hot_ids(stream))) == back
