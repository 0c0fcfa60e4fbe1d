"""Incremental encoding: the running state of an entity is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import DAY_US
from eventloom.functions.scalars import MAX_AGE
from eventloom.operators.encode import row_tokens
from eventloom.operators.timeline import is_birth
from eventloom.operators.training import TokenizerModel

STATE = "rn long, prev long, state string, ms string, age int, born long"
LINES = "id long, time timestamp_ntz, class string, text_value string, numeric_value double, _src long, _birth boolean, _rn long, _sos boolean, _eos boolean, _dt_us long, _band int, _state string, _ms string, _age int"


def _moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _milestone(kind: str, t: pd.Timestamp, start: int) -> tuple[str, str]:
    """Marker and key of a moment."""
    since = (t.hour - start) % 24
    iso = t.isocalendar()
    marks = {
        "week": (f"<|ms_week_{iso[1]}|>", f"{iso[0]}-{iso[1]}"), "month": (f"<|ms_month_{t.month}|>", f"{t.year}-{t.month}"), "daily": (f"<|ms_day_{iso[2]}|>", f"{t.date()}"),
        "12hr": (f"<|ms_12hr_{since // 12}|>", f"{t.date()} {since // 12}"), "8hr": (f"<|ms_8hr_{since // 8}|>", f"{t.date()} {since // 8}"),
    }
    return marks[kind]


def _advance(config: TokenizerConfig):
    triggers, scales = config.triggers, list(config.time_scales or [])
    kinds = config.milestone_per_state or {}

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rn, prev, now, ms, age, born = state.get if state.exists else (0, None, config.initial_state, None, None, None)
        rows = pd.concat(list(frames)).sort_values(["_us", "_src"], na_position="first", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            r = dict(zip(rows.columns, r))
            us = None if pd.isna(r["_us"]) else int(r["_us"])
            rn += 1
            line = {"_birth": bool(r["_birth"]), "_rn": rn, "_sos": bool(r["_birth"]) or rn == 1, "_eos": False, "_dt_us": None, "_band": None, "_state": now, "_ms": None, "_age": None}
            if line["_birth"]:
                prev, now, ms, age, born = None, config.initial_state, None, None, us if us is not None else born
            else:
                if us is not None and prev is not None and us > prev:
                    line["_dt_us"] = us - prev
                    line["_band"] = next((i for i, s in enumerate(scales) if line["_dt_us"] / 1e6 <= s), len(scales))
                    kind = kinds.get(now, "none")
                    if kind != "none":
                        mark, where = _milestone(kind, _moment(us), config.milestone_shift_start)
                        if where != ms:
                            line["_ms"] = mark
                        ms = where
                if r["class"] in triggers:
                    now, ms = triggers[r["class"]], None
                if us is not None and born is not None:
                    years = (us - born) // (365 * DAY_US)
                    if 0 <= years <= MAX_AGE and years != age:
                        line["_age"] = age = int(years)
                prev = us if us is not None else prev
            out.append({**{c: r[c] for c in ("id", "class", "text_value", "numeric_value", "_src")}, "time": None if us is None else _moment(us), **line})
        state.update((rn, prev, now, ms, age, born))
        names = [c.strip().split()[0] for c in LINES.split(",")]
        yield pd.DataFrame(out, columns=names)

    return run


def timeline_stream(events: DataFrame, config: TokenizerConfig) -> DataFrame:
    """The timeline of a stream of canonical events (``id`` long). Rows are taken in order of (time,
    _src) within a micro-batch; a row older than its entity's last one emits no time difference,
    like rows of one time. Sequences have no end token: an entity may always go on. Kept per entity: six
    values."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', time)")
    e = events.withColumn("_birth", is_birth(config)).withColumn("_us", us).drop("time")
    return e.groupBy("id").applyInPandasWithState(_advance(config), LINES, STATE, "append", GroupStateTimeout.NoTimeout)


def encode_stream(events: DataFrame, model: TokenizerModel) -> DataFrame:
    """A stream of ``id, _rn, tokens``: each new row's tokens, as ``row_tokens`` makes them."""
    return row_tokens(events, model, timeline_stream(events, model.config)).select("id", "_rn", "tokens")
