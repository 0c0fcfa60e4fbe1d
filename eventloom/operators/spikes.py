"""Spikes, stuck values and impossible values in the readings of many sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.frames import cut, epoch_us, first_of_repeats, pick, usable

#: Standardised innovation from which a reading is held back as a candidate.
GATE = 4.8
#: A spike leaves the level of the readings around it by more than so many measured scatters. The
#: measured scatter runs up to a third above the true one (rounding, drift), so eight true scatters
#: can measure as six; readings without spikes stay under 4.6.
LEVELS = 5.6
#: Readings in a spike at most; more in a row are a change of level.
BURST = 3
#: Equal readings in a row that make a source stuck.
STUCK = 8
#: Variance of the level's steps as a share of the reading variance.
DRIFT = 0.05
#: Readings of the neighbourhood from which a level is taken on either side.
AROUND = 5
#: A source with more readings than this is cut into cells along its time, which are filtered
#: separately, each with at least HALO readings of its neighbours on either side. What a filter
#: knows of readings 512 steps ago is below 1 in 10**40, and the scatter is that of the source.
CELL_ROWS = 200_000
HALO = 512
HOUR_US, SECOND_US = 3_600_000_000, 1_000_000


def _steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the differences of neighbours, to 12 binary digits, ascending, and how often each
    occurs: few numbers, however many readings."""
    m, e = np.frexp(np.abs(np.diff(v)))
    return np.unique(np.ldexp(np.round(m * 4096) / 4096, e), return_counts=True)


def _scatter(size: np.ndarray, count: np.ndarray) -> float:
    """Standard deviation of readings about a level that moves slowly: from the median size of
    the differences of neighbours, which neither spikes nor changes of level disturb."""
    n = int(count.sum())
    if n < 2:
        return 0.0
    upto = np.cumsum(count)
    a, b = (size[np.searchsorted(upto, k, side="right")] for k in ((n - 1) // 2, n // 2))
    kept = max(2, int(0.9 * n))
    used = np.minimum(upto, kept) - np.minimum(upto - count, kept)
    # of rounded readings half of the differences may be 0 or one step: the trimmed mean sees more
    return max(1.4826 * float(a + b) / 2 / np.sqrt(2), float((size * used).sum() / kept) / 1.128 * 1.1)


def _stuck(v: np.ndarray) -> np.ndarray:
    """Readings where the variance of the innovations vanishes: of a filter that takes readings to be
    without noise and so forecasts the last one, over STUCK - 1 steps."""
    out = np.zeros(len(v), bool)
    if len(v) >= STUCK:
        innovation = np.diff(v)
        variance = np.lib.stride_tricks.sliding_window_view(innovation * innovation, STUCK - 1).mean(axis=1)
        for k in range(STUCK):
            out[k : k + len(variance)] |= variance == 0
    return out


def _free(v: np.ndarray, low: float, high: float, varied: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Impossible and stuck readings, and whether a reading is neither."""
    impossible = (v < low) | (v > high)
    stuck = _stuck(v) if varied else np.zeros(len(v), bool)
    return impossible, stuck, ~impossible & ~stuck


def flag_source(v: np.ndarray, low: float, high: float, varied: bool, scatter: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks (impossible, stuck, spike) for the readings of one source in order of time.

    A local-level Kalman filter forecasts each possible reading. A reading whose standardised
    innovation exceeds GATE doesn't update the filter. If the readings come back within BURST
    readings, those held back are candidates for spikes; if not, the level has changed and the
    filter starts again there. Readings are stuck where the variance of the innovations vanishes
    (``_stuck``). Candidates are then checked against the median of the readings around them.
    ``scatter`` is that of the source if ``v`` is only a part of it.
    """
    impossible, stuck, free = _free(v, low, high, varied)
    spike = np.zeros(len(v), bool)
    at = np.flatnonzero(~impossible)
    x = v[at]
    s = scatter if scatter is not None else _scatter(*_steps(v[free] if free.sum() >= 8 else x))
    if len(x) < 4 or not s > 0:
        return impossible, stuck, spike
    r = s * s
    q = DRIFT * r
    m, p = float(np.median(x[: 2 * AROUND + 1])), r
    held: list[int] = []
    runs: list[list[int]] = []
    gate = GATE * GATE
    i, size, values = 0, len(x), x.tolist()
    while i < size:
        p += q
        e = values[i] - m
        if e * e > gate * (p + r):
            held.append(i)
            if len(held) > BURST:
                back = held[0]
                m, p = float(np.median(x[back : back + 2 * AROUND + 1])), r
                # the readings held back are the new level; go on behind them
                held = []
        else:
            if held:
                runs.append(held)
                held = []
            k = p / (p + r)
            m += k * e
            p *= 1 - k
        i += 1
    out = np.zeros(size, bool)
    for run in runs:
        out[run] = True
    for run in runs:
        a, b = run[0], run[-1]
        before = [values[j] for j in range(max(0, a - 3 * AROUND), a) if not out[j]][-AROUND:]
        after = [values[j] for j in range(b + 1, min(size, b + 1 + 3 * AROUND)) if not out[j]][:AROUND]
        near = before + after
        level = float(np.median(near))
        if before and after and abs(np.median(before) - np.median(after)) > LEVELS * s:
            continue
        for j in run:
            if abs(values[j] - level) > LEVELS * s and not stuck[at[j]]:
                spike[at[j]] = True
    return impossible, stuck, spike


def _pieces(key: np.ndarray) -> list[tuple[int, int]]:
    edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.array([0])
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _flagged(table: pa.Table) -> pa.RecordBatch:
    """src and kind of the flagged readings of whole cells."""
    key = table.column("_key").to_numpy()
    v, low, high = (table.column(c).to_numpy() for c in ("_v", "_low", "_high"))
    varied, home, src, given = (table.column(c).to_numpy() for c in ("_varied", "_home", "_src", "_s"))
    srcs, kinds = [], []
    for a, b in _pieces(key):
        some = bool(varied[a]) or v[a:b].min() != v[a:b].max()
        for kind, mask in zip(("impossible", "stuck", "spike"), flag_source(v[a:b], low[a], high[a], some, None if given[a] < 0 else float(given[a]))):
            hit = src[a:b][mask & home[a:b]]
            srcs.append(hit)
            kinds += [kind] * len(hit)
    return pa.RecordBatch.from_pydict({"src": pa.array(np.concatenate(srcs) if srcs else np.array([], np.int64), pa.int64()), "kind": pa.array(kinds, pa.string())})


def _steps_of(table: pa.Table) -> pa.RecordBatch:
    """How often each size of a difference occurs in whole cells: those that end in the cell's own
    readings, between readings that are neither impossible nor stuck, and between all possible."""
    v, low, high = (table.column(c).to_numpy() for c in ("_v", "_low", "_high"))
    varied, home, source = (table.column(c).to_numpy() for c in ("_varied", "_home", "_source"))
    out: list[tuple] = []
    for a, b in _pieces(table.column("_key").to_numpy()):
        impossible, _, free = _free(v[a:b], low[a], high[a], bool(varied[a]))
        for kind, mask in (("free", free), ("all", ~impossible)):
            at = np.flatnonzero(mask)
            mine = at[1:][home[a:b][at[1:]]]
            if len(mine):
                before = at[:-1][home[a:b][at[1:]]]
                m, e = np.frexp(np.abs(v[a:b][mine] - v[a:b][before]))
                out += [(int(source[a]), kind, float(x), int(n)) for x, n in zip(*np.unique(np.ldexp(np.round(m * 4096) / 4096, e), return_counts=True))]
    return pa.RecordBatch.from_pydict({"_source": pa.array([x[0] for x in out], pa.int64()), "_kind": pa.array([x[1] for x in out], pa.string()), "_size": pa.array([x[2] for x in out], pa.float64()), "_count": pa.array([x[3] for x in out], pa.int64())})


def _scatter_of(table: pa.Table) -> pa.Table:
    """The scatter of one source from its counted differences."""
    kind = np.array(table.column("_kind").to_pylist())
    size, count = table.column("_size").to_numpy(), table.column("_count").to_numpy()
    mine = kind == ("free" if count[kind == "free"].sum() >= 7 else "all")
    order = np.argsort(size[mine])
    return pa.table({"_source": pa.array([table.column("_source")[0].as_py()], pa.int64()), "_s": pa.array([_scatter(size[mine][order], count[mine][order])], pa.float64())})


def _by_cell(answer):
    """``answer`` for whole cells in batches sorted by source, cell, time, row; a cell may span
    batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column(batch.schema.get_field_index("_key")).to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last or (pending and pending[-1].column(0)[-1].as_py() != key[0]):
                done = [*pending, batch.slice(0, last)]
                yield answer(pa.Table.from_batches([b for b in done if b.num_rows]))
                pending = []
            pending.append(batch.slice(last))
        if pending:
            yield answer(pa.Table.from_batches(pending))

    return run


def _cells(readings: DataFrame, cell_rows: int) -> DataFrame:
    """Of hot sources' readings the seconds with readings and the cells that read them: ``_i, _x, _b,
    _cell, _home``. Cells hold about cell_rows readings; a second within HALO readings of a cell's
    end is read by its neighbour too. Places of readings are running counts over a source's
    hours and then over the seconds of an hour, so no window holds more than a source's hours."""
    per = readings.groupBy(F.col("id").alias("_i"), F.col("_text").alias("_x"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    per = per.withColumn("_hour", F.floor(F.col("_b") * SECOND_US / HOUR_US))
    hours = per.groupBy(F.col("_i").alias("_hi"), F.col("_x").alias("_hx"), F.col("_hour").alias("_hh")).agg(F.sum("_n").alias("_hn"))
    hours = hours.withColumn("_past", F.sum("_hn").over(Window.partitionBy("_hi", "_hx").orderBy("_hh").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_hn"))
    per = per.join(hours, F.col("_i").eqNullSafe(F.col("_hi")) & (F.col("_x") == F.col("_hx")) & (F.col("_hour") == F.col("_hh")))
    order = Window.partitionBy("_i", "_x", "_hour").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_to", F.col("_past") + F.sum("_n").over(order)).withColumn("_from", F.col("_to") - F.col("_n"))
    first, last = F.floor(F.greatest(F.col("_from") - HALO, F.lit(0)) / cell_rows), F.floor((F.col("_to") - 1 + HALO) / cell_rows)
    own = F.floor(F.col("_from") / cell_rows)
    return per.select("_i", "_x", "_b", own.alias("_own"), F.explode(F.sequence(first, last)).alias("_cell")).withColumn("_home", F.col("_cell") == F.col("_own")).drop("_own")


def implausible(events: DataFrame, limits: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Readings that can't be right: ``src`` (the row's _src) and ``kind``: ``impossible``,
    ``stuck`` or ``spike``. A reading can be both impossible and stuck.

    Readings are the vital rows of ``events`` whose quantity (the text before the first colon, in
    lower case, without outer blanks) is in ``limits`` (``quantity, low, high``, both ends
    possible). A source is an ``id`` (null is one id) with a ``text_value``; its readings follow
    ``time``, those at one time _src. Null and NaN are passed over. Readings without time belong
    to no sequence and can only be impossible. Of rows equal in all columns but _src the first
    counts. Empty tables give an empty table.

    Sources are independent and a task handles many. One of more than ``cell_rows`` readings is
    cut into cells, each filtered with a halo of its neighbours' readings and with the scatter of
    the whole source, which is put together from the differences counted in all cells; a run of
    equal readings longer than the halo is seen from both sides. A cell is some seconds at least.
    """
    lim = pick(limits, "quantity", "low", "high").groupBy(F.lower(F.trim("quantity")).alias("_q")).agg(F.max("low").alias("_low"), F.min("high").alias("_high"))
    e = pick(events, "id", "time", "class", "text_value", "numeric_value", "_src").filter((F.col("class") == "vital") & usable("numeric_value") & F.col("text_value").isNotNull())
    e = e.withColumn("_q", F.lower(F.trim(F.substring_index("text_value", ":", 1)))).join(lim, "_q").drop("_q")
    e = first_of_repeats(e, ["id", "time", "text_value", "numeric_value", "_low", "_high"])
    e = e.select("id", F.col("text_value").alias("_text"), epoch_us("time", events.sparkSession).alias("_t"), "_src", F.col("numeric_value").alias("_v"), "_low", "_high")

    timed = e.filter("_t is not null")
    raw = pick(events, "id", "time", "class", "text_value", "numeric_value").filter((F.col("class") == "vital") & usable("numeric_value") & F.col("text_value").isNotNull() & F.col("time").isNotNull())
    hot = raw.groupBy(F.col("id").alias("_i"), F.col("text_value").alias("_x")).agg(F.count("*").alias("_n"), (F.min("numeric_value") != F.max("numeric_value")).alias("_v_h")).filter(F.col("_n") > cell_rows)
    def in_order(rows: DataFrame) -> DataFrame:
        # one number names a source's cell in the batches; the sort keeps sources apart even if two had one number
        keyed = rows.withColumn("_key", F.xxhash64("id", "_text", "_cell")).withColumn("_source", F.xxhash64("id", "_text"))
        keyed = keyed.select("_key", "_source", "_t", "_src", "_v", "_low", "_high", "_varied", "_home", "_s", "id", "_text", "_cell")
        return keyed.repartition("_key").sortWithinPartitions("_key", "id", "_text", "_cell", "_t", "_src").drop("id", "_text", "_cell")

    whole = [F.lit(False).alias("_varied"), F.lit(0).cast("long").alias("_cell"), F.lit(True).alias("_home"), F.lit(-1.0).alias("_s")]
    flagged = None
    if not hot.isEmpty():
        timed = timed.withColumn("_bin", F.floor(F.col("_t") / SECOND_US))
        is_source = F.col("id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x"))
        big = timed.join(hot, is_source).withColumn("_varied", F.col("_v_h")).drop("_i", "_x", "_n", "_v_h")
        big = cut(big.join(_cells(big, cell_rows), is_source & (F.col("_bin") == F.col("_b"))).drop("_i", "_x", "_b").withColumn("_s", F.lit(-1.0)))
        steps = in_order(big).mapInArrow(_by_cell(_steps_of), "_source long, _kind string, _size double, _count long")
        # a source has at most some ten thousand sizes of 12 binary digits, and there are few hot sources
        scatter = steps.groupBy("_source", "_kind", "_size").agg(F.sum("_count").alias("_count")).groupBy("_source").applyInArrow(_scatter_of, "_source long, _s double")
        known = scatter.select(F.col("_source").alias("_h"), F.col("_s").alias("_g"))
        big = big.join(known, F.xxhash64("id", "_text") == F.col("_h"), "left").withColumn("_s", F.coalesce("_g", F.lit(0.0))).drop("_h", "_g")
        flagged = in_order(big).mapInArrow(_by_cell(_flagged), "src long, kind string")
        timed = timed.join(hot, is_source, "left_anti")
    cold = in_order(timed.select("*", *whole)).mapInArrow(_by_cell(_flagged), "src long, kind string")
    flagged = cold if flagged is None else cold.unionByName(flagged)
    untimed = e.filter("_t is null and (_v < _low or _v > _high)").select(F.col("_src").alias("src"), F.lit("impossible").alias("kind"))
    return flagged.unionByName(untimed)
