"""Percentiles of very large numeric columns by dyadic count-sketches.

A value is encoded as a 64-bit integer that sorts like the number. For each binary resolution, a
prefix length of the encoding, a sketch holds signed counters: a prefix adds its weight, with a
random sign, to one counter in each of DEPTH rows, and the median over the rows estimates the
weight of a prefix. Ranks are inverted by descending the resolutions. Counters are linear, so
sketches are merged by addition, and deletions are negative weights.

A group of few values would leave nearly all counters empty. While it has at most KEPT distinct
values, its updates wait as (value, weight) pairs, which are merged by addition as well and give
exact percentiles; the first value beyond puts all of them into counters. ``kept=0`` has counters
for every group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.frames import pick, usable

WIDTH, DEPTH = 1024, 5
#: Resolutions: prefixes of up to BITS bits; up to PLAIN bits each prefix has its own counter.
#: 32 bits are sign, exponent and 20 bits of the mantissa: values come out within 1 in 2**20.
BITS, PLAIN = 32, 12
LEVEL = DEPTH * WIDTH
CELLS = (1 << PLAIN) + (BITS - PLAIN) * LEVEL
#: Distinct values up to which a group's updates wait outside of the counters.
KEPT = 128
#: Rows that a task folds at once.
FOLD_ROWS = 1_000_000
STATE = "n long, pairs array<long>, weights array<long>, cells binary"
SIGN = np.uint64(1 << 63)


def encode(x: np.ndarray) -> np.ndarray:
    """uint64 that sort like the doubles; -0.0 is 0.0."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(b & SIGN != 0, ~b, b | SIGN)


def decode(u: np.ndarray) -> np.ndarray:
    return np.where(u & SIGN != 0, u ^ SIGN, ~u).view(np.float64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(prefix: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in each of the DEPTH rows: arrays (DEPTH, n)."""
    with np.errstate(over="ignore"):
        h = _mix(prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE5AB % (1 << 63)))
    shift = np.arange(DEPTH, dtype=np.uint64)[:, None] * np.uint64(11)
    part = (h[None, :] >> shift) & np.uint64(2047)
    return (part >> np.uint64(1)).astype(np.int64), 1 - 2 * (part & np.uint64(1)).astype(np.int64)


def add_pairs(cells: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Adds weighted encoded values to a sketch's counters, in place."""
    p = keys >> np.uint64(64 - BITS)
    base = 1 << PLAIN
    cells[:base] += np.bincount((p >> np.uint64(BITS - PLAIN)).astype(np.int64), weights=weights, minlength=base).astype(np.int64)
    for level in range(PLAIN + 1, BITS + 1):
        where, sign = _places(p >> np.uint64(BITS - level), level)
        flat = (where + np.arange(DEPTH)[:, None] * WIDTH).ravel()
        at = base + (level - PLAIN - 1) * LEVEL
        cells[at : at + LEVEL] += np.bincount(flat, weights=(sign * weights[None, :]).ravel(), minlength=LEVEL).astype(np.int64)
    return cells


def _quantiles_of_cells(cells: np.ndarray, permille: list[int]) -> tuple[np.ndarray, float]:
    base = 1 << PLAIN
    top = np.maximum(cells[:base], 0)
    total = int(cells[:base].sum())
    upto = np.cumsum(top)
    want = np.array([max(1, (total * q + 999) // 1000) for q in permille], np.float64)
    p = np.minimum(np.searchsorted(upto, want), base - 1).astype(np.uint64)
    rest = want - np.where(p > 0, upto[p.astype(np.int64) - 1], 0)
    here = top[p.astype(np.int64)].astype(np.float64)
    noise = 0.0
    for level in range(PLAIN + 1, BITS + 1):
        at = base + (level - PLAIN - 1) * LEVEL
        rows = cells[at : at + LEVEL].reshape(DEPTH, WIDTH)
        left = p << np.uint64(1)
        where, sign = _places(left, level)
        w = np.median(np.take_along_axis(rows, where, 1) * sign, axis=0)
        w = np.clip(w, 0, here)
        right = rest > w
        rest, here = np.where(right, rest - w, rest), np.where(right, here - w, w)
        p = np.where(right, left + np.uint64(1), left)
        # the largest counters are values of their own and disturb others only by a rare collision
        tail = np.sort(np.abs(rows), axis=1)[:, : WIDTH - 16].astype(np.float64)
        noise += float(np.median((tail**2).sum(axis=1))) / WIDTH
    return decode(p << np.uint64(64 - BITS)), max(2 * noise**0.5, 0.5) / max(total, 1)


def _quantiles_of_pairs(keys: np.ndarray, weights: np.ndarray, permille: list[int]) -> np.ndarray:
    order = np.argsort(keys)
    upto = np.cumsum(np.maximum(weights[order], 0))
    total = int(upto[-1])
    at = np.searchsorted(upto, [max(1, (total * q + 999) // 1000) for q in permille])
    return decode(keys[order][np.minimum(at, len(keys) - 1)])


def _group_codes(t: pa.Table, names: list[str]) -> np.ndarray:
    code = np.zeros(t.num_rows, np.int64)
    for n in names:
        d = pc.dictionary_encode(t.column(n).combine_chunks(), null_encoding="encode")
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def _fold(t: pa.Table, names: list[str], code: np.ndarray, group: np.ndarray, keys: np.ndarray, weights: np.ndarray, kept: int) -> pa.Table:
    """Sketches of the groups of a table. code: the group of each row; group, keys, weights: the
    pairs; the table's column cells, if any, has counters that are added. Groups of more than ``kept``
    pairs get counters."""
    first = np.unique(code, return_index=True)[1]
    order = np.lexsort((keys, group))
    g, k, w = group[order], keys[order], weights[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    w = np.add.reduceat(w, at) if len(at) else w
    g, k = g[at], k[at]
    some = w != 0
    g, k, w = g[some], k[some], w[some]
    bounds = np.searchsorted(g, np.arange(len(first) + 1))
    given: dict[int, list[int]] = {}
    if "cells" in t.column_names:
        c = t.column("cells")
        for i in np.flatnonzero(np.asarray(c.is_valid())):
            given.setdefault(int(code[i]), []).append(int(i))
    n = np.bincount(g, weights=w, minlength=len(first)).astype(np.int64)
    size = np.diff(bounds)
    stays = np.ones(len(g), bool)
    packed: list[bytes | None] = [None] * len(first)
    # one group's counters at a time are unpacked
    for i in sorted({*given, *np.flatnonzero(size > kept).tolist()}):
        cells = np.zeros(CELLS, np.int64)
        for j in given.get(i, []):
            cells += np.frombuffer(zlib.decompress(c[j].as_py()), np.int64)
        x, y = bounds[i], bounds[i + 1]
        if y > x:
            add_pairs(cells, k[x:y], w[x:y])
            stays[x:y] = False
        n[i], size[i], packed[i] = cells[: 1 << PLAIN].sum(), 0, zlib.compress(cells.tobytes(), 1)
    offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
    cols = {x: t.column(x).combine_chunks().take(pa.array(first)) for x in names}
    cols |= {
        "n": pa.array(n), "pairs": pa.ListArray.from_arrays(offsets, pa.array(k[stays].view(np.int64))), "weights": pa.ListArray.from_arrays(offsets, pa.array(w[stays])),
        "cells": pa.array(packed, pa.binary()),
    }
    return pa.table(cols)


def _build(names: list[str], kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def fold() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            code = _group_codes(t, names)
            yield from _fold(t, names, code, code, encode(t.column("_v").to_numpy()), t.column("_w").to_numpy(), kept).to_batches(20_000)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= FOLD_ROWS:
                yield from fold()
                held = []
        if held:
            yield from fold()

    return run


def _merge(names: list[str], kept: int):
    """Sketches sorted by group to one per group. What was folded of the last group goes on into
    the next round, so that memory holds a bounded number of pairs and counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def fold() -> pa.Table:
            t = pa.concat_tables(held).combine_chunks()
            code = _group_codes(t, names)
            # the groups keep the order in which they stand
            first = np.unique(code, return_index=True)[1]
            code = np.argsort(np.argsort(first))[code]
            pairs, weights = t.column("pairs").combine_chunks(), t.column("weights").combine_chunks()
            length = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False)
            flat = lambda a: pc.list_flatten(a).to_numpy(zero_copy_only=False)
            return _fold(t, names, code, np.repeat(code, length), flat(pairs).view(np.uint64), flat(weights), kept)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            c = b.schema.get_field_index
            size += b.num_rows + len(b.column(c("pairs")).values) + 5_000 * (b.num_rows - b.column(c("cells")).null_count)
            if size >= FOLD_ROWS:
                t = fold()
                yield from t.slice(0, t.num_rows - 1).to_batches(20_000)
                held = [t.slice(t.num_rows - 1)]
                size = 0
        if held:
            yield from fold().to_batches(20_000)

    return run


def _schema(df: DataFrame, names: list[str]) -> T.StructType:
    keys = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType(keys + T.StructType.fromDDL(STATE).fields)


def sketch(df: DataFrame, by: list[str], value: str, weight: str | None = None, kept: int = KEPT) -> DataFrame:
    """Partial sketches of a numeric column by group: ``by`` and the state columns. Several rows
    may stand for one group; ``merged`` unites them.

    Null and NaN values and null weights are left out; null keys are a group. ``weight`` (default
    1 a row) may be negative: that deletes values counted elsewhere.
    """
    names = [f"_k{i}" for i in range(len(by))]
    cols = pick(df, *dict.fromkeys([*by, value, *([weight] if weight else [])]))
    rows = cols.filter(usable(F.col(f"`{value}`").cast("double"))).select(*[F.col(f"`{b}`").alias(n) for b, n in zip(by, names)], F.col(f"`{value}`").cast("double").alias("_v"), (F.col(f"`{weight}`") if weight else F.lit(1)).cast("long").alias("_w"))
    rows = rows.filter("_w is not null")
    return rows.mapInArrow(_build(names, kept), _schema(rows, names)).withColumnsRenamed(dict(zip(names, by)))


def merged(sketches: DataFrame, by: list[str], salts: int = 8, kept: int = KEPT) -> DataFrame:
    """One sketch per group of ``by``, by adding up sketches of parts, days or tables (``union``
    them first). Merging goes over ``salts`` parts of each group and then over groups, so that a
    group with any number of partial sketches isn't added up by one task alone. Groups of more than
    ``kept`` distinct values come out as counters.
    """
    names = [f"_k{i}" for i in range(len(by))]
    state = ["n", "pairs", "weights", "cells"]
    s = pick(sketches, *by, *state).toDF(*names, *state)
    out = _schema(s, names)
    if salts > 1:
        part = s.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        part = part.repartition(F.xxhash64(*names, "_salt")).drop("_salt").sortWithinPartitions(*names)
        s = part.mapInArrow(_merge(names, KEPT), out)
    s = s.repartition(F.xxhash64(*names)).sortWithinPartitions(*names)
    return s.mapInArrow(_merge(names, kept), out).withColumnsRenamed(dict(zip(names, by)))


def quantiles(sketches: DataFrame, by: list[str], permille: dict[str, int]) -> DataFrame:
    """Percentiles from merged sketches: ``by``, ``n``, a column per name in ``permille`` (500 is
    the median) and ``rank_error``.

    The q-quantile of n values is the ceil(q * n)-th smallest, at least the first. ``rank_error``
    is the share of n by which the rank of a result may be off (0 for groups kept as pairs; for
    counters twice the standard error, estimated from their size, and half a rank at least); values read from counters are
    also cut to 20 bits of their mantissa. Groups whose weights add up to nothing don't come out.
    """
    cuts = list(permille.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            found = np.full((b.num_rows, len(cuts)), np.nan)
            error = np.zeros(b.num_rows)
            pairs, weights, cells = (t.column(c).combine_chunks() for c in ("pairs", "weights", "cells"))
            offsets = pairs.offsets.to_numpy()
            keys, w = pairs.values.to_numpy(zero_copy_only=False).view(np.uint64), weights.values.to_numpy(zero_copy_only=False)
            dense = np.asarray(cells.is_valid())
            for i in range(b.num_rows):
                if dense[i]:
                    found[i], error[i] = _quantiles_of_cells(np.frombuffer(zlib.decompress(cells[i].as_py()), np.int64), cuts)
                else:
                    found[i] = _quantiles_of_pairs(keys[offsets[i] : offsets[i + 1]], w[offsets[i] : offsets[i + 1]], cuts)
            cols = [t.column(c).combine_chunks() for c in [*names, "n"]] + [pa.array(found[:, j]) for j in range(len(cuts))] + [pa.array(error)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", *[f"_q{j}" for j in range(len(cuts))], "rank_error"])

    names = [f"_k{i}" for i in range(len(by))]
    s = pick(sketches, *by, "n", "pairs", "weights", "cells").toDF(*names, "n", "pairs", "weights", "cells").filter("n > 0")
    schema = T.StructType([s.schema[n] for n in names] + [T.StructField("n", T.LongType())] + [T.StructField(f"_q{j}", T.DoubleType()) for j in range(len(cuts))] + [T.StructField("rank_error", T.DoubleType())])
    out = s.mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(names, by)) | {f"_q{j}": n for j, n in enumerate(permille)})


PERMILLE = {"p01": 10, "p05": 50, "p10": 100, "p25": 250, "p50": 500, "p75": 750, "p90": 900, "p95": 950, "p99": 990}


def daily_sketches(events: DataFrame) -> DataFrame:
    """Sketches of ``numeric_value`` by class, text and day (null for rows without time) of an
    event table's distinct rows."""
    e = pick(events, "id", "time", "class", "text_value", "numeric_value").filter(usable("numeric_value")).distinct()
    return sketch(e.select("class", "text_value", F.to_date("time").alias("day"), "numeric_value"), ["class", "text_value", "day"], "numeric_value")


def event_percentiles(events: DataFrame, permille: dict[str, int] | None = None, by: tuple[str, ...] = ("class", "text_value"), kept: int = KEPT) -> DataFrame:
    """Percentiles of ``numeric_value`` for each class and text (or ``by`` of ``class``,
    ``text_value`` and ``day``), united from the sketches of days."""
    return quantiles(merged(daily_sketches(events), list(by), kept=kept), list(by), permille or PERMILLE)


def rank_check(found: DataFrame, rows: DataFrame, by: list[str], value: str, permille: dict[str, int]) -> DataFrame:
    """Whether percentiles keep the error they state: ``by, percentile, n, counters, within``.

    A value keeps it if the exact rank that it should have differs by at most ``rank_error`` * n
    from the ranks that it has in ``rows``, values within 1 in 2^19 taken for equal (counters
    have 20 bits of the mantissa). ``counters``: it was read from counters.
    """
    names = [f"_k{i}" for i in range(len(by))]
    h = pick(rows, *by, value).toDF(*names, "_v").filter(usable("_v")).groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    cuts = F.explode(F.array(*[F.struct(F.lit(n).alias("percentile"), F.lit(q).alias("_q"), F.col(n).alias("_x")) for n, q in permille.items()])).alias("_p")
    f = found.select(*[F.col(b).alias(f"_f{i}") for i, b in enumerate(by)], "n", "rank_error", cuts).select(*[f"_f{i}" for i in range(len(by))], "n", "rank_error", "_p.*")
    on = F.lit(True)
    for i in range(len(by)):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(f"_f{i}"))
    near = F.abs("_x") * 2.0**-19
    ranks = h.join(f, on).groupBy(*names, "percentile", "_q", "n", "rank_error").agg(
        F.sum(F.when(F.col("_v") < F.col("_x") - near, F.col("_c")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("_v") <= F.col("_x") + near, F.col("_c")).otherwise(0)).alias("_upto"),
    )
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("_q") / 1000))
    slack = F.col("rank_error") * F.col("n") + 1e-6
    out = ranks.select(*names, "percentile", "n", (F.col("rank_error") > 0).alias("counters"), ((k >= F.col("_below") + 1 - slack) & (k <= F.col("_upto") + slack)).alias("within"))
    return out.withColumnsRenamed(dict(zip(names, by)))
