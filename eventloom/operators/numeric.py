"""Numbers by group: levels, quantile edges, distributions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import cut
from eventloom.operators.running import running

#: Distinct values of a group that a task holds in memory when it looks for edges; those of a larger
#: group lie in files on its disk. The edges are the same.
IN_MEMORY = 1_000_000
#: Distinct values from which a group is ranked in blocks.
HOT_VALUES = 2_000_000

PARAMS = "distribution string, mean double, var double, mu double, sigma2 double, alpha double, beta double, vmin double, vmax double, low double, high double"


def histogram(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, v, c``: how often each value occurs; missing numbers left out. Partial sums make hot
    groups harmless."""
    h = rows.select(*keys, value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    return h.groupBy(*keys, "v").agg(F.count("*").alias("c"))


def value_block(v: Column) -> Column:
    """A number that rises with v: 4096 blocks to each octave."""
    size = F.floor(F.log2(F.abs(v)) * 4096) + (1100 * 4096)
    return F.when(v == 0, F.lit(0)).when(F.isnan(v) | (F.abs(v) == float("inf")), F.signum(v) * (1 << 40)).otherwise(F.signum(v) * size).cast("long")


def ranked(hist: DataFrame, keys: list[str]) -> DataFrame:
    """A histogram with ``upto`` (rows up to and including the value), ``n`` (rows of the group) and
    ``n_distinct``.

    Everything that follows works on groups that lie together: one exchange. Groups of more than
    HOT_VALUES distinct values are marked in a column ``_hot``; their ranks come from running
    counts over blocks of values and then within a block, and their totals are broadcast, a row per
    hot group. The results are the same.
    """
    hist = cut(hist)
    size = hist.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    hot = cut(size.filter(F.col("n_distinct") > HOT_VALUES))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda h: h.select("*", F.sum("c").over(so_far).alias("upto"), F.sum("c").over(group).alias("n"), F.count("*").over(group).alias("n_distinct"))
    if hot.isEmpty():
        return whole(hist)
    h = _attached(hist, keys, hot).withColumnRenamed("n", "_hot")
    large = h.filter("_hot is not null").withColumn("_blk", value_block(F.col("v")))
    large = running(large, keys, ["v"], {"upto": ("sum", F.col("c"))}, inclusive=True).select(*keys, "v", "c", "upto", F.col("_hot").alias("n"), "n_distinct", F.lit(True).alias("_hot"))
    small = whole(h.filter("_hot is null").select(*keys, "v", "c")).withColumn("_hot", F.lit(False))
    return small.unionByName(large)


def _attached(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """Columns of a table with one row per hot group, of which there are few, beside the rows."""
    t = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(F.broadcast(t), on, "left").drop(*[f"_k_{k}" for k in keys])


def beside(ranks: DataFrame, keys: list[str], wanted) -> DataFrame:
    """Adds aggregates of the group to each row of a ranked histogram. ``wanted(of)`` gives name ->
    expression, of turning an aggregate into the one that is asked for: over a window, or for hot
    groups in an aggregation of its own whose rows are broadcast."""
    group = Window.partitionBy(*keys)
    over = lambda r: r.select("*", *[c.alias(n) for n, c in wanted(lambda c: c.over(group)).items()])
    if "_hot" not in ranks.columns:
        return over(ranks)
    large = ranks.filter("_hot")
    found = large.groupBy(*keys).agg(*[c.alias(n) for n, c in wanted(lambda c: c).items()])
    return over(ranks.filter("not _hot")).unionByName(_attached(large, keys, found))


def at_rank(k: Column, value: Column) -> Column:
    """The value at rank k (from 0) of a group of a ranked histogram, as an aggregate."""
    return F.max(F.when((k >= F.col("upto") - F.col("c")) & (k < F.col("upto")), value))


def _between(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation, computed from the nearer end as numpy does."""
    return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def percentile(p: float, of=lambda c: c) -> Column:
    """The p-th percentile of a group with linear interpolation between neighbours (numpy's
    default), as an aggregate, or what ``of`` makes of aggregates."""
    h = (F.col("n") - 1) * (p / 100.0)
    a, b = of(at_rank(F.floor(h), F.col("v"))), of(at_rank(F.least(F.floor(h) + 1, F.col("n") - 1), F.col("v")))
    return _between(a, b, of(F.max(h - F.floor(h))))


def exact_percentiles(ranks: DataFrame, keys: list[str], percents: dict[str, float]) -> DataFrame:
    """``keys``, a column per name, ``n`` and ``n_distinct`` from a ranked histogram."""
    return ranks.groupBy(*keys).agg(*[percentile(p).alias(name) for name, p in percents.items()], F.max("n").alias("n"), F.max("n_distinct").alias("n_distinct"))


def clipped(ranks: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """A ranked histogram with the group's percentiles ``low`` and ``high``."""
    return beside(ranks, keys, lambda of: {"low": percentile(low, of), "high": percentile(high, of)})


def quantile_edges(values: np.ndarray, counts: np.ndarray, n_bins: int, clip: tuple[float, float]) -> list[float]:
    """Edges of up to n_bins bins of similar mass, none of which splits equal values.

    Edges lie in gaps between neighbouring distinct values within the clip percentiles. First the
    gaps next to even quantiles between those percentiles are taken; while there are too few, the
    heaviest bin that can be split gets the gap that balances it best.
    """
    keep = np.isfinite(values)
    order = np.argsort(values[keep])
    return _edges(values[keep][order].astype(float), np.cumsum(counts[keep][order].astype(np.int64)), n_bins, clip)


def _edges(u: np.ndarray, upto: np.ndarray, n_bins: int, clip: tuple[float, float]) -> list[float]:
    """The same for finite ascending distinct values with their running counts. Only looks up single
    ranks and values, so that both may be mapped files."""
    wanted = n_bins - 1
    if wanted < 1 or len(u) == 0:
        return []
    n = int(upto[-1])

    def quantile(q: np.ndarray) -> np.ndarray:
        h = q * (n - 1)
        f = np.floor(h)
        a, b = (u[np.searchsorted(upto, np.minimum(r, n - 1).astype(np.int64), side="right")] for r in (f, f + 1))
        t = h - f
        return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)

    cuts = quantile(np.linspace(clip[0] / 100, clip[1] / 100, wanted))
    low, high = quantile(np.array([clip[0] / 100, clip[1] / 100]))
    start, end = int(np.searchsorted(u, low)), int(np.searchsorted(u, high, side="right"))
    if start >= end:
        start, end = 0, len(u)
    if end - start < 2:
        return []
    wanted = min(wanted, end - start - 1)
    before = lambda i: int(upto[i - 1]) if i else 0
    gaps = {int(g) for g in np.clip(np.searchsorted(u, cuts), start, end - 2)}
    while len(gaps) < wanted:
        bounds = [start - 1, *sorted(gaps), end - 1]
        bins = [(before(b + 1) - before(a + 1), a + 1, b) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
        if not bins:
            break
        mass, first, final = max(bins)
        # running counts rise, so the best gap is the first that leaves half to the left, or the one before
        half = before(first) + (mass + 1) // 2
        g = min(first + int(np.searchsorted(upto[first:final], half)), final - 1)
        off = lambda i, first=first, mass=mass: abs(2 * (int(upto[i]) - before(first)) - mass)
        gaps.add(g - 1 if g > first and off(g - 1) <= off(g) else g)
    g = np.array(sorted(gaps))
    return ((u[g] + u[g + 1]) / 2).tolist()


class _Ascending:
    """The finite distinct values of one group with running counts, added in ascending order; in
    files once there are more than IN_MEMORY."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.files: list = []
        self.held = self.rows = 0

    def add(self, v: np.ndarray, c: np.ndarray) -> None:
        keep = np.isfinite(v)
        upto = self.rows + np.cumsum(c[keep].astype(np.int64))
        if not len(upto):
            return
        self.rows = int(upto[-1])
        self.parts.append((v[keep].astype(float), upto))
        self.held += len(upto)
        if self.held > IN_MEMORY:
            self._write()

    def _write(self) -> None:
        if not self.files:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.files = [tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) for _ in range(2)]
        for part in self.parts:
            for f, x in zip(self.files, part):
                f.write(x.tobytes())
        self.parts, self.held = [], 0

    def edges(self, n_bins: int, clip: tuple[float, float]) -> list[float]:
        if not self.rows:
            return []
        if not self.files:
            return _edges(np.concatenate([v for v, _ in self.parts]), np.concatenate([c for _, c in self.parts]), n_bins, clip)
        self._write()
        for f in self.files:
            f.flush()
        try:
            return _edges(*(np.memmap(f, t, "r") for f, t in zip(self.files, (np.float64, np.int64))), n_bins, clip)
        finally:
            for f in self.files:
                f.close()


def _edge_stream(keys: list[str], n_bins: int, clip: tuple[float, float]):
    """Sorted batches of a clipped ranked histogram to one row of edges per group. A group may span
    batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        bounds: tuple[float, float] = (0.0, 0.0)
        held = _Ascending()
        done: list[tuple] = []

        def close() -> None:
            if key is not None:
                done.append((key, held.edges(n_bins, clip), *bounds))

        def flush() -> pa.RecordBatch:
            cols = {k: [r[0][i] for r in done] for i, k in enumerate(keys)}
            b = pa.RecordBatch.from_pydict({**{k: pa.array(x, schema.field(k).type) for k, x in cols.items()}, "edges": pa.array([r[1] for r in done], pa.list_(pa.float64())), "low": pa.array([r[2] for r in done], pa.float64()), "high": pa.array([r[3] for r in done], pa.float64())})
            done.clear()
            return b

        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            col = lambda n, b=b: b.column(b.schema.get_field_index(n))
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                d = pc.dictionary_encode(col(k), null_encoding="encode")
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
            v, c, low, high = (col(x).to_numpy() for x in ("v", "c", "low", "high"))
            starts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
            for i, j in zip(starts, np.r_[starts[1:], len(v)]):
                mine = tuple(col(k)[int(i)].as_py() for k in keys)
                if mine != key:
                    close()
                    key, held, bounds = mine, _Ascending(), (float(low[i]), float(high[i]))
                held.add(v[i:j], c[i:j])
            if len(done) > 5000:
                yield flush()
        close()
        if done:
            yield flush()

    return run


def edges_by_group(ranks: DataFrame, keys: list[str], config: TokenizerConfig) -> DataFrame:
    """``keys, edges, low, high`` from a ranked histogram, low and high being the clip percentiles.
    A task reads the distinct values of its groups one after the other, holding few of them."""
    clip = (config.bin_clip_min, config.bin_clip_max)
    r = clipped(ranks, keys, *clip)
    if "_hot" in r.columns:
        r = r.drop("_hot").repartition(*keys)
    r = r.sortWithinPartitions(*keys, "v")
    types = {f.name: f.dataType.simpleString() for f in ranks.schema.fields}
    return r.mapInArrow(_edge_stream(keys, config.n_bins, clip), ", ".join(f"{k} {types[k]}" for k in keys) + ", edges array<double>, low double, high double")


def moments(ranks: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Fits of all four distributions to values clipped to the group's percentiles low and high:
    ``keys, low, high, mean, var, mu, sigma2, alpha, beta, vmin, vmax, n``. Variances are those of
    the population; the lognormal is fitted to positive values, and is 0 and 1 without any."""
    r = clipped(ranks, keys, low, high).withColumn("x", F.least(F.greatest("v", "low"), F.col("high")))
    pos = F.when(F.col("x") > 0, F.col("c"))
    log = F.log(F.when(F.col("x") > 0, F.col("x")))
    r = beside(r, keys, lambda of: {"mean": of(F.sum(F.col("x") * F.col("c"))) / of(F.max("n")), "mu": of(F.sum(log * F.col("c"))) / of(F.sum(pos))})
    away, apart = F.col("x") - F.col("mean"), log - F.col("mu")
    out = r.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("low", "high", "mean", "mu", "n")], (F.sum(away * away * F.col("c")) / F.first("n")).alias("var"),
        (F.sum(apart * apart * F.col("c")) / F.sum(pos)).alias("sigma2"), F.min("x").alias("vmin"), F.max("x").alias("vmax"),
    )
    mean, var = F.col("mean"), F.col("var")
    return out.select(
        *keys, "low", "high", "mean", "var", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("sigma2", F.lit(1.0)).alias("sigma2"),
        (mean * mean / F.greatest(var, F.lit(1e-8))).alias("alpha"), (var / F.greatest(mean, F.lit(1e-8))).alias("beta"), "vmin", "vmax", "n",
    )


def levels_by_group(ranks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys, levels``: the ascending distinct values of groups that have at most ``most``."""
    return ranks.filter(F.col("n_distinct") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("levels"))
