"""Scalar functions as column expressions: pieces of texts, calendar, numbers, bits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import DAY_US

TINY = 1e-8
LN2 = math.log(2.0)
MAX_AGE = 120


# --- texts -----------------------------------------------------------------------------------


def split_text(cls: Column, text: Column, config: TokenizerConfig) -> Column:
    """Pieces of a text by its class's rule; a class without rule keeps the text whole. Empty
    pieces stay; widths count code points and the last piece is the rest."""
    out = F.array(text)
    for name, rule in sorted(config.splitters.items()):
        if isinstance(rule, str):
            pieces = F.split(text, "\\Q" + rule.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
        else:
            cuts, at = [], 1
            for w in rule[:-1]:
                cuts.append(F.substring(text, at, w))
                at += w
            pieces = F.array(*cuts, F.substring(text, at, 2**31 - 1 - at))
        out = F.when(cls == name, pieces).otherwise(out)
    return out


def name_pieces(cls: Column, pieces: Column, config: TokenizerConfig) -> Column:
    """Token strings of pieces: with class fusion the first becomes <|class:piece|>, with
    namespaces the others class:piece."""
    if not (config.fuse_class_to_concept or config.namespace_concepts_by_class):
        return pieces
    plain = (lambda p: F.concat(cls, F.lit(":"), p)) if config.namespace_concepts_by_class else (lambda p: p)
    first = (lambda p: F.concat(F.lit("<|"), cls, F.lit(":"), p, F.lit("|>"))) if config.fuse_class_to_concept else plain
    return F.transform(pieces, lambda p, i: F.when(i == 0, first(p)).otherwise(plain(p)))


def join_pieces(cls: Column, pieces: Column, config: TokenizerConfig) -> Column:
    """The text that pieces came from; null without pieces."""
    out = F.array_join(pieces, "")
    for name, rule in config.splitters.items():
        if isinstance(rule, str):
            out = F.when(cls == name, F.array_join(pieces, rule)).otherwise(out)
    return F.when(F.size(pieces) > 0, out)


# --- time ------------------------------------------------------------------------------------


def milestone_token(kind: Column, time: Column, shift_start: int) -> Column:
    """The marker of a moment for a kind of milestone, or null."""
    since = F.pmod(F.hour(time) - shift_start, F.lit(24))
    of = lambda name, n: F.concat(F.lit(f"<|ms_{name}_"), n.cast("int").cast("string"), F.lit("|>"))
    return (
        F.when(kind == "week", of("week", F.weekofyear(time)))
        .when(kind == "month", of("month", F.month(time)))
        .when(kind == "daily", of("day", F.weekday(time) + 1))
        .when(kind == "12hr", of("12hr", F.floor(since / 12)))
        .when(kind == "8hr", of("8hr", F.floor(since / 8)))
    )


def milestone_key(kind: Column, time: Column, shift_start: int) -> Column:
    """What must change for a milestone to be marked again: ISO year and week, year and month, date,
    or calendar date and shift."""
    since = F.pmod(F.hour(time) - shift_start, F.lit(24))
    day = F.date_format(time, "yyyyMMdd").cast("long")
    return (
        F.when(kind == "week", F.extract(F.lit("YEAROFWEEK"), time).cast("long") * 100 + F.weekofyear(time))
        .when(kind == "month", F.year(time).cast("long") * 100 + F.month(time))
        .when(kind == "daily", day)
        .when(kind == "12hr", day * 10 + F.floor(since / 12))
        .when(kind == "8hr", day * 10 + F.floor(since / 8))
    )


def age_years(us: Column, birth_us: Column) -> Column:
    """Whole years of 365 days between two moments in microseconds."""
    return F.floor((us - birth_us) / (365 * DAY_US)).cast("int")


def band_index(seconds: Column, config: TokenizerConfig) -> Column:
    """The band of a time difference: the first whose threshold isn't below it, else the last."""
    scales = list(config.time_scales or [])
    out = F.lit(len(scales))
    for i in reversed(range(len(scales))):
        out = F.when(seconds <= float(scales[i]), F.lit(i)).otherwise(out)
    return out


# --- numbers -----------------------------------------------------------------------------------


def digitize(x: Column, edges: Column) -> Column:
    """How many edges are not above x: 0 below all edges."""
    return F.size(F.filter(edges, lambda e: e <= x))


def level_index(x: Column, levels: Column) -> Column:
    """The place of x among the ascending levels; of a value between levels the next above, at
    most the last."""
    at = F.size(F.filter(levels, lambda v: v < x))
    return F.least(at, F.size(levels) - 1)


def bin_midpoint(edges: Column, index: Column) -> Column:
    """A value for a bin: the middle of its edges, the outermost edge for open bins, 0 without
    edges."""
    n = F.size(edges)
    inner = (F.get(edges, index - 1) + F.get(edges, index)) / 2
    return F.when(n == 0, F.lit(0.0)).when(index <= 0, F.get(edges, F.lit(0))).when(index >= n, F.get(edges, n - 1)).otherwise(inner)


def bin_width(edges: Column, index: Column) -> Column:
    """The width of a bin; open bins have that of their neighbour; 1 with fewer than two edges."""
    n = F.size(edges)
    upper = F.when(index <= 0, F.lit(1)).when(index >= n, n - 1).otherwise(index)
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(F.abs(F.get(edges, upper) - F.get(edges, upper - 1)), F.lit(1e-12)))


def is_edge_bin(edges: Column, index: Column) -> Column:
    return (index <= 0) | (index >= F.size(edges))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x within the thresholds, if both are there."""
    return F.when(low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high)).otherwise(x)


def _at_least(x: Column, least: float = TINY) -> Column:
    return F.greatest(x, F.lit(least))


def scale(x: Column, p: Column, clip: bool = True) -> Column:
    """x in the units of a fitted distribution. p is a struct with distribution, mean, var, mu,
    sigma2, alpha, beta, vmin, vmax, low, high; of an unknown distribution x stays."""
    x = clamp(x, p["low"], p["high"]) if clip else x
    return (
        F.when(p["distribution"] == "normal", (x - p["mean"]) / F.sqrt(_at_least(p["var"])))
        .when(p["distribution"] == "lognormal", (F.log(_at_least(x)) - p["mu"]) / F.sqrt(_at_least(p["sigma2"])))
        .when(p["distribution"] == "gamma", (x - p["alpha"] * p["beta"]) / F.sqrt(_at_least(p["alpha"] * p["beta"] * p["beta"])))
        .when(p["distribution"] == "minmax", (x - p["vmin"]) / _at_least(p["vmax"] - p["vmin"]))
        .otherwise(x)
    )


def unscale(z: Column, p: Column) -> Column:
    """The inverse of ``scale``."""
    return (
        F.when(p["distribution"] == "normal", z * F.sqrt(_at_least(p["var"])) + p["mean"])
        .when(p["distribution"] == "lognormal", F.exp(z * F.sqrt(_at_least(p["sigma2"])) + p["mu"]))
        .when(p["distribution"] == "gamma", z * F.sqrt(_at_least(p["alpha"] * p["beta"] * p["beta"])) + p["alpha"] * p["beta"])
        .when(p["distribution"] == "minmax", z * _at_least(p["vmax"] - p["vmin"]) + p["vmin"])
        .otherwise(z)
    )


def log_slope(p: Column, z: Column) -> Column:
    """ln of the derivative of ``scale`` at the value with scaled value z. Of a lognormal without
    z only the part that doesn't depend on it."""
    s2 = _at_least(p["sigma2"])
    x = _at_least(F.exp(z * F.sqrt(s2) + p["mu"]))
    gamma = _at_least(p["alpha"]) * _at_least(p["beta"]) * _at_least(p["beta"])
    return (
        F.when(p["distribution"] == "normal", -0.5 * F.log(_at_least(p["var"])))
        .when((p["distribution"] == "lognormal") & z.isNotNull(), -F.log(x) - 0.5 * F.log(s2))
        .when(p["distribution"] == "lognormal", -0.5 * F.log(s2))
        .when(p["distribution"] == "gamma", -0.5 * F.log(gamma))
        .when(p["distribution"] == "minmax", -F.log(_at_least(F.abs(p["vmax"] - p["vmin"]))))
        .otherwise(F.lit(0.0))
    )


# --- bits --------------------------------------------------------------------------------------


def log_normal_below(z: np.ndarray) -> np.ndarray:
    """ln of the standard normal distribution function, exact in the far tail too: by erfc where
    that isn't zero, by its asymptotic series below."""
    z = np.asarray(z, float)
    out = np.full(z.shape, np.nan)
    near = z > -20
    out[near] = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v < 6 else math.log1p(-0.5 * math.erfc(v / math.sqrt(2))) for v in z[near]]
    far = z <= -20
    v2 = 1 / z[far] ** 2
    out[far] = -0.5 * z[far] ** 2 - np.log(-z[far]) - 0.5 * math.log(2 * math.pi) + np.log1p(-v2 * (1 - 3 * v2 * (1 - 5 * v2 * (1 - 7 * v2))))
    return out


def log_ndtr(z: Column) -> Column:
    """``log_normal_below`` of a column; null gives NaN. Spark has no such function."""

    def below(v: pd.Series) -> pd.Series:
        return pd.Series(log_normal_below(v.to_numpy(dtype=float, na_value=np.nan)))

    return F.pandas_udf(below, "double")(z)


def gaussian_bits(x: Column, mean: Column, sd: Column) -> Column:
    """Bits of a value under a normal density; 0 for a missing value."""
    bits = (0.5 * math.log(2 * math.pi) + F.log(sd) + (x - mean) * (x - mean) / (2 * sd * sd)) / LN2
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(bits)


def categorical_bits(probability: Column) -> Column:
    return -F.log2(probability)
