"""Which distribution suits the numbers of each group."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.numeric import at_rank, beside, histogram, ranked

# The percentiles at which a fit is compared with the normal distribution.
PERCENTS = (0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9)
LEAST_ROWS = 30
FAMILIES = ("normal", "lognormal", "gamma", "minmax")


def nearest(p: float):
    """The rank of the p-th percentile that is a value of the group: (n - 1) p, halves rounded up."""
    return F.floor((F.col("n") - 1) * (p / 100.0) + 0.5)


def recommend(rows: DataFrame, keys: list[str], value: str = "numeric_value", clip: tuple[float, float] = (1.0, 99.0), least_rows: int = LEAST_ROWS) -> DataFrame:
    """For each group of at least ``least_rows`` numbers: count, moments, percentiles, how far each
    fitted distribution is from normal, and ``recommendation``.

    Numbers are clipped to the group's clip percentiles first. A distribution's score is the root
    mean square difference between its scaled percentiles and the normal ones. Bounded groups
    (0 to 100, range at most 100) whose 90th percentile lies in the upper fifth take minmax if it
    scores under 2; groups with negative numbers take normal; others the smallest score to nine
    digits, ties in the order normal, lognormal, gamma, minmax (normal and gamma fitted by moments
    score alike, and the last digits of sums don't decide between them). Lognormal and gamma need positive numbers.
    Null keys are groups; smaller groups and empty tables give no rows. Everything is computed
    from one histogram per group; large groups come first.
    """
    r = ranked(histogram(rows, keys, F.col(value)), keys).filter(F.col("n") >= least_rows)
    r = beside(r, keys, lambda of: {"low": of(at_rank(nearest(clip[0]), F.col("v"))), "high": of(at_rank(nearest(clip[1]), F.col("v")))})
    # clipping keeps the order, so ranks of values are ranks of clipped values
    r = r.withColumn("x", F.least(F.greatest("v", "low"), F.col("high")))
    log = F.log(F.when(F.col("x") > 0, F.col("x")))
    r = beside(r, keys, lambda of: {"mean": of(F.sum(F.col("x") * F.col("c"))) / of(F.max("n")), "_mu": of(F.sum(log * F.col("c"))) / of(F.max("n"))})
    names = {f"p{str(p).replace('.', '_')}": p for p in PERCENTS}
    d, dl = F.col("x") - F.col("mean"), log - F.col("_mu")
    g = r.groupBy(*keys).agg(
        F.first("n").alias("count"), F.first("mean").alias("mean"), F.first("_mu").alias("_mu"), F.min("x").alias("min_val"), F.max("x").alias("max_val"), F.sum(d * d * F.col("c")).alias("_ss"),
        F.sum(d * d * d * F.col("c")).alias("_s3"), (F.sum(dl * dl * F.col("c")) / F.sum("c")).alias("_sigma2"), *[at_rank(nearest(p), F.col("x")).alias(name) for name, p in names.items()],
    )
    var, mean = F.col("_ss") / F.col("count"), F.col("mean")
    std = F.sqrt(F.col("_ss") / (F.col("count") - 1))
    g = g.withColumn("std", std).withColumn("skewness", F.col("_s3") / F.col("count") / F.pow(F.nullif(F.col("std"), F.lit(0.0)), F.lit(3.0))).withColumn("_var", var)
    g = g.withColumn("_alpha", F.when(F.col("_var") > 0, mean * mean / F.col("_var")).otherwise(1.0)).withColumn("_beta", F.when(mean > 0, F.col("_var") / mean).otherwise(1.0))
    floor = lambda c: F.greatest(c, F.lit(1e-8))
    scaled = {
        "normal": lambda x: (x - mean) / F.sqrt(floor(F.col("_var"))),
        "lognormal": lambda x: (F.log(x) - F.col("_mu")) / F.sqrt(floor(F.col("_sigma2"))),
        "gamma": lambda x: (x - F.col("_alpha") * F.col("_beta")) / F.sqrt(floor(F.col("_alpha") * F.col("_beta") * F.col("_beta"))),
        "minmax": lambda x: (x - F.col("min_val")) / floor(F.col("max_val") - F.col("min_val")),
    }
    z = {name: NormalDist().inv_cdf(p / 100) for name, p in names.items()}

    def score(family: str) -> Column:
        total = sum((F.pow(scaled[family](F.col(name)) - z[name], F.lit(2.0)) for name in names), F.lit(0.0))
        s = F.sqrt(total / len(names))
        return F.when(F.col("min_val") > 0, s) if family in ("lognormal", "gamma") else s

    g = g.select("*", *[score(f).alias(f"{f}_norm_score") for f in FAMILIES])
    spread = F.col("max_val") - F.col("min_val")
    clustered = (spread <= 100) & (F.col("max_val") <= 100) & (F.col("min_val") >= 0) & (F.col("p90") > F.col("min_val") + 0.8 * spread)
    order = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"{f}_norm_score").isNotNull(), F.struct(F.round(f"{f}_norm_score", 9).alias("s"), F.lit(i).alias("i"))) for i, f in enumerate(FAMILIES)])))
    best = F.get(F.array(*map(F.lit, FAMILIES)), order["i"])
    pick = F.when(clustered & (F.col("minmax_norm_score") < 2.0), F.lit("minmax")).when(F.col("min_val") < 0, F.lit("normal")).otherwise(best)
    return g.select(
        *keys, "count", "mean", "std", "min_val", "max_val", "skewness", spread.alias("range"), (F.col("min_val") < 0).alias("has_negatives"), clustered.alias("is_clustered_high"), *names,
        *[f"{f}_norm_score" for f in FAMILIES], pick.alias("recommendation"),
    ).orderBy(F.desc("count"), *keys)
