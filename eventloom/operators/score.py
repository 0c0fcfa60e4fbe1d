"""Bits per row of a model's predictions, comparable between representations of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import LN2, bin_width, is_edge_bin, log_ndtr, log_slope, scale
from eventloom.operators.decode import numeric_context
from eventloom.operators.training import TokenizerModel
from eventloom.operators.vocab import ROW_STARTS

# The group of the report in which each type of token counts. Those of bins and
# continuous markers depend on whether they belong to a time difference.
GROUPS = {
    "sos": "mask", "pad": "mask", "row": "mask", "eos": "eos", "time_delta": "time", "time_delta_fused": "time", "milestone": "milestone", "age": "age",
    "class": "class", "concept": "text", "bpe": "text", "class_concept": "text", "L": "level", "fused_concept_Q": "fused", "fused_concept_L": "fused",
    "class_concept_Q": "fused", "class_concept_L": "fused",
}
REPORTED = ("eos", "time", "milestone", "age", "class", "text", "numeric", "level", "fused")
# The types of tokens that stand for a bin, and those that carry a scaled value.
BINNED = ("Q", "time_delta_fused", "fused_concept_Q", "class_concept_Q")
CONTINUOUS = ("num_marker", "time_delta", "concept", "class_concept")


def group_of(kind: Column, ctx_kind: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[kind]
    either = F.when(ctx_kind == "time", F.lit("time")).otherwise(F.lit("numeric"))
    return F.when(kind.isin("Q", "num_marker"), either).otherwise(F.coalesce(by, F.lit("text")))


def adjusted(bits: DataFrame, model: TokenizerModel, tail_mode: str = "width", key: str = "id") -> DataFrame:
    """Predictions with ``group``, ``starts_row`` and ``adjustment``, the bits that turn a
    probability of a bin or of a scaled value into a density of the number itself.

    ``bits`` has ``key, pos, token_id, val, bits`` and, of a continuous model, ``v_bits, loc,
    scale``. Bins add log2 of their width, continuous values subtract log2 of the slope of their
    scaling. ``tail_mode``: ``width`` gives open bins their neighbour's width; ``censored`` counts
    tails as probability: open bins are not adjusted, and a value at or beyond a clip threshold has
    the bits of the predicted normal tail instead of its own. Other modes raise ValueError.
    """
    if tail_mode not in ("width", "censored"):
        raise ValueError(f"tail_mode must be 'width' or 'censored', not {tail_mode!r}")
    s = numeric_context(bits, model, key)
    z = F.when(~F.isnan("val"), F.col("val"))
    binned = F.col("type").isin(*BINNED) & F.col("ctx_edges").isNotNull() & F.col("qual_index").isNotNull()
    open_bin = is_edge_bin(F.col("ctx_edges"), F.col("qual_index"))
    width = F.log2(bin_width(F.col("ctx_edges"), F.col("qual_index")))
    if tail_mode == "censored":
        width = F.when(open_bin, F.lit(0.0)).otherwise(width)
    continuous = F.col("type").isin(*CONTINUOUS) & (F.col("ctx_type") == "scaling") & (z.isNotNull() | (F.col("type") == "num_marker"))
    slope = -log_slope(F.col("ctx_p"), z) / LN2
    if tail_mode == "censored" and {"v_bits", "loc", "scale"} <= set(bits.columns):
        p = F.col("ctx_p")
        low, high = scale(p["low"], p, False), scale(p["high"], p, False)
        near = lambda c: F.lit(1e-5) * F.greatest(F.lit(1.0), F.abs(c))
        known = z.isNotNull() & p["low"].isNotNull() & p["high"].isNotNull() & F.col("loc").isNotNull() & F.col("scale").isNotNull()
        below, above = known & (z <= low + near(low)), known & (z >= high - near(high))
        beyond = F.when(below, (low - F.col("loc")) / F.col("scale")).when(above, (F.col("loc") - high) / F.col("scale"))
        s = s.withColumn("_tail", F.when(continuous, beyond)).withColumn("_tail", -log_ndtr(F.col("_tail")) / LN2)
        slope = F.when((below | above) & F.col("_tail").isNotNull() & ~F.isnan("_tail"), F.col("_tail") - F.col("v_bits")).otherwise(slope)
    out = s.withColumn("adjustment", F.when(binned, width).when(continuous, slope).otherwise(F.lit(0.0)))
    return out.select(*bits.columns, "type", "ctx_kind", group_of(F.col("type"), F.col("ctx_kind")).alias("group"), F.col("type").isin(*ROW_STARTS).alias("starts_row"), "adjustment")


def bits_per_row(bits: DataFrame, model: TokenizerModel, tail_mode: str = "width", key: str = "id", n_batches: int | None = None, batch_size: int = 1) -> DataFrame:
    """One row: ``bpr, bpr_raw``, the bits per row of each group, ``n_rows, tokens_per_row,
    tail_mode``. Start, padding and row tokens do not count; without rows the divisor is 1. ``n_batches`` scores the sequences of the first n_batches * batch_size keys
    only."""
    if n_batches is not None:
        some = bits.select(F.col(key).alias("_some")).distinct().orderBy("_some").limit(n_batches * batch_size)
        bits = bits.join(some, F.col(key).eqNullSafe(F.col("_some")), "left_semi")
    a = adjusted(bits, model, tail_mode, key).filter(F.col("group") != "mask").withColumn("_b", F.col("bits") + F.col("adjustment"))
    rows = F.greatest(F.sum(F.col("starts_row").cast("long")), F.lit(1))
    per = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / rows
    return a.agg(
        per(F.col("_b")).alias("bpr"), per(F.col("bits")).alias("bpr_raw"), *[per(F.when(F.col("group") == g, F.col("_b"))).alias(f"{g}_bpr") for g in REPORTED],
        F.coalesce(F.sum(F.col("starts_row").cast("long")), F.lit(0)).alias("n_rows"), (F.count("*") / F.coalesce(rows, F.lit(1))).alias("tokens_per_row"), F.lit(tail_mode).alias("tail_mode"),
    )
