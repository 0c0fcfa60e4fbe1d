"""Learning a tokenizer from an event table, and the model that comes out."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import cut
from eventloom.operators import bpe, distfit, numeric, timeline, vocab
from eventloom.operators.running import hot_ids
from eventloom.sources.events import canonical, require_events

KEYS = ["class", "text_value"]
#: Classes of an event table at most; their modes come to the driver.
MOST_CLASSES = 100_000


@dataclass(frozen=True)
class TokenizerModel:
    """What was learned. Tables are DataFrames; only what has the size of a list of classes or of
    byte-pair merges is held by the driver.

    ``modes``: text mode by class. ``numeric``: ``class, text_value, type, levels, edges, p`` by
    group, p a struct of distribution parameters. ``gaps``: ``band, type, edges, p`` by time band.
    ``vocab``: tokens. ``births``: ``id, birth``. ``merges``: byte pairs, empty without bpe texts.
    """

    config: TokenizerConfig
    modes: dict[str, str]
    numeric: DataFrame
    gaps: DataFrame
    vocab: DataFrame
    births: DataFrame | None
    merges: list[tuple[int, int]] = field(default_factory=list)
    uses_bpe: bool = False

    @property
    def base(self) -> int:
        """The first id that is no byte-pair id."""
        return 256 + len(self.merges) if self.uses_bpe else 0

    def mode(self, cls: Column, text: Column) -> Column:
        """The text mode of a row: that of its pair, of its class, or concept."""
        out = F.lit("concept")
        by = [x for kv in sorted(self.modes.items()) for x in kv]
        if by:
            out = F.coalesce(F.create_map(*map(F.lit, by))[cls], out)
        for (c, t), m in self.config.pair_overrides().items():
            out = F.when((cls == c) & (text == t), F.lit(m)).otherwise(out)
        return out


def text_modes(clinical: DataFrame, config: TokenizerConfig) -> dict[str, str]:
    """The text mode of each class: its override, else concept if it has a splitter, else the
    default, else by the number of distinct texts (null counts as one)."""
    rows = clinical.select("class", "text_value").distinct().groupBy("class").count().limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    own = config.class_overrides()

    def of(cls: str, n: int) -> str:
        if cls in own:
            return own[cls]
        if cls in config.splitters:
            return "concept"
        if config.text_mode_default != "auto":
            return config.text_mode_default
        return "bpe" if n > config.text_mode_threshold else "concept"

    return {r["class"]: of(r["class"], r["count"]) for r in rows if r["class"] is not None}


def _struct(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.strip().split() for x in numeric.PARAMS.split(","))])


def numeric_params(clinical: DataFrame, config: TokenizerConfig) -> DataFrame:
    """``class, text_value, type, levels, edges, p`` for each group with numbers: ``level`` for at
    most level_threshold distinct ones, else ``bins`` or ``scaling``."""
    ranks = numeric.ranked(numeric.histogram(clinical, KEYS, F.col("numeric_value")), KEYS)
    none = lambda t: F.lit(None).cast(t)
    levels = numeric.levels_by_group(ranks, KEYS, config.level_threshold)
    levels = levels.select(*KEYS, F.lit("level").alias("type"), "levels", none("array<double>").alias("edges"), _struct().alias("p"))
    many = ranks.filter(F.col("n_distinct") > config.level_threshold)
    if config.num_type == "discrete":
        rest = numeric.edges_by_group(many, KEYS, config)
        rest = rest.select(*KEYS, F.lit("bins").alias("type"), none("array<double>").alias("levels"), "edges", _struct(low=F.col("low"), high=F.col("high")).alias("p"))
    else:
        fits = numeric.moments(many, KEYS, config.continuous_clip_min, config.continuous_clip_max)
        key = lambda c, t: F.concat(c, F.lit("||"), F.coalesce(t, F.lit("")))
        advice = distfit.recommend(clinical.select(key(F.col("class"), F.col("text_value")).alias("_key"), "numeric_value"), ["_key"], clip=(config.continuous_clip_min, config.continuous_clip_max))
        j = fits.withColumn("_key", key(F.col("class"), F.col("text_value"))).join(advice.select("_key", "recommendation"), "_key", "left")
        wanted = F.coalesce("recommendation", F.lit("normal"))
        for name, classes in reversed(list((config.distributions or {}).items())):
            wanted = F.when(F.col("class").isin(*classes), F.lit(name)).otherwise(wanted)
        dist = F.when((F.col("vmin") < 0) & wanted.isin("lognormal", "gamma"), F.lit("normal")).otherwise(wanted)
        fit = {n: F.when(F.isnan(n) | F.col(n).isNull(), 1.0).otherwise(F.col(n)) for n in ("mean", "var", "mu", "sigma2", "alpha", "beta", "vmin", "vmax")}
        rest = j.select(*KEYS, F.lit("scaling").alias("type"), none("array<double>").alias("levels"), none("array<double>").alias("edges"), _struct(distribution=dist, low=F.col("low"), high=F.col("high"), **fit).alias("p"))
    return levels.unionByName(rest)


def gap_params(events: DataFrame, config: TokenizerConfig, hot: DataFrame | None = None) -> DataFrame:
    """``band, type, edges, p`` for each time band. A band with at most one difference takes the
    parameters of all differences; without any there are no rows."""
    gaps = timeline.whole_second_gaps(events, config, hot)
    bands = F.array(*map(F.lit, config.bands))
    both = gaps.select(F.explode(F.array(F.get(bands, F.col("band")), F.lit(None).cast("string"))).alias("band"), F.col("gap_s").cast("double").alias("v"))
    ranks = numeric.ranked(both.groupBy("band", "v").agg(F.count("*").alias("c")), ["band"])
    if config.num_type == "discrete":
        n = ranks.groupBy("band").agg(F.max("n").alias("n")).withColumnRenamed("band", "_b")
        fit = numeric.edges_by_group(ranks, ["band"], config)
        fit = fit.join(n, F.col("band").eqNullSafe(F.col("_b"))).select("band", "n", F.lit("bins").alias("type"), "edges", _struct(low=F.col("low"), high=F.col("high")).alias("p"))
    else:
        fit = numeric.moments(ranks, ["band"], config.continuous_clip_min, config.continuous_clip_max)
        given = {n: F.col(n) for n in ("low", "high", "mean", "var", "mu", "sigma2", "alpha", "beta", "vmin", "vmax")}
        fit = fit.select("band", "n", F.lit("scaling").alias("type"), F.lit(None).cast("array<double>").alias("edges"), _struct(distribution=F.lit("lognormal"), **given).alias("p"))
    every = fit.filter("band is null").select(F.explode(bands).alias("band"), "type", "edges", "p")
    own = fit.filter("band is not null and n > 1")
    return every.alias("e").join(own.alias("o"), "band", "left").select("band", *[F.coalesce(f"o.{c}", f"e.{c}").alias(c) for c in ("type", "edges", "p")])


def train(events: DataFrame, config: TokenizerConfig | None = None) -> TokenizerModel:
    """Learns a tokenizer. The event table needs ``id, time, class, text_value, numeric_value``;
    ``_src`` orders rows of one time. The result doesn't change afterwards: training again gives
    a new model."""
    config = config or TokenizerConfig()
    require_events(events)
    e = canonical(events)
    spark = events.sparkSession
    rows = timeline.clinical(e, config)
    modes = text_modes(rows, config)
    pair_modes = config.pair_overrides()
    uses_bpe = "bpe" in modes.values() or "bpe" in pair_modes.values()
    if config.num_seq == "fused" and "bpe" in modes.values():
        named = sorted(c for c, m in modes.items() if m == "bpe")
        warnings.warn(f"num_seq='fused': numbers of classes with bpe texts ({', '.join(named[:5])}) get tokens of their own", stacklevel=2)
    numbers = cut(numeric_params(rows, config))
    gaps = cut(gap_params(e, config, hot_ids(rows)))
    if gaps.isEmpty():
        warnings.warn("no positive time difference: no time tokens", stacklevel=2)
    births = cut(timeline.birth_dates(e, config))
    partial = TokenizerModel(config, modes, numbers, gaps, spark.range(0).toDF("none"), births, [], uses_bpe)
    pairs = rows.select(*KEYS).distinct().filter("class is not null").withColumn("mode", partial.mode(F.col("class"), F.col("text_value")))
    words = vocab.build(spark, pairs, numbers, config)
    merges: list[tuple[int, int]] = []
    if uses_bpe:
        words = cut(words)
        size = max(config.final_vocab_size - words.count(), 256)
        texts = rows.filter(F.col("text_value").isNotNull() & (partial.mode(F.col("class"), F.col("text_value")) == "bpe"))
        merges = bpe.train_merges(texts, size, "text_value", config.split_pattern, sample=config.bpe_training_sample, seed=config.bpe_training_seed)
        words = words.withColumn("token_id", F.col("token_id") + 256 + len(merges))
    return TokenizerModel(config, modes, numbers, gaps, cut(words), births, merges, uses_bpe)
