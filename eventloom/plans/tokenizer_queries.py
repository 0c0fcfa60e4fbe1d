"""Queries of the event tokenizer's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import pick
from eventloom.functions import scalars
from eventloom.operators import bpe, decode, distfit, encode, numeric, score, timeline, training, vocab
from eventloom.sources import events as ev
from eventloom.sources import testdata

KEYS = training.KEYS
STATES = {"state_transitions": {"inpatient": ["admission"], "outpatient": ["discharge"]}, "initial_state": "outpatient"}
WORDS = r"\p{L}+|\p{N}+"
EDGES = [50_000.0, 100_000.0, 150_000.0, 250_000.0, 400_000.0]


def _rows(spark: SparkSession, d: str, **settings) -> DataFrame:
    return timeline.clinical(testdata.demo(spark, d), TokenizerConfig(**settings))


def _ranks(rows: DataFrame) -> DataFrame:
    return numeric.ranked(numeric.histogram(rows, KEYS, F.col("numeric_value")), KEYS)


def _simple(**more) -> TokenizerConfig:
    return TokenizerConfig(text_mode_default="concept", **more)


def _trained(spark: SparkSession, d: str, config: TokenizerConfig, table=testdata.basic_events) -> tuple[DataFrame, training.TokenizerModel]:
    e = table(spark, d)
    return e, training.train(e, config)


def text_mode_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    modes = training.text_modes(rows, TokenizerConfig())
    n = rows.select("class", "text_value").distinct().groupBy("class").agg(F.count("*").alias("n_texts"))
    return n.select("class", "n_texts", F.create_map(*[F.lit(x) for kv in modes.items() for x in kv])[F.col("class")].alias("mode"))


def numeric_group_stats(spark: SparkSession, d: str) -> DataFrame:
    h = numeric.histogram(_rows(spark, d), KEYS, F.col("numeric_value"))
    return h.groupBy(*KEYS).agg(F.count("*").alias("n_distinct"), F.sum("c").alias("n"))


def level_tables(spark: SparkSession, d: str) -> DataFrame:
    t = numeric.levels_by_group(_ranks(_rows(spark, d)), KEYS, 10)
    return t.select(*KEYS, F.posexplode("levels").alias("level", "value"))


def percentile_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = numeric.exact_percentiles(_ranks(_rows(spark, d)), KEYS, {"low": 1.0, "high": 99.0})
    return p.select(*KEYS, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _fits(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    # the added 1e-9 keeps ties of the rounding from depending on the last bit of a sum
    return numeric.moments(_ranks(_rows(spark, d)), KEYS, 1.0, 99.0).select(*KEYS, *[(F.round(F.col(n) + 1e-9, 6) + 0.0).alias(n) for n in names])


def normal_params(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, ["mean", "var"])


def lognormal_params(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, ["mu", "sigma2"])


def gamma_params(spark: SparkSession, d: str) -> DataFrame:
    f = numeric.moments(_ranks(testdata.orders(spark, d)), KEYS, 1.0, 99.0)
    return f.select(*KEYS, *[F.round(F.col(n) + 1e-9, 4).alias(n) for n in ("alpha", "beta")])


def minmax_params(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d, ["vmin", "vmax"])


def scaled_values(spark: SparkSession, d: str) -> DataFrame:
    e = testdata.orders(spark, d)
    f = numeric.moments(_ranks(e), KEYS, 1.0, 99.0)
    names = ("mean", "var", "mu", "sigma2", "alpha", "beta", "vmin", "vmax", "low", "high")
    p = lambda dist: F.struct(F.lit(dist).alias("distribution"), *[F.col(n) for n in names])
    j = e.join(f, KEYS)
    return j.select("_src", *[F.round(scalars.scale(F.col("numeric_value"), p(x)), 6).alias(x) for x in ("normal", "lognormal", "gamma", "minmax")])


def unscaled_values(spark: SparkSession, d: str) -> DataFrame:
    e = testdata.orders(spark, d)
    f = numeric.moments(_ranks(e), KEYS, 0.0, 100.0)
    names = ("mean", "var", "mu", "sigma2", "alpha", "beta", "vmin", "vmax", "low", "high")
    p = lambda dist: F.struct(F.lit(dist).alias("distribution"), *[F.col(n) for n in names])
    j = e.join(f, KEYS)
    return j.select("_src", *[F.round(scalars.unscale(scalars.scale(F.col("numeric_value"), p(x)), p(x)), 2).alias(x) for x in ("normal", "lognormal", "gamma", "minmax")])


def digitized(spark: SparkSession, d: str) -> DataFrame:
    edges = F.array(*map(F.lit, EDGES))
    q = scalars.digitize(F.col("numeric_value"), edges)
    return testdata.orders(spark, d).select("_src", q.alias("bin"), scalars.bin_midpoint(edges, q).alias("midpoint"), scalars.bin_width(edges, q).alias("width"), scalars.level_index(F.col("numeric_value"), edges).alias("level"))


def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    e = numeric.edges_by_group(_ranks(testdata.orders(spark, d)), KEYS, TokenizerConfig())
    return e.select(*KEYS, F.posexplode("edges").alias("i", "edge")).withColumn("edge", F.round("edge", 6))


def adaptive_edges(spark: SparkSession, d: str) -> DataFrame:
    e = numeric.edges_by_group(_ranks(_rows(spark, d)), KEYS, TokenizerConfig())
    return e.select(*KEYS, F.posexplode("edges").alias("i", "edge"))


def distribution_advice(spark: SparkSession, d: str) -> DataFrame:
    return distfit.recommend(_rows(spark, d), KEYS)


def advice_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores behind the advice; -1 stands for none."""
    a = distfit.recommend(_rows(spark, d), KEYS)
    scores = [F.coalesce(F.round(F.col(f"{f}_norm_score") + 1e-9, 4), F.lit(-1.0)).alias(f) for f in distfit.FAMILIES]
    return a.select(*KEYS, "count", (F.round(F.col("mean") + 1e-9, 5) + 0.0).alias("mean"), F.col("p50"), F.col("p99_9"), *scores, "is_clustered_high", "recommendation")


def time_deltas(spark: SparkSession, d: str) -> DataFrame:
    return timeline.whole_second_gaps(testdata.demo(spark, d), TokenizerConfig()).select("id", "gap_s")


def band_counts(spark: SparkSession, d: str) -> DataFrame:
    g = timeline.whole_second_gaps(testdata.demo(spark, d), TokenizerConfig(time_scales=[3600, 86_400, 604_800]))
    return g.groupBy("band").agg(F.count("*").alias("n"))


def _timeline(spark: SparkSession, d: str, kind: str = "none") -> DataFrame:
    c = TokenizerConfig(milestone_per_state={"inpatient": kind, "outpatient": kind}, **STATES)
    e = testdata.demo(spark, d)
    return timeline.timeline(e, c, timeline.birth_dates(e, c))


def state_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).filter("not _birth").select("_src", F.col("_state").alias("state"), F.coalesce(F.floor(F.col("_dt_us") / 1000), F.lit(-1)).alias("dt_ms"))


def age_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).filter("_age is not null").select("_src", F.col("_age").alias("age"))


def sos_eos_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).filter("_sos or _eos").select("_src", F.col("_sos").alias("starts"), F.col("_eos").alias("ends"))


def _milestones(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _timeline(spark, d, kind).filter("_ms is not null").select("_src", F.col("_ms").alias("token"))

    query.__name__ = f"milestones_{kind}"
    return query


def concept_split_delim(spark: SparkSession, d: str) -> DataFrame:
    c = TokenizerConfig(concept_splitters={"line": "//"})
    return testdata.lines(spark, d).select("_src", F.posexplode(scalars.split_text(F.col("class"), F.col("text_value"), c)).alias("i", "piece"))


def concept_split_width(spark: SparkSession, d: str) -> DataFrame:
    c = TokenizerConfig(concept_splitters={x: (1, 1, None) for x in "FOP"})
    return testdata.orders(spark, d).select("_src", F.posexplode(scalars.split_text(F.col("class"), F.col("text_value"), c)).alias("i", "piece"))


def class_fusion_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = TokenizerConfig(concept_splitters={"line": "//"}, fuse_class_to_concept=True, namespace_concepts_by_class=True)
    pieces = scalars.split_text(F.col("class"), F.col("text_value"), c)
    return testdata.lines(spark, d).select("_src", F.array_join(scalars.name_pieces(F.col("class"), pieces, c), " ").alias("tokens"), scalars.join_pieces(F.col("class"), pieces, c).alias("joined"))


def vocab_special(spark: SparkSession, d: str) -> DataFrame:
    rows = [(r[0], i, r[1]) for i, r in enumerate(vocab.special_tokens(TokenizerConfig(time_scales=[60, 3600])))]
    return spark.createDataFrame(rows, "token string, token_id long, type string")


def encode_tokens_factored(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple())
    return encode.encode(e, m).select("id", "row_no", "pos", "token", "token_id")


def encode_tokens_fused(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple(num_seq="fused"))
    return encode.encode(e, m).select("id", "row_no", "pos", "token", "token_id")


def vocab_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole vocabulary of a model with fused numbers."""
    return _trained(spark, d, _simple(num_seq="fused"))[1].vocab.select("token", "token_id", "type")


def _continuous() -> TokenizerConfig:
    return _simple(num_type="continuous", distributions={"normal": ["event"]})


def encode_continuous(spark: SparkSession, d: str) -> DataFrame:
    """Scaled values: normal for numbers, lognormal for time differences; -99 stands for none."""
    e, m = _trained(spark, d, _continuous())
    return encode.encode(e, m).select("id", "pos", "token", "token_id", F.coalesce(F.round("val", 5) + 0.0, F.lit(-99.0)).alias("val"))


def decode_values(spark: SparkSession, d: str) -> DataFrame:
    """Times, as milliseconds since the reference time, and numbers that come back from bins."""
    e, m = _trained(spark, d, _simple())
    back = decode.decode(encode.encode(e, m), m)
    ms = F.round(F.unix_micros(F.col("time").cast("timestamp")) / 1000).cast("long")
    return back.select("id", F.row_number().over(Window.partitionBy("id").orderBy("_src")).alias("k"), "class", "text_value", F.round("numeric_value", 6).alias("numeric_value"), ms.alias("ms"))


def density_widths(spark: SparkSession, d: str) -> DataFrame:
    """The bits that turn probabilities of bins into densities."""
    e, m = _trained(spark, d, _simple())
    s = encode.encode(e, m).drop("token").withColumn("bits", F.lit(1.0))
    return score.adjusted(s, m).filter("group in ('time', 'numeric') and type = 'Q'").groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("adjustment"), 3).alias("bits"))


def density_slopes(spark: SparkSession, d: str) -> DataFrame:
    """The same for scaled values."""
    e, m = _trained(spark, d, _continuous())
    s = encode.encode(e, m).drop("token").withColumn("bits", F.lit(1.0))
    return score.adjusted(s, m).filter("type = 'num_marker'").groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("adjustment"), 3).alias("bits"))


def encode_token_counts(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple())
    return encode.encode(e, m).groupBy("token").agg(F.count("*").alias("n"))


def encode_demo(spark: SparkSession, d: str) -> DataFrame:
    """All of it: bands, states, milestones, ages, byte pairs for classes with many texts."""
    c = TokenizerConfig(time_scales=[3600, 86_400], milestone_per_state={"inpatient": "8hr", "outpatient": "week"}, text_mode_threshold=2000, **STATES)
    e, m = _trained(spark, d, c, testdata.demo)
    return encode.encode(e, m)


def encode_structure(spark: SparkSession, d: str) -> DataFrame:
    """What encode_demo does but for byte pairs, in order within each id; bins and levels left out."""
    c = _simple(time_scales=[3600, 86_400], milestone_per_state={"inpatient": "8hr", "outpatient": "week"}, **STATES)
    e, m = _trained(spark, d, c, testdata.demo)
    s = encode.encode(e, m).filter(~F.col("token").rlike(r"^<\|[QL][0-9]+\|>$"))
    return s.select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("k"), "row_no", "token")


def encode_debug(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple(num_type="continuous", num_seq="fused"))
    return encode.debug(e, m).select("_src", F.array_join("tokens", " ").alias("tokens"))


def sequence_lengths(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple())
    return encode.sequences(encode.encode(e, m)).select("id", F.size("ids").cast("long").alias("n"), F.size(F.filter("row_nos", lambda r: r < 0)).cast("long").alias("n_edges"))


def train_pairs(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple())
    p = encode.training_pairs(encode.sequences(encode.encode(e, m)))
    return p.select("id", F.size("x").cast("long").alias("n_x"), F.size("y").cast("long").alias("n_y"))


def row_idx_map(spark: SparkSession, d: str) -> DataFrame:
    return encode.global_row_index(testdata.demo(spark, d))


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple(), testdata.demo)
    back = decode.decode(encode.encode(e, m), m)
    return back.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("_src"))).alias("k"), "class", "text_value")


def decode_levels(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of groups with few values survive encoding."""
    e, m = _trained(spark, d, _simple(level_threshold=60), testdata.lines)
    back = decode.decode(encode.encode(e, m), m)
    return back.groupBy("id", "text_value", "numeric_value").agg(F.count("*").alias("n"))


def token_type_counts(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple(num_seq="fused"))
    return decode.token_types(encode.encode(e, m), m).groupBy("type").agg(F.count("*").alias("n"))


def numeric_contexts(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple())
    c = decode.numeric_context(encode.encode(e, m).drop("token"), m)
    return c.groupBy("type", "ctx_kind", "ctx_type").agg(F.count("*").alias("n"))


def bpr_groups(spark: SparkSession, d: str) -> DataFrame:
    """Bits per row of a model that gives each token of a sequence 1 to 7 bits in turn."""
    e, m = _trained(spark, d, _simple())
    s = encode.encode(e, m).drop("token").withColumn("bits", (F.pmod("pos", F.lit(7)) + 1).cast("double"))
    r = score.bits_per_row(s, m)
    return r.select(*[F.round(c, 6).alias(c) for c in ("bpr_raw", "eos_bpr", "class_bpr", "text_bpr", "tokens_per_row")], "n_rows", "tail_mode")


def density_bits(spark: SparkSession, d: str) -> DataFrame:
    e, m = _trained(spark, d, _simple(num_type="continuous"))
    s = encode.encode(e, m).drop("token").withColumn("bits", F.lit(1.0)).withColumn("v_bits", F.lit(2.0)).withColumn("loc", F.lit(0.0)).withColumn("scale", F.lit(1.0))
    return score.adjusted(s, m, "censored").groupBy("group").agg(F.count("*").alias("n"), F.sum("adjustment").alias("bits"))


def meds_split(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/meds.parquet")
    e = ev.from_meds(m)
    return e.groupBy("id", "class", "text_value").agg(F.count("*").alias("n"))


def bpe_chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    """How many bytes the chunks of the default pattern have in all: it leaves nothing out."""
    c = bpe.chunk_counts(pick(spark.read.parquet(f"{d}/documents.parquet"), "text"), "text")
    return c.agg(F.sum(F.octet_length("chunk") * F.col("n")).alias("bytes"), F.max(F.length(F.regexp_extract("chunk", r"^\p{N}+$", 0))).cast("long").alias("longest_number"))


def bpe_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.chunk_counts(pick(spark.read.parquet(f"{d}/documents.parquet"), "text"), "text", WORDS)


def bpe_byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe_chunk_counts(spark, d))


def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    m = bpe.train_merges(spark.read.parquet(f"{d}/documents.parquet"), 1024)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(m)], "rank long, left int, right int")


def bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Byte-pair ids of each text, and the bytes of the ids put together again."""
    docs = pick(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    pattern = r"\s+|\S+"
    m = bpe.train_merges(docs, 512, "text", pattern)
    table = F.array(*[F.lit(b) for b in map(bytearray, bpe.token_bytes(m))])
    e = docs.select("doc_id", bpe.encoder(m, pattern)("text").alias("ids"))
    return e.select("doc_id", bpe.decode_bytes(F.transform("ids", lambda i: F.get(table, i))).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        text_mode_stats, numeric_group_stats, level_tables, percentile_bounds, normal_params, lognormal_params, gamma_params, minmax_params, scaled_values, unscaled_values, digitized, quantile_edges,
        adaptive_edges, distribution_advice, advice_scores, time_deltas, band_counts, state_timeline, age_tokens, sos_eos_boundaries, *[_milestones(k) for k in ("week", "month", "daily", "12hr", "8hr")],
        concept_split_delim, concept_split_width, class_fusion_tokens, vocab_special, encode_tokens_factored, encode_tokens_fused, vocab_full, encode_continuous, decode_values, density_widths, density_slopes, encode_token_counts, encode_demo, encode_structure, encode_debug, sequence_lengths,
        train_pairs, row_idx_map, decode_roundtrip, decode_levels, token_type_counts, numeric_contexts, bpr_groups, density_bits, meds_split, bpe_chunk_bytes, bpe_chunk_counts, bpe_byte_pairs, bpe_merges, bpe_roundtrip,
    ]
    return {f.__name__: f for f in found}
