"""Token streams back to event tables; kinds and number contexts of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalars import bin_midpoint, join_pieces, unscale
from eventloom.operators import bpe
from eventloom.operators.running import running, with_place_blocks
from eventloom.operators.training import KEYS, TokenizerModel
from eventloom.operators.vocab import ROW_STARTS

TEXT_TYPES = ("concept", "bpe", "class_concept", "class_concept_Q", "class_concept_L", "fused_concept_Q", "fused_concept_L")


def classified(stream: DataFrame, model: TokenizerModel) -> DataFrame:
    """A stream (any columns with ``token_id``) with the vocabulary's ``token, type, class, piece,
    starts_row, qual, qual_index, band``; an id that the vocabulary lacks is ``bpe``."""
    v = model.vocab.select(F.col("token_id").alias("_id"), *[F.col(c).alias(f"_v_{c}") for c in ("token", "type", "class", "piece", "starts_row", "qual", "qual_index", "band")])
    names = [c for c in stream.columns if c not in ("token", "type", "class", "piece", "starts_row", "qual", "qual_index", "band")]
    s = stream.select(*names).join(v, F.col("token_id") == F.col("_id"), "left").drop("_id")
    s = s.withColumn("_v_type", F.coalesce("_v_type", F.lit("bpe"))).withColumn("_v_starts_row", F.coalesce("_v_starts_row", F.lit(False)))
    return s.withColumnsRenamed({c: c[3:] for c in s.columns if c.startswith("_v_")})


def token_types(stream: DataFrame, model: TokenizerModel) -> DataFrame:
    """The stream with ``type``."""
    return classified(stream, model).select(*[c for c in stream.columns if c != "type"], "type")


def _byte_table(stream: DataFrame, model: TokenizerModel) -> DataFrame:
    """Adds ``_bytes``, the bytes of byte-pair ids; null for others."""
    if not model.uses_bpe:
        return stream.withColumn("_bytes", F.lit(None).cast("binary"))
    table = stream.sparkSession.createDataFrame(list(enumerate(map(bytearray, bpe.token_bytes(model.merges)))), "_id long, _bytes binary")
    # as many rows as the model has byte-pair tokens
    return stream.join(F.broadcast(table), F.col("token_id") == F.col("_id"), "left").drop("_id")


def token_strings(stream: DataFrame, model: TokenizerModel) -> DataFrame:
    """The stream with ``token``: from the vocabulary, else the text of a byte-pair id, else
    <UNK:id>."""
    s = _byte_table(classified(stream, model), model)
    return s.select(*[c for c in stream.columns if c != "token"], F.coalesce("token", F.decode("_bytes", "UTF-8"), F.concat(F.lit("<UNK:"), F.col("token_id").cast("string"), F.lit(">"))).alias("token"))


def _walk(stream: DataFrame, model: TokenizerModel, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Adds what a token belongs to: ``_who`` (number of the entity in the stream), ``_row`` (number
    of the row, also of what follows an end), ``_in`` (whether it lies in a row), ``_gap`` (the
    band of a time difference that this token completes) and ``_z`` (its value, null if missing)."""
    s = classified(stream, model).withColumn("_z", F.when(~F.isnan("val"), F.col("val")))
    s = with_place_blocks(s, hot, key)
    ends = F.col("type").isin("sos", "eos", "pad")
    starts = F.col("type").isin(*ROW_STARTS)
    waits = F.when((F.col("type") == "time_delta") & F.col("_z").isNull(), F.col("band")).when(F.col("type").isin("Q", "num_marker", "class", *ROW_STARTS) | ends, F.lit(""))
    so_far = {"_who": ("sum", (F.col("type") == "sos").cast("int")), "_row": ("sum", (starts | ends).cast("int")), "_in": ("last", F.when(starts | ends, starts))}
    s = running(running(s, [key], ["pos"], so_far, inclusive=True), [key], ["pos"], {"_waiting": ("last", waits)}, inclusive=False)
    done = F.when(F.col("type").isin("Q", "num_marker") & (F.col("_waiting") != ""), F.col("_waiting"))
    return s.withColumn("_gap", F.when(F.col("type") == "time_delta_fused", F.col("band")).when((F.col("type") == "time_delta") & F.col("_z").isNotNull(), F.col("band")).otherwise(done))


def decode(stream: DataFrame, model: TokenizerModel, key: str = "id", reference_time: str = "1970-01-01 00:00:00", first_id: int | None = None, compat_times: bool = False, hot: DataFrame | None = None) -> DataFrame:
    """The event table of token streams: ``id, time, class, text_value, numeric_value`` and
    ``_src``, the row's place in its stream. ``stream`` has ``key, pos, token_id, val``.

    The k-th start token of a stream opens an entity. With ``first_id`` it is numbered first_id +
    k - 1, as for one flat stream; without, rows keep the stream's key. Time starts at
    ``reference_time`` for each entity and moves on by the decoded differences; a row has the time
    at which its class token stands. (``compat_times``: the time at which the row ends, after the
    difference that belongs to the next row.) Bins give the middle of their edges; birth rows, ages
    and milestones do not come back. An empty stream gives an empty table.

    ``hot`` (``running.hot_ids(stream, key)`` of a stored stream) holds the keys whose streams go in
    blocks of places, with the same results.
    """
    c = model.config
    s = _byte_table(_walk(stream, model, key, hot), model)
    gaps = model.gaps.select(F.col("band").alias("_b"), F.col("type").alias("_gt"), F.col("edges").alias("_ge"), F.col("p").alias("_gp"))
    s = s.join(F.broadcast(gaps), F.col("_gap") == F.col("_b"), "left")
    seconds = F.when(F.col("_gt") == "bins", bin_midpoint(F.col("_ge"), F.col("qual_index"))).when((F.col("_gt") == "scaling") & F.col("_z").isNotNull(), F.greatest(unscale(F.col("_z"), F.col("_gp")), F.lit(0.0)))
    s = s.withColumn("_dt", F.coalesce(seconds, F.lit(0.0)))
    s = running(s, [key, "_who"], ["pos"], {"_t": ("sum", F.col("_dt"))}, inclusive=True)
    own = F.col("_gap").isNull()
    text = F.col("type").isin(*TEXT_TYPES)
    piece = F.when(text, F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece"), F.col("_bytes").alias("bytes"), (F.col("type") == "bpe").alias("is_bpe")))
    last = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("pos")))
    is_level = F.col("qual") == "L"
    g = s.filter("_in").groupBy(key, "_who", "_row").agg(
        F.min("pos").alias("_src"), F.min_by("class", "pos").alias("class"), (F.max("_t") if compat_times else F.min_by("_t", "pos")).alias("_t"),
        F.array_sort(F.collect_list(piece)).alias("_p"), last(own & (F.col("qual") == "Q") & ~F.col("type").isin("time_delta_fused"), F.col("qual_index")).alias("_q"),
        last(own & is_level, F.col("qual_index")).alias("_l"), last(own & (F.col("type") == "num_marker"), F.col("_z")).alias("_num"), last(text, F.col("_z")).alias("_on_text"),
    )
    merged = F.exists("_p", lambda p: p["is_bpe"])
    whole = F.when(merged, bpe.decode_bytes(F.transform("_p", lambda p: p["bytes"]))).otherwise(join_pieces(F.col("class"), F.transform("_p", lambda p: p["piece"]), c))
    g = g.withColumn("text_value", whole)
    n = model.numeric.select(*[F.col(k).alias(f"_n_{k}") for k in KEYS], "levels", "edges", "p", F.col("type").alias("_nt"))
    g = g.join(n, F.col("class").eqNullSafe(F.col("_n_class")) & F.col("text_value").eqNullSafe(F.col("_n_text_value")), "left")
    level = F.get("levels", F.greatest(F.lit(0), F.least(F.col("_l"), F.size("levels") - 1)))
    number = F.coalesce(
        F.when(F.col("_q").isNotNull() & (F.col("_nt") == "bins"), bin_midpoint(F.col("edges"), F.col("_q"))), F.when(F.col("_l").isNotNull() & (F.col("_nt") == "level"), level),
        F.when((F.col("_nt") == "scaling") & F.col("_num").isNotNull(), unscale(F.col("_num"), F.col("p"))), F.when((F.col("_nt") == "scaling") & F.col("_on_text").isNotNull(), unscale(F.col("_on_text"), F.col("p"))),
    )
    who = F.col(key) if first_id is None else (F.col("_who") + (first_id - 1)).cast("long")
    # microseconds added to a timestamp without time zone
    time = F.timestamp_add("MICROSECOND", F.round(F.col("_t") * 1e6).cast("long"), F.expr(f"timestamp_ntz '{reference_time}'"))
    return g.select(who.alias("id"), time.alias("time"), "class", "text_value", number.alias("numeric_value"), "_src")


def numeric_context(stream: DataFrame, model: TokenizerModel, key: str = "id") -> DataFrame:
    """The stream with ``token, type, qual_index`` and the parameters that apply at each place:
    ``ctx_kind`` (time, row or null), ``ctx_type, ctx_levels, ctx_edges, ctx_p``.

    Time tokens have those of their band; tokens of numbers those of the row's class and the text
    so far; text tokens those of the text so far if it names a group of scaled numbers.
    """
    s = _byte_table(_walk(stream, model, key), model)
    in_row = Window.partitionBy(key, "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("type").isin(*TEXT_TYPES)
    s = s.select("*", F.first("class", ignorenulls=True).over(in_row).alias("_cls"), F.collect_list(F.when(text, F.struct(F.coalesce("piece", F.lit("")).alias("piece"), F.col("_bytes").alias("bytes")))).over(in_row).alias("_p"))
    merged = F.exists("_p", lambda p: p["bytes"].isNotNull())
    so_far = F.when(merged, bpe.decode_bytes(F.transform("_p", lambda p: p["bytes"]))).otherwise(join_pieces(F.col("_cls"), F.transform("_p", lambda p: p["piece"]), model.config))
    s = s.withColumn("_text", so_far)
    is_gap = F.col("type") == "time_delta"
    s = s.withColumn("_band", F.when(is_gap, F.col("band")).otherwise(F.col("_gap")))
    gaps = model.gaps.select(F.col("band").alias("_b"), F.struct(F.lit("time").alias("kind"), F.col("type").alias("type"), F.lit(None).cast("array<double>").alias("levels"), "edges", "p").alias("_gc"))
    rows = model.numeric.select(*[F.col(k).alias(f"_n_{k}") for k in KEYS], F.struct(F.lit("row").alias("kind"), F.col("type").alias("type"), "levels", "edges", "p").alias("_nc"))
    s = s.join(F.broadcast(gaps), F.col("_band") == F.col("_b"), "left")
    s = s.join(rows, F.col("_cls").eqNullSafe(F.col("_n_class")) & F.col("_text").eqNullSafe(F.col("_n_text_value")), "left")
    numbers = F.col("type").isin("Q", "L", "num_marker", "fused_concept_Q", "fused_concept_L", "class_concept_Q", "class_concept_L")
    ctx = F.when(F.col("_band").isNotNull(), F.col("_gc")).when(F.col("_in") & (numbers | (text & (F.col("_nc.type") == "scaling"))), F.col("_nc"))
    s = s.withColumn("_ctx", ctx)
    return s.select(*[c for c in stream.columns if c not in ("token", "type", "qual_index")], "token", "type", "qual_index", *[F.col(f"_ctx.{c}").alias(f"ctx_{c}") for c in ("kind", "type", "levels", "edges", "p")])
