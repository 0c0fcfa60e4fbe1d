"""Event tables to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.frames import cut
from eventloom.functions.scalars import digitize, level_index, name_pieces, scale, split_text
from eventloom.operators import bpe
from eventloom.operators.running import hot_ids, running, with_blocks
from eventloom.operators.timeline import timeline
from eventloom.operators.training import KEYS, TokenizerModel
from eventloom.sources.events import canonical

TOKEN = "struct<token:string,bpe_id:int,val:double>"
#: Rows of a vocabulary that is broadcast; a larger one is joined by a shuffle.
SMALL = 500_000


def _token(token: Column, val: Column | None = None) -> Column:
    return F.struct(token.cast("string").alias("token"), F.lit(None).cast("int").alias("bpe_id"), (F.lit(None) if val is None else val).cast("double").alias("val"))


def _none() -> Column:
    return F.array().cast(f"array<{TOKEN}>")


def _if(cond: Column, *tokens: Column) -> Column:
    return F.when(cond, F.array(*tokens)).otherwise(_none())


def _number(index: Column) -> Column:
    return index.cast("int").cast("string")


def _gap_tokens(model: TokenizerModel) -> Column:
    """Tokens of a time difference in one of four layouts; none if the band has no parameters."""
    c = model.config
    seconds = F.col("_dt_us") / 1e6
    name = F.concat(F.lit("<|delta_time_"), F.col("_g.band"))
    marker = F.concat(name, F.lit("|>"))
    there = F.col("_dt_us").isNotNull() & F.col("_g.type").isNotNull()
    if c.num_type == "discrete":
        q = _number(digitize(seconds, F.col("_g.edges")))
        if c.num_seq == "fused":
            return _if(there, _token(F.concat(name, F.lit("_Q"), q, F.lit("|>"))))
        return _if(there, _token(marker), _token(F.concat(F.lit("<|Q"), q, F.lit("|>"))))
    z = scale(seconds, F.col("_g.p"), c.continuous_clip_values)
    if c.num_seq == "fused":
        return _if(there, _token(marker, z))
    return _if(there, _token(marker), _token(F.lit("<|NUM|>"), z))


def row_tokens(events: DataFrame, model: TokenizerModel, lines: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The event table with ``_rn`` (the row's number within its id) and ``tokens``: the array of
    (token, bpe_id, val) that the row adds to its id's sequence, in order: start, time difference,
    milestone, age, class, text, number, end. Token strings of byte-pair pieces are null.

    A number of a group that training didn't see is left out. With fused numbers, so is the number
    of a row without text. ``lines`` is a timeline made elsewhere (a stream's);
    ``hot`` the ids whose history goes in blocks.
    """
    c = model.config
    t = timeline(canonical(events), c, model.births, hot) if lines is None else lines
    bands = F.array(*map(F.lit, c.bands))
    gaps = model.gaps.select(F.col("band").alias("_b"), F.struct("band", "type", "edges", "p").alias("_g"))
    # one row per time band
    t = t.withColumn("_b", F.get(bands, F.col("_band"))).join(F.broadcast(gaps), "_b", "left").drop("_b")
    numbers = model.numeric.select(*[F.col(k).alias(f"_n_{k}") for k in KEYS], F.struct("type", "levels", "edges", "p").alias("_num"))
    t = t.join(numbers, F.col("class").eqNullSafe(F.col("_n_class")) & F.col("text_value").eqNullSafe(F.col("_n_text_value")), "left").drop("_n_class", "_n_text_value")

    text, x = F.col("text_value"), F.col("numeric_value")
    t = t.withColumn("_mode", model.mode(F.col("class"), text))
    concept = F.col("_mode") == "concept"
    t = t.withColumn("_names", F.when(text.isNotNull() & concept, name_pieces(F.col("class"), split_text(F.col("class"), text, c), c)))
    has = x.isNotNull() & ~F.isnan(x) & F.col("_num").isNotNull()
    kind = F.col("_num.type")
    level, bins = _number(level_index(x, F.col("_num.levels"))), _number(digitize(x, F.col("_num.edges")))
    z = scale(x, F.col("_num.p"), c.continuous_clip_values)
    own_token = F.when(kind == "level", _token(F.concat(F.lit("<|L"), level, F.lit("|>")))).when(kind == "bins", _token(F.concat(F.lit("<|Q"), bins, F.lit("|>")))).otherwise(_token(F.lit("<|NUM|>"), z))
    names = F.col("_names")
    plain = F.transform(names, lambda n: _token(n))
    if c.num_seq == "fused":
        last = F.get(names, F.size(names) - 1)
        on_last = F.when(kind == "level", _token(F.concat(last, F.lit("::L"), level))).when(kind == "bins", _token(F.concat(last, F.lit("::Q"), bins))).otherwise(_token(last, z))
        words = F.when(has, F.concat(F.slice(plain, F.lit(1), F.size(names) - 1), F.array(on_last))).otherwise(plain)
        factored = has & ~concept
    else:
        words, factored = plain, has
    words = F.coalesce(words, _none())
    if model.uses_bpe:
        ids = F.when(text.isNotNull() & (F.col("_mode") == "bpe"), text)
        t = t.withColumn("_bpe", bpe.encoder(model.merges, c.split_pattern)(ids))
        pieces = F.transform("_bpe", lambda i: F.struct(F.lit(None).cast("string").alias("token"), i.alias("bpe_id"), F.lit(None).cast("double").alias("val")))
        words = F.when(F.col("_bpe").isNotNull(), pieces).otherwise(words)
    carried = text.isNotNull() & concept & F.lit(c.fuse_class_to_concept)
    body = F.concat(
        _gap_tokens(model), _if(F.col("_ms").isNotNull(), _token(F.col("_ms"))), _if(F.col("_age").isNotNull(), _token(F.concat(F.lit("<|age_"), F.col("_age").cast("string"), F.lit("|>")))),
        _if(~carried, _token(F.concat(F.lit("<|"), F.col("class"), F.lit("|>")))), words, _if(factored, own_token),
    )
    t = t.withColumn("_body", F.when(F.col("_birth"), _none()).otherwise(body))
    tokens = F.concat(_if(F.col("_sos"), _token(F.lit("<|sos|>"))), F.col("_body"), _if(F.col("_eos"), _token(F.lit("<|eos|>"))))
    keep = [x for x in ("id", "time", "class", "text_value", "numeric_value", "_src") if x in t.columns]
    return t.select(*keep, "_rn", tokens.alias("tokens"), F.col("_sos").cast("int").alias("_lead"), F.col("_eos").cast("int").alias("_tail"))


def with_ids(tokens: DataFrame, model: TokenizerModel, strict: bool = True) -> DataFrame:
    """Adds ``token_id``. A token that isn't in the vocabulary fails the query with its name
    (``strict``) or has a null id."""
    v = model.vocab.select("token", F.col("token_id").alias("_vid"))
    if v.limit(SMALL + 1).count() <= SMALL:
        v = F.broadcast(v)
    found = tokens.join(v, "token", "left").withColumn("token_id", F.coalesce(F.col("bpe_id").cast("long"), "_vid")).drop("_vid")
    if strict:
        found = found.withColumn("token_id", F.coalesce("token_id", F.raise_error(F.concat(F.lit("token not in the vocabulary: "), F.col("token"))).cast("long")))
    return found


def encode(events: DataFrame, model: TokenizerModel, strict: bool = True) -> DataFrame:
    """The token stream: ``id, row_no, pos, token, token_id, val``. ``row_no`` is the row within its
    id in order of (time, _src), from 0, and -1 for start and end tokens; ``pos`` is the place in
    the id's sequence, from 0."""
    hot = hot_ids(canonical(events))
    r = with_blocks(row_tokens(events, model, hot=hot), hot)
    r = running(r, ["id"], ["_rn"], {"_at": ("sum", F.size("tokens"))}, inclusive=False)
    flat = r.select("id", "_rn", "_at", F.size("tokens").alias("_n"), "_lead", "_tail", F.posexplode("tokens").alias("_i", "x"))
    edge = ((F.col("_i") == 0) & (F.col("_lead") == 1)) | ((F.col("_i") == F.col("_n") - 1) & (F.col("_tail") == 1))
    flat = flat.select("id", F.when(edge, -1).otherwise(F.col("_rn") - 1).cast("long").alias("row_no"), (F.col("_at") + F.col("_i")).cast("long").alias("pos"), F.col("x.token").alias("token"), F.col("x.bpe_id").alias("bpe_id"), F.col("x.val").alias("val"))
    return with_ids(flat, model, strict).select("id", "row_no", "pos", "token", "token_id", "val")


def unknown_tokens(events: DataFrame, model: TokenizerModel) -> DataFrame:
    """``token, n``: tokens that the table would need and the vocabulary lacks."""
    return encode(events, model, strict=False).filter("token_id is null").groupBy("token").agg(F.count("*").alias("n"))


def debug(events: DataFrame, model: TokenizerModel) -> DataFrame:
    """Each row with ``tokens``, its token strings in order; values of continuous tokens are added
    as (0.000) and byte-pair pieces as their ids."""
    r = row_tokens(events, model)
    show = lambda x: F.concat(F.coalesce(x["token"], F.concat(F.lit("#"), x["bpe_id"].cast("string"))), F.coalesce(F.format_string("(%.3f)", x["val"]), F.lit("")))
    shown = F.transform("tokens", lambda x: F.when(x["val"].isNull(), F.coalesce(x["token"], F.concat(F.lit("#"), x["bpe_id"].cast("string")))).otherwise(show(x)))
    return r.withColumn("tokens", shown).drop("_rn", "_lead", "_tail")


def sequences(stream: DataFrame) -> DataFrame:
    """``id, ids, vals, row_nos``: a token stream with one row per id; missing values are NaN. An id's
    tokens are one value, so for histories beyond some million tokens use ``sequence_chunks``."""
    return _arrays(stream.groupBy("id"), ["id"])


def sequence_chunks(stream: DataFrame, length: int = 65_536) -> DataFrame:
    """``id, chunk_no, ids, vals, row_nos``: the same in chunks of ``length`` tokens, numbered from 0;
    the last of an id may be shorter. No task holds more than a chunk of an id at once."""
    if length < 1:
        raise ValueError("length must be positive")
    return _arrays(stream.withColumn("chunk_no", F.floor(F.col("pos") / length)).groupBy("id", "chunk_no"), ["id", "chunk_no"])


def _arrays(grouped, keys: list[str]) -> DataFrame:
    s = grouped.agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", "val", "row_no"))).alias("s"))
    return s.select(*keys, F.transform("s", lambda x: x["token_id"]).alias("ids"), F.transform("s", lambda x: F.coalesce(x["val"], F.lit(float("nan")))).alias("vals"), F.transform("s", lambda x: x["row_no"]).alias("row_nos"))


def global_row_index(events: DataFrame) -> DataFrame:
    """``id, _src, row_idx``: the row's place in the whole table in order of (id, time, _src). Two
    levels: places within the id, and running totals over ids, which are themselves added up in
    ranges of ids first."""
    e = canonical(events).select("id", "time", "_src")
    within = running(with_blocks(e, hot_ids(e)), ["id"], ["time", "_src"], {"_k": ("sum", F.lit(1))}, inclusive=False)
    per = cut(e.groupBy("id").agg(F.count("*").alias("_n")).repartitionByRange("id").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = per.groupBy("_p").agg(F.sum("_n").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    start = per.select("id", "_p", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_s")).join(before, "_p").select("id", (F.col("_s") + F.col("_base")).alias("_start"))
    return within.join(start, "id").select("id", "_src", (F.col("_start") + F.col("_k")).alias("row_idx"))


def training_pairs(seqs: DataFrame, with_values: bool = False) -> DataFrame:
    """Inputs and targets of sequences of at least two tokens: ``id, x, y`` (and ``xv, yv``)."""
    s = seqs.filter(F.size("ids") >= 2)
    cut_ = lambda c: (F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1))
    x, y = cut_("ids")
    cols = [x.alias("x"), y.alias("y")]
    if with_values:
        xv, yv = cut_("vals")
        cols += [xv.cast("array<float>").alias("xv"), yv.cast("array<float>").alias("yv")]
    return s.select("id", *cols)
