"""The vocabulary: tokens, their ids, and what they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.frames import numbered
from eventloom.functions.scalars import MAX_AGE, name_pieces, split_text

COLUMNS = "token string, type string, class string, piece string, starts_row boolean, qual string, qual_index int, band string"

# How many milestone tokens of each kind there are, from which number on.
MILESTONE_RANGES = {"week": (1, 53), "month": (1, 12), "day": (1, 7), "12hr": (0, 1), "8hr": (0, 2)}

#: Types of tokens that open a row.
ROW_STARTS = ("class", "class_concept", "class_concept_Q", "class_concept_L")


def special_tokens(config: TokenizerConfig) -> list[tuple]:
    """Reserved tokens in order, as rows of COLUMNS."""
    row = lambda token, kind, qual=None, index=None, band=None: (token, kind, None, None, False, qual, index, band)
    out = [row(f"<|{t}|>", t) for t in ("sos", "eos", "pad")]
    out += [row(f"<|delta_time_{b}|>", "time_delta", band=b) for b in config.bands]
    out.append(row("<|NUM|>", "num_marker"))
    out += [row(f"<|Q{i}|>", "Q", "Q", i) for i in range(config.n_bins + 1)]
    out += [row(f"<|L{i}|>", "L", "L", i) for i in range(config.level_threshold + 1)]
    out += [row(f"<|ms_{k}_{i}|>", "milestone") for k, (a, b) in MILESTONE_RANGES.items() for i in range(a, b + 1)]
    out += [row(f"<|age_{i}|>", "age") for i in range(MAX_AGE + 1)]
    out.append(row("<|ROW|>", "row"))
    return out


def fused_time_tokens(config: TokenizerConfig) -> list[tuple]:
    if config.num_seq != "fused" or config.num_type != "discrete":
        return []
    return [(f"<|delta_time_{b}_Q{i}|>", "time_delta_fused", None, None, False, "Q", i, b) for b in config.bands for i in range(config.n_bins + 1)]


def build(spark: SparkSession, pairs: DataFrame, numeric: DataFrame, config: TokenizerConfig, base: int = 0) -> DataFrame:
    """``token, token_id`` and COLUMNS. ``pairs`` has the training pairs ``class, text_value, mode``,
    ``numeric`` their parameters ``class, text_value, type, levels``. Ids start at ``base``.

    Reserved tokens come first, then classes, fused time tokens, concepts and fused numbers, each in
    order of their strings. A token that would stand for two different things raises ValueError.
    """
    special = spark.createDataFrame([(*r, i) for i, r in enumerate(special_tokens(config))], COLUMNS + ", _i long").withColumn("_part", F.lit(0))
    fused_time = spark.createDataFrame([(*r, i) for i, r in enumerate(fused_time_tokens(config))], COLUMNS + ", _i long").withColumn("_part", F.lit(2))
    none = lambda t: F.lit(None).cast(t)
    classes = pairs.select("class").distinct().select(
        F.concat(F.lit("<|"), "class", F.lit("|>")).alias("token"), F.lit("class").alias("type"), "class", none("string").alias("piece"), F.lit(True).alias("starts_row"),
        none("string").alias("qual"), none("int").alias("qual_index"), none("string").alias("band"), F.lit(0).cast("long").alias("_i"), F.lit(1).alias("_part"),
    )
    fuse, space = config.fuse_class_to_concept, config.namespace_concepts_by_class
    texts = pairs.filter("mode = 'concept' and text_value is not null").withColumn("_pieces", split_text(F.col("class"), F.col("text_value"), config))
    texts = texts.withColumn("_names", name_pieces(F.col("class"), F.col("_pieces"), config))
    first = F.col("i") == 0
    own = first if fuse and not space else F.lit(bool(fuse or space))
    concepts = texts.select("class", F.posexplode(F.arrays_zip("_names", "_pieces")).alias("i", "x")).select(
        F.col("x._names").alias("token"), F.when(first & F.lit(fuse), F.lit("class_concept")).otherwise(F.lit("concept")).alias("type"),
        F.when(own, F.col("class")).alias("class"), F.col("x._pieces").alias("piece"), (first & F.lit(fuse)).alias("starts_row"),
        none("string").alias("qual"), none("int").alias("qual_index"), none("string").alias("band"), F.lit(0).cast("long").alias("_i"), F.lit(3).alias("_part"),
    )
    out = special.unionByName(classes).unionByName(fused_time).unionByName(concepts.distinct())
    if config.num_seq == "fused":
        n = numeric.filter("text_value is not null").join(texts.select("class", "text_value", "_pieces", "_names"), ["class", "text_value"])
        last = F.size("_names") - 1
        count = F.when(F.col("type") == "level", F.size("levels")).when(F.col("type") == "bins", F.lit(config.n_bins + 1)).otherwise(F.lit(0))
        qual = F.when(F.col("type") == "level", F.lit("L")).otherwise(F.lit("Q"))
        n = n.withColumn("_count", count).filter("_count > 0").withColumn("_one", last == 0)
        n = n.select("class", "_one", qual.alias("qual"), F.get("_names", last).alias("name"), F.get("_pieces", last).alias("piece"), F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("qual_index"))
        starts = F.col("_one") & F.lit(fuse)
        mine = starts if fuse and not space else F.lit(bool(fuse or space))
        out = out.unionByName(n.select(
            F.concat("name", F.lit("::"), "qual", F.col("qual_index").cast("string")).alias("token"), F.concat(F.when(starts, F.lit("class_concept_")).otherwise(F.lit("fused_concept_")), "qual").alias("type"),
            F.when(mine, F.col("class")).alias("class"), "piece", starts.alias("starts_row"), "qual", "qual_index", none("string").alias("band"), F.lit(0).cast("long").alias("_i"), F.lit(4).alias("_part"),
        ).distinct())
    clash = out.groupBy("token").agg(F.count("*").alias("n"), F.collect_set("type").alias("types")).filter("n > 1").orderBy("token").limit(5).collect()
    if clash:
        raise ValueError("tokens collide: " + ", ".join(f"{r['token']!r} ({', '.join(sorted(r['types']))})" for r in clash))
    return numbered(out, ["_part", "_i", "token"], "token_id", base).select("token", "token_id", *[c.strip().split()[0] for c in COLUMNS.split(",")[1:]])
