"""Queries of this package's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import packing, percentiles, pii, splits, terms, tokenizer


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.event_percentiles(_read(spark, d, "demo"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "demo").select("id", "time", "class", "text_value", "numeric_value").distinct()


def p1_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the values of p1_percentiles keep the error they state."""
    by = ["class", "text_value"]
    return percentiles.rank_check(p1_percentiles(spark, d), _numbers(spark, d), by, "numeric_value", percentiles.PERMILLE)


def p1_sketched(spark: SparkSession, d: str) -> DataFrame:
    """The same for percentiles by class, all read from counters, without pairs kept aside."""
    found = percentiles.event_percentiles(_read(spark, d, "demo"), by=("class",), kept=0)
    return percentiles.rank_check(found, _numbers(spark, d), ["class"], "numeric_value", percentiles.PERMILLE)


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    """Counters of separate days united, those of all rows at once, and all rows with one half of
    the ids deleted again against the other half: equal results by class, since counters add up."""
    rows, by = _numbers(spark, d), ["class"]
    cuts = percentiles.PERMILLE
    counted = lambda s: percentiles.quantiles(percentiles.merged(s, by, kept=0), by, cuts).select("class", "n", F.struct(*cuts).alias("q"))
    days = counted(percentiles.daily_sketches(rows))
    whole = percentiles.sketch(rows, by, "numeric_value")
    half = rows.withColumn("w", F.lit(-1)).filter("coalesce(id, 0) % 2 = 0")
    left = counted(whole.unionByName(percentiles.sketch(half, by, "numeric_value", "w")))
    kept = counted(percentiles.sketch(rows.filter("coalesce(id, 0) % 2 <> 0"), by, "numeric_value"))
    same = counted(whole).alias("a").join(days.alias("b"), F.expr("a.class <=> b.class")).select("a.class", "a.n", F.expr("a.q = b.q").alias("days_equal"))
    gone = left.alias("a").join(kept.alias("b"), F.expr("a.class <=> b.class")).select(F.col("a.class").alias("_c"), F.col("a.n").alias("n_left"), F.expr("a.q = b.q and a.n = b.n").alias("deletion_equal"))
    return same.join(gone, F.expr("class <=> _c")).drop("_c")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.event_terms(_read(spark, d, "demo")).filter("mark is not null").select("class", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.event_terms(_read(spark, d, "demo"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_ids(_read(spark, d, "demo"), _read(spark, d, "id_links"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_ids(_read(spark, d, "demo"), _read(spark, d, "id_links"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(_read(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decoded(tokenizer.encoded(_read(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.document_containers(_read(spark, d, "documents"), _read(spark, d, "containers"))


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """What holds for every document and kind: its parts (rows), whether they follow each other
    without a gap, and whether no container is over its capacity."""
    kinds = _read(spark, d, "containers").select(F.col("container_kind").alias("_kind"), "capacity_tokens").distinct()
    p = packing.document_containers(_read(spark, d, "documents"), _read(spark, d, "containers"))
    fill = p.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("fill"))
    over = fill.join(F.broadcast(kinds), F.col("container_kind") == F.col("_kind")).filter("container_id is not null and fill > capacity_tokens").select("container_kind").distinct()
    one = p.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.countDistinct("part").alias("parts"), F.max("part").alias("last"), F.max(F.col("container_id").isNull()).alias("unplaced"))
    one = one.join(F.broadcast(over.withColumn("_over", F.lit(True))), "container_kind", "left")
    return one.select("container_kind", "doc_id", "unplaced", ((F.col("n") == F.col("parts")) & (F.col("last") + 1 == F.col("parts")) & (F.col("tokens") == F.col("upto"))).alias("whole"), F.col("_over").isNull().alias("fits"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(_read(spark, d, "documents"), _read(spark, d, "person_names"), _read(spark, d, "items"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.without_personal_information(_read(spark, d, "documents"), _read(spark, d, "person_names"), _read(spark, d, "items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_percentiles, p1_within, p1_sketched, p1_days, p4_found, p4_terms, p6_found, p6_splits, p8_ids, p8_decoded, p9_containers, p9_cover, p10_found, p10_masked]
    return {f.__name__: f for f in found}
