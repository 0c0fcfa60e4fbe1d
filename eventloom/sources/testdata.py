"""Event tables made from the other test tables, with an explicit source order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.events import canonical


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def demo(spark: SparkSession, folder: str) -> DataFrame:
    return canonical(_read(spark, folder, "demo"))


def basic_events(spark: SparkSession, folder: str) -> DataFrame:
    """events: one class, the event type as text."""
    return canonical(_read(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("time"), F.lit("event").alias("class"), F.col("event_type").alias("text_value"), F.col("value").alias("numeric_value"), F.col("event_id").alias("_src")))


def typed_events(spark: SparkSession, folder: str) -> DataFrame:
    """events: the event type as class, the property k as text."""
    return canonical(_read(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("time"), F.col("event_type").alias("class"), F.get_json_object("props", "$.k").alias("text_value"), F.col("value").alias("numeric_value"), F.col("event_id").alias("_src")))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """orders: by customer, the status as class, the priority as text."""
    return canonical(_read(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("time"), F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("text_value"), F.col("o_totalprice").alias("numeric_value"), F.col("o_orderkey").alias("_src")))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem: by order, return flag and line status as text with //, the quantity as number."""
    li = _read(spark, folder, "lineitem")
    return canonical(li.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("time"), F.lit("line").alias("class"), F.concat_ws("//", "l_returnflag", "l_linestatus").alias("text_value"), F.col("l_quantity").alias("numeric_value"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("_src")))
