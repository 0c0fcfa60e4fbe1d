"""Small helpers shared by all operators: column picking, times, duplicates, lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
EVENT_COLUMNS = ("id", "time", "class", "text_value", "numeric_value")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns. Every operator starts with this, so that further columns of
    the input, whatever their names, can neither clash with its own nor be read from disk.

    Raises ValueError that names the missing columns.
    """
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def epoch_us(column: str | Column, spark: SparkSession | None = None) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a timestamp read as it stands, without time zone.

    In a UTC session this is one cast; in any other session the calendar fields are used, so
    that daylight saving can't move a timestamp_ntz.
    """
    c = F.col(column) if isinstance(column, str) else column
    spark = spark or SparkSession.active()
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return F.unix_micros(c.cast("timestamp"))
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    clock = F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
    return F.unix_date(F.to_date(c)).cast("long") * DAY_US + clock


def usable(column: str | Column) -> Column:
    """True for a number that is neither null nor NaN; never null."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c)


def first_of_repeats(df: DataFrame, keys: list[str], order: str = "_src") -> DataFrame:
    """One row for rows that are equal in ``keys``, with the smallest ``order``.

    Nulls equal nulls and NaN equals NaN. One hash aggregation on all keys: rows sent again are
    few, so the keys are as many as the rows and no entity, source or value makes a hot partition.
    """
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds the row's place in the given order, from ``start``. Rows lie in ranges; each range numbers
    its own, and only the ranges' sizes come to the driver. Ties are in any order."""
    part = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in part.groupBy("_range").count().collect()}
    begin, at = {}, start
    for p in sorted(sizes):
        begin[p], at = at, at + sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[F.col("_range")] if begin else F.lit(start)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + offset
    return part.withColumn(name, place.cast("long")).drop("_range")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder
    of this machine is set for local masters (tests, a laptop); on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, which survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
