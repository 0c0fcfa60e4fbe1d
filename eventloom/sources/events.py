"""Event tables: reading, checking, adapting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.frames import EVENT_COLUMNS

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("time", T.TimestampNTZType()), T.StructField("class", T.StringType()),
    T.StructField("text_value", T.StringType()), T.StructField("numeric_value", T.DoubleType()),
])


def require_events(df: DataFrame) -> None:
    """ValueError that names missing event columns. Further columns are allowed."""
    missing = sorted(set(EVENT_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def canonical(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The event columns with their types and ``_src``, the order in the source: the frame's own
    _src if it has one, else a running number over ``order``-free input as it was read.

    A column of nulls of no type becomes doubles or strings. NaN is a missing number later on.
    """
    require_events(df)
    types = {f.name: f.dataType for f in EVENT_SCHEMA.fields}
    id_type = df.schema["id"].dataType
    types["id"] = id_type if isinstance(id_type, T.StringType) else T.LongType()
    if isinstance(df.schema["time"].dataType, T.TimestampType):
        types["time"] = T.TimestampType()
    src = F.col("_src").cast("long") if "_src" in df.columns else F.monotonically_increasing_id()
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in EVENT_COLUMNS], src.alias("_src"))


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """An event table from CSV; empty fields are null. ``_src`` follows the lines of each file."""
    return canonical(spark.read.schema(EVENT_SCHEMA).option("header", header).option("nullValue", "").option("enforceSchema", False).csv(path))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The frame with columns under the names of the event table, ``{"item": "class"}``."""
    return df.withColumnsRenamed(names)


def from_meds(meds: DataFrame, separator: str = r"\s*//\s*") -> DataFrame:
    """An event table from a table with ``subject_id, time, code, numeric_value``.

    A code is a class and a text with ``//`` between them; blanks around the first separator are
    dropped and the class is lower-cased. A code without separator is a class without text, and
    MEDS_BIRTH is the birth row. Null codes give a null class. ``separator`` is a pattern, for
    instance ``\\s*/+\\s*`` for systems that write one to three slashes.
    """
    pair = F.split(F.col("code"), separator, 2)
    birth = F.col("code") == "MEDS_BIRTH"
    out = meds.select(
        F.col("subject_id").alias("id"), "time", F.when(birth, F.lit("demographic")).otherwise(F.lower(F.get(pair, F.lit(0)))).alias("class"),
        F.when(birth, F.lit("birth_date")).otherwise(F.get(pair, F.lit(1))).alias("text_value"), F.col("numeric_value").cast("double").alias("numeric_value"),
        *([F.col("_src")] if "_src" in meds.columns else []),
    )
    return canonical(out)
