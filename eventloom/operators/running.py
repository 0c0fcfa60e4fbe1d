"""Running values along the histories of entities, also of those that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.frames import cut, epoch_us

#: Rows from which an entity's history is cut into blocks.
HOT_ROWS = 2_000_000
#: Length of a block; rows without time, which come first, are cut by their _src.
BLOCK_US, BLOCK_SRC = 3_600_000_000, 1_000_000


def hot_ids(events: DataFrame, key: str = "id") -> DataFrame | None:
    """``id`` (or another key) and ``_n`` of the entities with more than HOT_ROWS rows, of which
    there is at most one per HOT_ROWS rows; None without any."""
    hot = cut(events.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS))
    return None if hot.isEmpty() else hot


def with_blocks(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds ``_hot`` (rows of the entity, null if it isn't hot) and ``_blk``, which rises with (time,
    _src) in a hot entity and is 0 in others. Without hot entities nothing is added."""
    if hot is None:
        return rows
    ids = hot.select(F.col("id").alias("_hid"), F.col("_n").alias("_hot"))
    rows = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_hid")), "left").drop("_hid")
    block = F.coalesce(F.floor(epoch_us("time", rows.sparkSession) / BLOCK_US), F.floor(F.col("_src") / BLOCK_SRC) - F.lit(1 << 60))
    return rows.withColumn("_blk", F.when(F.col("_hot").isNotNull(), block).otherwise(F.lit(0)).cast("long"))


def with_place_blocks(stream: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """The same for a token stream: blocks of BLOCK_SRC places."""
    if hot is None:
        return stream
    ids = hot.select(F.col(key).alias("_hid"), F.col("_n").alias("_hot"))
    stream = stream.join(F.broadcast(ids), F.col(key).eqNullSafe(F.col("_hid")), "left").drop("_hid")
    return stream.withColumn("_blk", F.when(F.col("_hot").isNotNull(), F.floor(F.col("pos") / BLOCK_SRC)).otherwise(F.lit(0)).cast("long"))


def running(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]], inclusive: bool) -> DataFrame:
    """Adds running values over ``keys`` in the given order: name -> (``sum`` or ``last``, value).
    ``last`` is the last value that isn't null. ``inclusive`` takes in the row itself.

    Rows that ``with_blocks`` has cut into blocks go in two levels: a window inside each block, and
    the values of the earlier blocks, a row per block, which are joined to it. The results are those
    of one window.
    """
    end = 0 if inclusive else -1
    inside = lambda how, c, w: F.sum(c).over(w) if how == "sum" else F.last(c, ignorenulls=True).over(w)
    if "_blk" not in rows.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.select("*", *[_known(how, inside(how, c, w)).alias(n) for n, (how, c) in wanted.items()])
    rows = rows.select("*", *[c.alias(f"_v_{n}") for n, (_, c) in wanted.items()])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = rows.select("*", *[inside(how, F.col(f"_v_{n}"), w).alias(n) for n, (how, _) in wanted.items()])
    place = F.struct(*order)
    whole = lambda how, v: F.sum(v) if how == "sum" else F.max_by(v, F.when(v.isNotNull(), place))
    blocks = rows.filter("_hot is not null").groupBy(*keys, "_blk").agg(*[whole(how, F.col(f"_v_{n}")).alias(n) for n, (how, _) in wanted.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_kb"), *[inside(how, F.col(n), earlier).alias(f"_c_{n}") for n, (how, _) in wanted.items()])
    on = F.col("_hot").isNotNull() & (F.col("_blk") == F.col("_kb"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(carried, on, "left")
    names = [c for c in rows.columns if not c.startswith("_v_")]
    both = lambda n, how: F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if how == "sum" else F.coalesce(n, f"_c_{n}")
    return out.select(*names, *[both(n, how).alias(n) for n, (how, _) in wanted.items()])


def _known(how: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if how == "sum" else c
