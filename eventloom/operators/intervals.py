"""Continuous periods and gaps of intervals that overlap, nest, touch or lie apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.frames import DAY_US, epoch_us, pick

#: A sweep is cut into blocks of this length, so that an entity with very many intervals is
#: spread over its blocks and only one small row per block meets in one place.
BLOCK_US = DAY_US


def _running(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds inclusive running aggregates over (_e, _t): name -> (sum or max, value).

    Two levels: a window inside each (_e, _block), and the totals of the earlier blocks, which
    are joined back. No window ever holds more than one block of an entity.
    """
    fold = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy("_e", "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_e").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_e", "_block").agg(*[fold[how](c).alias(n) for n, (how, c) in wanted.items()])
    carried = totals.select("_e", "_block", *[fold[how](n).over(earlier).alias(f"_c_{n}") for n, (how, _) in wanted.items()])
    out = df.select("*", *[fold[how](c).over(inside).alias(f"_w_{n}") for n, (how, c) in wanted.items()]).join(carried, ["_e", "_block"])
    for n, (how, _) in wanted.items():
        both = F.coalesce(f"_w_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if how == "sum" else F.greatest(f"_w_{n}", f"_c_{n}")
        out = out.withColumn(n, both)
    return out.drop(*[f"_{k}_{n}" for n in wanted for k in "wc"])


def periods_and_gaps(spans: DataFrame, entity: str = "id", start: str = "start", end: str = "end", block: int = BLOCK_US) -> DataFrame:
    """The longest covered stretches of each entity (kind ``period``) and what lies between one
    and the next (kind ``gap``); columns ``entity, kind, start, end``.

    Sweep line: every interval gives a plus and a minus mark, marks at one moment are added up,
    running sums give the number of open intervals, and a period opens where it leaves zero and
    closes where it returns to zero.

    ``start`` and ``end`` are integers (for instance microseconds), both ends included: intervals
    that only touch belong to one period, and an interval of no length is a period of no length.
    Intervals with a null entity or end, or that end before they start, are left out. Repeated
    intervals change nothing. An empty table gives an empty table. Other columns are ignored.
    """
    s = pick(spans, entity, start, end).toDF("_e", "_from", "_to")
    s = s.filter("_e is not null and _from is not null and _to is not null and _to >= _from")
    marks = s.select("_e", F.explode(F.array(F.struct(F.col("_from").alias("t"), F.lit(1).alias("p"), F.lit(0).alias("m")), F.struct(F.col("_to").alias("t"), F.lit(0).alias("p"), F.lit(1).alias("m")))).alias("x"))
    marks = marks.groupBy("_e", F.col("x.t").alias("_t")).agg(F.sum("x.p").alias("_p"), F.sum("x.m").alias("_m"))
    marks = marks.withColumn("_block", F.floor(F.col("_t") / block))
    swept = _running(marks, {"_open": ("sum", F.col("_p") - F.col("_m"))})
    opens, closes = F.col("_open") - F.col("_p") + F.col("_m") == 0, F.col("_open") == 0
    edges = swept.filter(opens | closes).select("_e", "_block", "_t", F.when(opens, F.col("_t")).alias("_up"), F.when(closes, F.col("_t")).alias("_down"))
    # the last closing before an edge that opens and closes at one moment is not that edge's own
    inside = Window.partitionBy("_e", "_block").orderBy("_t")
    edges = edges.withColumn("_before", F.lag("_down").over(inside))
    known = _running(edges, {"_since": ("max", F.col("_up"))})
    earlier = edges.groupBy("_e", "_block").agg(F.max("_down").alias("_d"))
    earlier = earlier.select("_e", "_block", F.max("_d").over(Window.partitionBy("_e").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_d"))
    within = Window.partitionBy("_e", "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_prev", F.max("_before").over(within)).join(earlier, ["_e", "_block"])
    known = known.withColumn("_prev", F.coalesce("_prev", "_d"))
    period = F.when(F.col("_down").isNotNull(), F.struct(F.lit("period").alias("kind"), F.col("_since").alias("a"), F.col("_down").alias("b")))
    gap = F.when(F.col("_up").isNotNull() & F.col("_prev").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("_prev").alias("a"), F.col("_up").alias("b")))
    out = known.select("_e", F.explode(F.array_compact(F.array(period, gap))).alias("x"))
    return out.select(F.col("_e").alias(entity), F.col("x.kind").alias("kind"), F.col("x.a").alias(start), F.col("x.b").alias(end))


def stays(events: DataFrame) -> DataFrame:
    """The stays of an event table: columns ``id, stay, start, end`` in microseconds.

    An admission and a discharge row of one id with the same stay number (the number of six or
    more digits in the text), both with a time, the discharge not before the admission. Of several
    admissions and discharges with one number every allowed pair is a stay; their union is the
    stretch from the first admission to the last discharge, and that is what comes out. So rows
    sent again change nothing and one aggregation does the join. Rows without id, time, text or
    stay number are left out.
    """
    e = pick(events, "id", "time", "class", "text_value").filter(F.col("class").isin("admission", "discharge"))
    e = e.select("id", "class", epoch_us("time", events.sparkSession).alias("t"), F.regexp_extract("text_value", r"[0-9]{6,}", 0).alias("stay"))
    e = e.filter("id is not null and t is not null and stay <> ''")
    s = e.groupBy("id", "stay").agg(F.min(F.when(F.col("class") == "admission", F.col("t"))).alias("start"), F.max(F.when(F.col("class") == "discharge", F.col("t"))).alias("end"))
    return s.filter(F.col("end") >= F.col("start"))


def stay_periods(events: DataFrame) -> DataFrame:
    """Periods and gaps of the stays of each id, in whole seconds: ``id, kind, start_s, end_s``."""
    p = periods_and_gaps(stays(events))
    return p.select("id", "kind", F.floor(F.col("start") / 1_000_000).alias("start_s"), F.floor(F.col("end") / 1_000_000).alias("end_s"))
