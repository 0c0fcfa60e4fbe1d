"""Queries of the operators on intervals, units, spikes and features, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import entity_features, intervals, spikes, units


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.foreign_units(*(read(spark, d, t) for t in ("demo", "entities", "units", "site_units")))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    return units.harmonise(*(read(spark, d, t) for t in ("demo", "entities", "units", "site_units")))


def p2_graph(spark: SparkSession, d: str) -> DataFrame:
    """What the graph alone finds for the sites and quantities whose usual unit is defined."""
    found = units.site_usual_units(*(read(spark, d, t) for t in ("demo", "entities", "units")))
    return read(spark, d, "site_units").select("site", "quantity").distinct().join(found, ["site", "quantity"]).select("site", "quantity", "unit")


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    return entity_features.entity_features(read(spark, d, "demo"), read(spark, d, "units"))


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    return entity_features.feature_cells(read(spark, d, "demo"), read(spark, d, "units"))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """The cells with every name as a type of its own, misspellings too."""
    c = entity_features.feature_cells(read(spark, d, "demo"), read(spark, d, "units"), fold=False)
    return c.select("id", "type", "n", F.coalesce("since_s", F.lit(-1).cast("long")).alias("since_s"), (F.round("total", 4) + 0.0).alias("total"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """The features of each id added up over the types."""
    f = entity_features.entity_features(read(spark, d, "demo"), read(spark, d, "units"))
    add = lambda c, start: F.aggregate(c, F.lit(start).cast("long" if isinstance(start, int) else "double"), lambda a, x: a + x)
    return f.select("id", "n_rows", add(F.col("n"), 0).cast("long").alias("n"), F.array_min("since_s").alias("since_s"), F.round(add("total", 0.0), 4).alias("total"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(read(spark, d, "demo"), read(spark, d, "plausible_limits"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """The kinds that a rule defines: impossible and stuck."""
    return p5_found(spark, d).filter("kind <> 'spike'")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.stay_periods(read(spark, d, "demo"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_values, p2_graph, p3_features, p3_cells, p3_plain, p3_totals, p5_found, p5_rules, p7_found)}


PERIODS = """
    with e as (select id, class, time as t, regexp_extract(text_value, '[0-9]{6,}') as stay from demo
      where class in ('admission', 'discharge') and id is not null and time is not null and text_value is not null),
    s as (select a.id, a.t as f, d.t as u from e a join e d on a.id = d.id and a.stay = d.stay
      where a.class = 'admission' and d.class = 'discharge' and a.stay <> '' and d.t >= a.t),
    o as (select id, f, u, max(u) over (partition by id order by f, u rows between unbounded preceding and 1 preceding) as before from s),
    n as (select id, f, u, sum(case when before is null or f > before then 1 else 0 end) over (partition by id order by f, u rows unbounded preceding) as k from o),
    p as (select id, k, min(f) as f, max(u) as u from n group by id, k),
    g as (select id, u as f, lead(f) over (partition by id order by f) as u from p)
    select id, 'period' as kind, epoch_us(f) // 1000000 as start_s, epoch_us(u) // 1000000 as end_s from p
    union all select id, 'gap', epoch_us(f) // 1000000, epoch_us(u) // 1000000 from g where u is not null"""


def _readings() -> str:
    """The values of quantities with the unit that the text names, as table r: src, id, quantity, stated, v."""
    spelled = ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', '{u}')" for u, forms in units.UNIT_SPELLINGS.items() for s in forms)
    number = "[0-9]+(?:[.,][0-9]+)?"
    sides = r"^[\s,:;=()\[\]_-]+|[\s,:;=()\[\]_-]+$"
    mass = f"(?:^|[^a-z0-9.,])(?:({number})\\s*)?(milligram|microgram|gram|mcg|mg|ug|g)(?:[^a-z]|$)"
    return f"""
    with spelled(s, unit) as (values {spelled}),
    d as (select id, class, text_value, numeric_value, min(_src) as src from demo where class in ('lab', 'vital', 'medication') and text_value is not null group by id, time, class, text_value, numeric_value),
    t as (select src, id, numeric_value as x, class = 'medication' as med, regexp_replace(replace(replace(lower(text_value), 'µ', 'u'), 'μ', 'u'), '\\s*/\\s*', '/', 'g') as t from d),
    n as (select *, regexp_extract(t, '(?:^|[^a-z])(glucose|creatinine|haemoglobin|hemoglobin|cholesterol|bilirubin|temperature|temp|weight|height)(?:[^a-z]|$)', 1) as name, regexp_extract(t, '{mass}', 1) as dose, regexp_extract(t, '{mass}', 2) as mass from t),
    k as (select *, case when med then 'dose' when name = 'haemoglobin' then 'hemoglobin' when name = 'temp' then 'temperature' else name end as quantity, replace(replace(t, name, ' '), 'control', ' ') as rest from n where case when med then mass <> '' else name <> '' end),
    l as (select *, case when med then dose else regexp_extract(rest, '{number}') end as num, regexp_replace(regexp_replace(rest, '{number}', ' ', 'g'), '{sides}', '', 'g') as u0 from k),
    u as (select *, regexp_replace(regexp_replace(regexp_replace(case when regexp_matches(u0, '^in\\s+\\S') then regexp_replace(u0, '^in\\s+', '') else u0 end, '\\s*\\bper\\b\\s*|_', '/', 'g'), '\\s+', '', 'g'), 'lit(re|er)s?', 'l', 'g') as u1 from l),
    v as (select u.src, u.id, u.quantity, q.unit as stated, coalesce(try_cast(nullif(replace(num, ',', '.'), '') as double), case when not isnan(x) then x end) as v
      from u left join spelled s on s.s = case when med then mass else regexp_replace(u1, '^gm', 'g') end left join units q on q.quantity = u.quantity and q.unit = s.unit),
    r as (select * from v where v is not null qualify row_number() over (partition by src order by stated nulls last) = 1)"""


def _usual_units() -> str:
    return f"""{_readings()}
    select distinct s.site, s.quantity, s.unit from r join entities e on e.id = r.id join site_units s on s.site = e.site and s.quantity = r.quantity where r.stated is null"""


def _found_units() -> str:
    """The rule for recorded units in SQL; the reach of a patient comes from the stated values."""
    return f"""{_readings()},
    e as (select r.quantity, r.id, min(v * factor + shift) as least, max(v * factor + shift) as most from r join units c on c.quantity = r.quantity and c.unit = r.stated group by r.quantity, r.id, r.stated),
    b as (select quantity, quantile_disc(least, {units.REACH_TAIL}) as lo, quantile_disc(most, {1 - units.REACH_TAIL}) as hi from e group by quantity),
    w as (select c.quantity, c.unit, c.common_unit, (case when s > 0 then lo - {units.REACH_RANGES} * (hi - lo) else lo / {units.REACH_FACTOR} end - shift) / factor as lo, (case when s > 0 then hi + {units.REACH_RANGES} * (hi - lo) else hi * {units.REACH_FACTOR} end - shift) / factor as hi
      from units c join b using (quantity) join (select quantity, max(abs(shift)) as s from units group by quantity) using (quantity)),
    f as (select r.src, any_value(r.stated) as stated, any_value(w.common_unit) as common_unit, list(w.unit) filter (where r.v between w.lo and w.hi) as fits, any_value(su.unit) as usual
      from r join w on w.quantity = r.quantity left join entities n on n.id = r.id left join site_units su on su.site = n.site and su.quantity = r.quantity group by r.src),
    z as (select src, common_unit, coalesce(stated, case when list_contains(fits, usual) then usual end, case when len(fits) = 1 then fits[1] end) as unit from f)
    select src, unit from z where unit is not null and unit <> common_unit"""


TOTALS = """
    with d as (select distinct id, time, class, text_value, numeric_value from demo), a as (select max(epoch_us(time)) as latest from demo)
    select id, count(*) as n_rows, count(*) as n, (any_value(latest) - max(epoch_us(time))) // 1000000 as since_s,
      round(sum(case when numeric_value is not null and not isnan(numeric_value) then numeric_value else 0.0 end), 4) as total from d, a group by id"""


def _plain_cells() -> str:
    names = "glucose|creatinine|haemoglobin|hemoglobin|cholesterol|bilirubin|temperature|temp|weight|height"
    words = lambda x: f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
    gone = lambda x, w, sign: f"regexp_replace(regexp_replace({x}, '(^|[^{sign}])(?:{w})([^{sign}]|$)', '\\1 \\2', 'g'), '(^|[^{sign}])(?:{w})([^{sign}]|$)', '\\1 \\2', 'g')"
    return f"""
    with d as (select distinct id, time, class, text_value, numeric_value, lower(trim(text_value)) as low from demo), a as (select max(epoch_us(time)) as latest from demo),
    q as (select *, regexp_extract(low, '(?:^|[^a-z])({names})(?:[^a-z]|$)', 1) as q from d),
    n as (select *, case
        when class in ('lab', 'vital') then coalesce(nullif(case q when 'haemoglobin' then 'hemoglobin' when 'temp' then 'temperature' else q end, ''), {words(gone("split_part(low, ':', 1)", "control", "a-z"))})
        when class = 'medication' then regexp_extract(low, '^[\\p{{L}}_]+') when class = 'diagnosis' then regexp_replace(regexp_replace(low, '^dx\\s*/\\s*', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')
        when class = 'flowsheet' then {words("split_part(low, ':', 1)")} when class = 'note' then 'note'
        else {words(gone("regexp_replace(low, '[0-9]+', ' ', 'g')", "stay|no|s", "\\p{L}_"))} end as name from q)
    select id, coalesce(class, 'none') || ':' || case when text_value is null then 'none' when name = '' then 'unnamed' else name end as type, count(*) as n,
      coalesce((any_value(latest) - max(epoch_us(time))) // 1000000, -1) as since_s, round(sum(case when numeric_value is not null and not isnan(numeric_value) then numeric_value else 0.0 end), 4) + 0.0::double as total
    from n, a group by id, type"""


RULES = """
    with r as (select id, time, text_value, numeric_value as v, min(_src) as src from demo
      where class = 'vital' and text_value is not null and numeric_value is not null and not isnan(numeric_value) group by id, time, text_value, numeric_value),
    k as (select r.*, low, high from r join plausible_limits l on lower(trim(split_part(text_value, ':', 1))) = lower(trim(quantity))),
    o as (select *, row_number() over (partition by id, text_value order by time, src) - row_number() over (partition by id, text_value, v order by time, src) as island,
        min(v) over (partition by id, text_value) <> max(v) over (partition by id, text_value) as varied from k where time is not null),
    n as (select src, varied, count(*) over (partition by id, text_value, v, island) as run from o)
    select src, 'impossible' as kind from k where v < low or v > high
    union all select src, 'stuck' from n where varied and run >= 8"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _found_units(), "p2_graph": _usual_units(), "p3_plain": _plain_cells(), "p3_totals": TOTALS, "p5_rules": RULES, "p7_found": PERIODS}
