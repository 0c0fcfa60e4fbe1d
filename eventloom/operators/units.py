"""One quantity recorded in different units: find the unit of every value and convert it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.frames import cut, first_of_repeats, pick, usable

# Other names of quantities.
QUANTITY_ALIASES = {"haemoglobin": "hemoglobin", "temp": "temperature"}

# How units are written, after lower-casing, writing the micro sign as u, "per" and
# "_" as "/", "litre" as "l" and "gm" as "g", and leaving out blanks.
UNIT_SPELLINGS = {
    "mg/dL": ["mg/dl", "mg%", "mgs/dl", "mgdl"],
    "mmol/L": ["mmol/l", "mm", "mmoll", "millimol/l"],
    "umol/L": ["umol/l", "micromol/l", "mcmol/l", "um", "umoll"],
    "g/dL": ["g/dl", "g%", "gdl", "grams/dl"],
    "g/L": ["g/l", "grams/l"],
    "degC": ["degc", "°c", "c", "celsius", "deg.c", "degreesc", "centigrade", "ºc", "deg/c"],
    "degF": ["degf", "°f", "f", "fahr.", "fahr", "fahrenheit", "deg.f", "degreesf", "ºf", "deg/f"],
    "kg": ["kg", "kgs", "kg.", "kilograms", "kilogram", "kilos", "kilo"],
    "lb": ["lb", "lbs", "lb.", "lbs.", "pounds", "pound"],
    "g": ["g", "grams", "gram", "g.", "gs"],
    "cm": ["cm", "cms", "cm.", "centimetres", "centimetre", "centimeters", "centimeter"],
    "m": ["m", "mtr", "mtr.", "mtrs", "metres", "metre", "meters", "meter", "m."],
    "in": ["in", "ins", "ins.", "in.", "inch", "inches", '"'],
    "mg": ["mg", "mg.", "mgs", "milligram", "milligrams"],
    "mcg": ["mcg", "mcg.", "mcgs", "ug", "ug.", "microgram", "micrograms"],
}

#: A patient can't have a value this many times beyond what is usual (for quantities whose
#: units differ by a shift: this many usual ranges beyond).
REACH_FACTOR, REACH_RANGES = 1.3, 0.75
#: Share of entities whose smallest and largest values are left aside on each side.
REACH_TAIL = 0.003
#: Entities that a source must share with known sources before they decide its unit.
LEAST_LINKS = 5
#: Steps of propagation through the graph of sources.
STEPS = 2
SALTS = 8
#: Sources whose units are broadcast: a row of a few short strings each.
MOST_SOURCES = 100_000
NUMBER = r"[-+]?[0-9]+(?:[.,][0-9]+)?"


def _unit_rows(units: DataFrame) -> list:
    """The conversion table, which is a table of definitions: more than 10 000 rows are refused."""
    rows = pick(units, "quantity", "unit", "factor", "shift", "common_unit").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the table of units has more than 10000 rows")
    return rows


def _low(c: Column) -> Column:
    return F.translate(F.lower(c), "µμ", "uu")


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """Map literal; the first of equal keys counts."""
    once: dict[str, str] = {}
    for k, v in pairs:
        once.setdefault(k, v)
    if not once:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in once.items() for x in kv])[key]


def quantity_pattern(rows: list) -> str:
    names = sorted({r["quantity"] for r in rows if r["quantity"]} | {a for a, q in QUANTITY_ALIASES.items() if any(r["quantity"] == q for r in rows)} - {"dose"}, key=lambda x: (-len(x), x))
    return "(?<![a-z])(" + "|".join(f"\\Q{x.lower()}\\E" for x in names if x != "dose") + ")(?![a-z])"


def quantity_name(plain: Column, rows: list) -> Column:
    """The quantity of ``units`` that a lower-cased text names, or an empty string."""
    name = F.regexp_extract(plain, quantity_pattern(rows), 1)
    return F.coalesce(_lookup(list(QUANTITY_ALIASES.items()), name), name)


def readings(events: DataFrame, units: DataFrame, distinct: bool = True) -> DataFrame:
    """Every value of a quantity of ``units``: ``src, id, quantity, stated, value``.

    ``stated`` is the code of the unit that the text names, or null. A number in the text goes
    with the unit in the text and counts before ``numeric_value``; decimal commas are read as
    points. Medication rows are the quantity ``dose`` if their text names a unit of it. Rows with
    no number in column or text, of another class or another quantity, or with null text do not
    come out. With ``distinct`` only the first of rows equal in all columns but _src counts.
    """
    rows = _unit_rows(units)
    e = pick(events, "id", "time", "class", "text_value", "numeric_value", "_src")
    e = e.filter(F.col("class").isin("lab", "vital", "medication") & F.col("text_value").isNotNull())
    named = quantity_pattern(rows)
    dose = [r["unit"] for r in rows if r["quantity"] == "dose"]
    spelled = [s for u in dose for s in UNIT_SPELLINGS.get(u, [u.lower()]) if s.rstrip(".") == s]
    mass = r"(?:(?<![a-z0-9.,])(" + NUMBER + r")\s*)?(?<![a-z])(" + "|".join(sorted(map(lambda s: f"\\Q{s}\\E", spelled), key=lambda s: (-len(s), s)) or ["$^"]) + r")(?![a-z])"
    is_dose = F.col("class") == "medication"
    t = _low(F.col("text_value"))
    e = e.filter(F.when(is_dose, t.rlike(mass)).otherwise(t.rlike(named)))
    if distinct:
        e = first_of_repeats(e, ["id", "time", "class", "text_value", "numeric_value"])
    e = e.select("_src", "id", "numeric_value", is_dose.alias("_dose"), t.alias("_t"))

    # one column at a time: an expression that is used twice would otherwise be computed twice
    e = e.withColumn("_name", F.when(~F.col("_dose"), F.regexp_extract("_t", named, 1)))
    e = e.withColumn("_rest", F.when(~F.col("_dose"), F.regexp_replace(F.replace("_t", F.col("_name"), F.lit(" ")), r"(?<![a-z])control(?![a-z])", " ")))
    e = e.withColumn("_num", F.when(F.col("_dose"), F.regexp_extract("_t", mass, 1)).otherwise(F.regexp_extract("_rest", NUMBER, 0)))
    e = e.withColumn("_left", F.when(F.col("_num") != "", F.replace("_rest", F.col("_num"), F.lit(" "))).otherwise(F.col("_rest")))
    left = F.regexp_replace("_left", r"^[\s,:;=()\[\]_-]+|[\s,:;=()\[\]_-]+$", "")
    left = F.regexp_replace(F.regexp_replace(left, r"^in\s+(?=\S)", ""), r"\s*\bper\b\s*|_", "/")
    # blanks, and what litres and grams are written with beyond l and g
    left = F.regexp_replace(left, r"\s+|(?<=l)it(?:re|er)s?|(?<=(?<![a-z])g)m", "")
    e = e.withColumn("_unit", F.when(F.col("_dose"), F.regexp_extract("_t", mass, 2)).otherwise(left))
    e = e.withColumn("quantity", F.when(F.col("_dose"), F.lit("dose")).otherwise(F.coalesce(_lookup(list(QUANTITY_ALIASES.items()), F.col("_name")), "_name")))
    code = _lookup([(f"{r['quantity']}|{s}", r["unit"]) for r in rows for s in [*UNIT_SPELLINGS.get(r["unit"], []), r["unit"].lower()]], F.concat_ws("|", "quantity", "_unit"))
    in_text = F.when(F.col("_num") != "", F.replace("_num", F.lit(","), F.lit(".")).cast("double"))
    out = e.select(F.col("_src").alias("src"), "id", "quantity", code.alias("stated"), F.coalesce(in_text, F.when(usable("numeric_value"), F.col("numeric_value"))).alias("value"))
    return out.filter(F.col("value").isNotNull())


def _conversions(units: DataFrame) -> DataFrame:
    u = pick(units, "quantity", "unit", "factor", "shift", "common_unit").filter("quantity is not null and unit is not null")
    return u.groupBy("quantity", "unit").agg(F.min_by("factor", "factor").alias("factor"), F.min_by("shift", "factor").alias("shift"), F.min("common_unit").alias("common_unit"))


def _per_entity(values: DataFrame) -> DataFrame:
    """One row per entity, quantity and stated unit. Partial sums keep hot entities harmless."""
    return values.groupBy("id", "quantity", "stated").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


def reach(per_entity: DataFrame, units: DataFrame) -> DataFrame:
    """What a patient's value can be, by quantity and unit: ``quantity, unit, low, high``.

    From the values whose unit is stated, in the common unit: the range of entities' smallest and
    largest values without the outermost REACH_TAIL of entities, widened by REACH_FACTOR (by
    REACH_RANGES ranges where units differ by a shift), and converted to each unit.
    """
    u = _conversions(units)
    shifted = u.groupBy("quantity").agg(F.max(F.abs("shift")).alias("_s"))
    known = per_entity.filter("stated is not null").join(u.withColumnRenamed("unit", "stated"), ["quantity", "stated"])
    known = known.groupBy("quantity").agg(
        F.percentile_approx(F.col("least") * F.col("factor") + F.col("shift"), REACH_TAIL, 20_000).alias("_lo"),
        F.percentile_approx(F.col("most") * F.col("factor") + F.col("shift"), 1 - REACH_TAIL, 20_000).alias("_hi"),
    ).join(shifted, "quantity")
    wide = (F.col("_hi") - F.col("_lo")) * REACH_RANGES
    known = known.select("quantity", F.when(F.col("_s") > 0, F.col("_lo") - wide).otherwise(F.col("_lo") / REACH_FACTOR).alias("_lo"), F.when(F.col("_s") > 0, F.col("_hi") + wide).otherwise(F.col("_hi") * REACH_FACTOR).alias("_hi"))
    back = lambda c: (F.col(c) - F.col("shift")) / F.col("factor")
    return u.join(known, "quantity").select("quantity", "unit", back("_lo").alias("low"), back("_hi").alias("high"))


def _label(fits: Column) -> Column:
    """The source that a value belongs to within its site: the unit its text names, or for values
    without one the units that its size allows."""
    return F.coalesce("stated", F.concat(F.lit("?"), F.array_join(F.array_sort(fits), "|")))


def _known(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values with the definitions of their quantity and ``_fits``, the units their size allows."""
    v = values.join(F.broadcast(bounds), "quantity", "left")
    fits = F.transform(F.filter("_units", lambda x: F.col("value").between(x["low"], x["high"])), lambda x: x["unit"])
    v = v.withColumn("_fits", F.coalesce(fits, F.array().cast("array<string>")))
    return v.withColumn("label", _label(F.col("_fits")))


def source_edges(values: DataFrame, units: DataFrame) -> DataFrame:
    """The graph of sources: ``site, quantity, label, to, links, scale, offset, y, x``.

    A source is a site's values of one ``label``: those whose text names one unit, or those without
    a unit whose size allows the same units. Two sources of a quantity are linked by the entities
    that occur in both; an edge leads from a source without unit to any other. Over the linked
    entities' means a robust ``scale`` (median ratio) and ``offset`` (0) are estimated, for
    quantities whose units differ by a shift from the quartiles ``y`` and ``x`` of both ends. A
    further edge, ``to`` null, leads from each source without unit to all stated values of the
    quantity in the common unit: the two ends' quartiles are compared without links.

    An entity has one row per label, of which there are at most as many as sets of units.
    """
    u = _conversions(units)
    per = values.groupBy("site", "id", "quantity", "label").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    mine = per.groupBy("site", "id", "quantity").agg(F.collect_list(F.struct("label", "mean")).alias("_l"))
    both = F.flatten(F.transform("_l", lambda y: F.transform("_l", lambda x: F.struct(y["label"].alias("label"), x["label"].alias("to"), y["mean"].alias("y"), x["mean"].alias("x")))))
    both = F.filter(both, lambda p: p["label"].startswith("?") & (p["label"] != p["to"]) & (p["x"] != 0) & (p["y"] != 0))
    pairs = mine.select("site", "quantity", F.explode(both).alias("p")).select("site", "quantity", "p.*")
    quart = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 2000)
    edges = pairs.groupBy("site", "quantity", "label", "to").agg(F.count("*").alias("links"), F.percentile_approx(F.col("x") / F.col("y"), 0.5, 2000).alias("_ratio"), quart("y").alias("y"), quart("x").alias("x"))
    common = per.join(u.select("quantity", F.col("unit").alias("label"), "factor", "shift"), ["quantity", "label"])
    pooled = common.groupBy("quantity").agg(quart(F.col("mean") * F.col("factor") + F.col("shift")).alias("x"))
    alone = per.filter(F.col("label").startswith("?")).groupBy("site", "quantity", "label").agg(F.count("*").alias("links"), quart("mean").alias("y")).join(pooled, "quantity")
    alone = alone.select("site", "quantity", "label", F.lit(None).cast("string").alias("to"), "links", (F.col("x")[1] / F.nullif(F.col("y")[1], F.lit(0.0))).alias("_ratio"), "y", "x")
    e = edges.unionByName(alone).join(u.groupBy("quantity").agg(F.max(F.abs("shift")).alias("_s")), "quantity", "left")
    spread = (F.col("x")[2] - F.col("x")[0]) / F.nullif(F.col("y")[2] - F.col("y")[0], F.lit(0.0))
    e = e.withColumn("scale", F.when((F.col("_s") > 0) & (spread > 0), spread).otherwise(F.col("_ratio")))
    return e.select("site", "quantity", "label", "to", "links", "scale", F.when(F.col("_s") > 0, F.col("x")[1] - F.col("scale") * F.col("y")[1]).otherwise(F.lit(0.0)).alias("offset"), "y", "x", (F.col("_s") > 0).alias("_shifted"))


def _snapped(edges: DataFrame, anchors: DataFrame, units: DataFrame) -> DataFrame:
    """The unit of each source from its edges to anchored sources (``site, quantity, to, unit``):
    every known conversion is compared with the edge's scale and offset, and the one nearest over
    all edges, weighted by their links, is taken. ``site, quantity, label, unit, links, residual,
    next``; next is the residual of the second nearest."""
    u = _conversions(units)
    known = u.select("quantity", F.col("unit").alias("_u"), F.col("factor").alias("_fu"), F.col("shift").alias("_su"))
    at = u.select("quantity", "unit", F.col("factor").alias("_fw"), F.col("shift").alias("_sw"))
    ends = anchors.join(at, ["quantity", "unit"]).select(F.col("site").alias("_site"), F.col("quantity").alias("_q"), F.col("to").alias("_to"), "_fw", "_sw")
    e = edges.join(ends, F.col("site").eqNullSafe(F.col("_site")) & (F.col("quantity") == F.col("_q")) & (F.col("to") == F.col("_to"))).drop("_site", "_q", "_to")
    return _nearest(e.join(known, "quantity"))


def _nearest(tried: DataFrame) -> DataFrame:
    """Of the conversions tried on each edge the nearest per source."""
    factor, shift = F.col("_fu") / F.col("_fw"), (F.col("_su") - F.col("_sw")) / F.col("_fw")
    off = sum((F.abs(F.col("x")[i] - (F.col("y")[i] * factor + shift)) for i in range(3)), F.lit(0.0)) / (3 * F.abs(F.nullif(F.col("x")[1], F.lit(0.0))))
    cost = F.when(F.col("_shifted"), off).otherwise(F.abs(F.log(F.col("scale") / factor)))
    cost = F.least(F.coalesce(F.nanvl(cost, F.lit(9.0)), F.lit(9.0)), F.lit(9.0))
    t = tried.groupBy("site", "quantity", "label", "_u").agg(F.sum("links").alias("links"), (F.sum(cost * F.col("links")) / F.sum("links")).alias("residual"))
    best = t.groupBy("site", "quantity", "label").agg(F.max("links").alias("links"), F.array_sort(F.collect_list(F.struct("residual", F.col("_u").alias("unit")))).alias("_b"))
    return best.select("site", "quantity", "label", F.col("_b")[0]["unit"].alias("unit"), "links", F.col("_b")[0]["residual"].alias("residual"), F.coalesce(F.get("_b", F.lit(1))["residual"], F.lit(9.0)).alias("next"))


def source_units(edges: DataFrame, units: DataFrame) -> DataFrame:
    """The unit of each source without one, found by propagation through the graph: ``site,
    quantity, label, unit, links, residual, next, step``.

    Sources whose text names a unit are the anchors. In step 1 sources with LEAST_LINKS entities in
    common with anchors take the nearest known conversion; in the following steps sources that are
    so linked with those solved before. What no step reaches is compared with all stated
    values of the quantity (step 0). ``edges`` should be a table of its own (``cut``): it has a row
    per pair of sources, however many values there are.
    """
    u = _conversions(units)
    anchors = edges.filter("to is not null and not startswith(to, '?')").select("site", "quantity", "to").distinct().withColumn("unit", F.col("to"))
    found: DataFrame | None = None
    for step in range(1, STEPS + 1):
        now = _snapped(edges, anchors, units).filter(F.col("links") >= LEAST_LINKS).withColumn("step", F.lit(step))
        if found is not None:
            before = found.select(F.col("site").alias("_site"), F.col("quantity").alias("_q"), F.col("label").alias("_label"))
            now = now.join(before, F.col("site").eqNullSafe(F.col("_site")) & (F.col("quantity") == F.col("_q")) & (F.col("label") == F.col("_label")), "left_anti")
        found = now if found is None else found.unionByName(now)
        anchors = now.select("site", "quantity", F.col("label").alias("to"), "unit")
    one = edges.filter("to is null").withColumn("_fw", F.lit(1.0)).withColumn("_sw", F.lit(0.0))
    rest = _nearest(one.join(u.select("quantity", F.col("unit").alias("_u"), F.col("factor").alias("_fu"), F.col("shift").alias("_su")), "quantity")).withColumn("step", F.lit(0))
    all_ = found.unionByName(rest)
    pick_first = F.min_by(F.struct("unit", "links", "residual", "next", "step"), F.when(F.col("step") == 0, STEPS + 1).otherwise(F.col("step")))
    return all_.groupBy("site", "quantity", "label").agg(pick_first.alias("b")).select("site", "quantity", "label", "b.*")


def harmonise(events: DataFrame, entities: DataFrame, units: DataFrame, site_units: DataFrame) -> DataFrame:
    """Every value in its recorded and in the common unit:
    ``src, id, quantity, value, recorded, unit, common_value, common_unit``.

    ``unit`` is the one that the text names, and otherwise the one that the graph of sources gives
    to the value's source (``source_units``). ``recorded`` is that unit after an exact check by the
    definitions: the usual unit of the entity's site in ``site_units`` if a patient can have the
    value in it, or else the only unit that the value's size allows. Where the graph has fewer
    than LEAST_LINKS links for a source and the check gives another unit, the check's counts for
    both; where the check contradicts a linked source or gives none, ``recorded`` is null. Of
    repeated definitions of a site's unit the first in order of the code counts. Values are never
    dropped: without any unit ``common_value`` is null.

    Ids meet their site in a join salted by _src, so one id may hold any share of the rows; what
    is found for sources is broadcast while there are at most MOST_SOURCES of them and else joined
    with as many salts.
    """
    site = pick(entities, "id", "site").groupBy("id").agg(F.min("site").alias("site"))
    site = site.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    v = readings(events, units).withColumn("_salt", F.pmod(F.hash("src"), F.lit(SALTS)))
    v = cut(v.join(site, ["id", "_salt"], "left"))
    # definitions per quantity and unit: as small as the table of units, which is checked
    r = reach(_per_entity(v), units)
    bounds = _conversions(units).join(r, ["quantity", "unit"], "left").groupBy("quantity").agg(F.collect_list(F.struct("unit", "factor", "shift", "low", "high", "common_unit")).alias("_units"))
    bounds = cut(bounds)
    v = _known(v, bounds)
    usual = pick(site_units, "site", "quantity", "unit").groupBy("site", "quantity").agg(F.min("unit").alias("_usual"))
    sources = source_units(cut(source_edges(v, units)), units)
    sources = cut(sources.join(usual, ["site", "quantity"], "left").select(F.col("site").alias("_site"), F.col("quantity").alias("_q"), F.col("label").alias("_label"), F.col("unit").alias("_graph"), (F.col("step") > 0).alias("_sure"), "_usual"))
    same = F.col("site").eqNullSafe(F.col("_site")) & (F.col("quantity") == F.col("_q")) & (F.col("label") == F.col("_label"))
    if sources.count() <= MOST_SOURCES:
        v = v.join(F.broadcast(sources), same, "left")
    else:
        salted = sources.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        v = v.join(salted, same & (F.col("_salt") == F.col("_part")), "left")
    rule = F.when(F.array_contains("_fits", F.col("_usual")), F.col("_usual")).when(F.size("_fits") == 1, F.get("_fits", F.lit(0)))
    v = v.withColumn("_rule", rule)
    v = v.withColumn("unit", F.coalesce("stated", F.when(F.coalesce("_sure", F.lit(False)), F.col("_graph")), "_rule", "_graph"))
    v = v.withColumn("recorded", F.coalesce("stated", F.when(F.col("unit") == F.col("_rule"), F.col("unit"))))
    v = v.withColumn("_one", F.filter("_units", lambda x: x["unit"] == F.col("unit"))[0])
    return v.select("src", "id", "quantity", "value", "recorded", "unit", (F.col("value") * F.col("_one.factor") + F.col("_one.shift")).alias("common_value"), F.col("_units")[0]["common_unit"].alias("common_unit"))


def site_usual_units(events: DataFrame, entities: DataFrame, units: DataFrame) -> DataFrame:
    """The unit in which each site records a quantity when it states none, from the graph alone:
    ``site, quantity, unit, links``; the unit that most linked entities have, or if sources share
    too few entities with others, the one nearest to all stated values (links 0). Null sites don't
    come out."""
    site = pick(entities, "id", "site").groupBy("id").agg(F.min("site").alias("site"))
    v = cut(readings(events, units).join(site, "id").filter("site is not null"))
    bounds = cut(_conversions(units).join(reach(_per_entity(v), units), ["quantity", "unit"], "left").groupBy("quantity").agg(F.collect_list(F.struct("unit", "factor", "shift", "low", "high", "common_unit")).alias("_units")))
    s = source_units(cut(source_edges(_known(v, bounds), units)), units)
    s = s.groupBy("site", "quantity", "unit").agg(F.sum(F.when(F.col("step") > 0, F.col("links")).otherwise(F.lit(0))).alias("links"), F.sum("links").alias("_n"))
    return s.groupBy("site", "quantity").agg(F.max_by("unit", F.struct("links", "_n", "unit")).alias("unit"), F.max("links").alias("links"))


def foreign_units(events: DataFrame, entities: DataFrame, units: DataFrame, site_units: DataFrame) -> DataFrame:
    """The values recorded in another unit than the common one: ``src, unit``."""
    h = harmonise(events, entities, units, site_units)
    return h.filter("recorded is not null and recorded <> common_unit").select("src", F.col("recorded").alias("unit"))
