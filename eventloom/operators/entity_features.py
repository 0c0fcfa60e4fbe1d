"""One row per entity with count, recency and total for each event type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.frames import cut, epoch_us, first_of_repeats, pick, usable
from eventloom.operators.units import _unit_rows, quantity_name

#: Event types with a place in the dense arrays at most, the most frequent; cells of rarer types
#: stand in a sparse list beside them, so none is lost.
MAX_TYPES = 4096
#: Names that are broadcast to find their type; with more, only the most frequent are, and rows with
#: others meet their type by a shuffle.
MAX_NAMES = 100_000
#: Letters of a name at most that is taken for a misspelling; longer ones stay types of their own.
SLIP_LETTERS = 64
#: A name is compared with names at least so many times as frequent, to see whether it is a
#: misspelling of one of them.
SLIP_RATIO = 20
#: Rows of a bucket that are scattered at once, and entities in a dense block.
BLOCK_ROWS, BLOCK_IDS = 500_000, 256


def event_name(units: DataFrame) -> Column:
    """What a row's text names, as one lower-case word with underscores.

    Quantities of ``units`` lose number, unit and device; other lab and vital rows the device; drugs lose dose, route and frequency; diagnoses are
    their code without dots and blanks; flowsheet rows are the item before the colon; admissions
    and discharges lose the stay number; notes are one type. Null text is ``none``.
    """
    t = F.col("text_value")
    low = F.lower(F.trim(t))
    words = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    quantity = F.nullif(quantity_name(low, _unit_rows(units)), F.lit(""))
    other = words(F.regexp_replace(F.substring_index(low, ":", 1), r"(?<![a-z])control(?![a-z])", " "))
    name = (
        F.when(F.col("class").isin("lab", "vital"), F.coalesce(quantity, other))
        .when(F.col("class") == "medication", F.regexp_extract(low, r"^[\p{L}_]+", 0))
        .when(F.col("class") == "diagnosis", F.regexp_replace(F.regexp_replace(low, r"^dx\s*/\s*", ""), r"[^\p{L}\p{N}]+", ""))
        .when(F.col("class") == "flowsheet", words(F.substring_index(low, ":", 1)))
        .when(F.col("class") == "note", F.lit("note"))
        .otherwise(words(F.regexp_replace(F.regexp_replace(low, r"[0-9]+", " "), r"(?<![\p{L}_])(?:stay|no|s)(?![\p{L}_])", " ")))
    )
    return F.when(t.isNull(), F.lit("none")).when(name == "", F.lit("unnamed")).otherwise(name)


def _slips(names: DataFrame, quantities: list[str]) -> DataFrame:
    """``class, name, other``: names one slip away from one SLIP_RATIO times as frequent.

    Two names one slip apart share a form with at most one letter left out, so names meet in a join
    on these forms instead of being compared with each other.
    """
    some = names.filter((F.col("class") != "diagnosis") & F.length("name").between(2, SLIP_LETTERS))
    spots = F.sequence(F.lit(0), F.length("name"))
    forms = F.array_distinct(F.transform(spots, lambda i: F.concat(F.substring("name", 1, i), F.substring("name", i + 2, F.lit(SLIP_LETTERS)))))
    forms = some.select("class", "name", "count", F.explode(forms).alias("_form"))
    other = forms.select(F.col("class").alias("_c"), F.col("name").alias("other"), F.col("count").alias("_k"), F.col("_form").alias("_f"))
    met = forms.filter(~F.col("name").isin(*quantities)) if quantities else forms
    met = met.join(other, (F.col("class") == F.col("_c")) & (F.col("_form") == F.col("_f")) & (F.col("_k") >= SLIP_RATIO * F.col("count"))).select("class", "name", "other").distinct()
    swapped = F.exists(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.concat(F.substring("name", 1, i - 1), F.substring("name", i + 1, F.lit(1)), F.substring("name", i, F.lit(1)), F.substring("name", i + 2, F.lit(SLIP_LETTERS))) == F.col("other"))
    return met.filter((F.levenshtein("name", "other") <= 1) | swapped)


def _alike(events: DataFrame, units: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Those of the pairs ``class, name, other`` whose rare rows could be a random sample of the
    frequent ones, as misspelled rows are.

    Values, in steps of 1/16 octave with missing ones as a step of their own, must pass a
    Kolmogorov-Smirnov test at 0.1 % and but for one in a hundred lie in steps that the frequent
    name has. As many rare rows must be of ids that have the frequent name as there are frequent
    rows of ids that have two, less three standard errors. A pair for which neither a value nor an
    id speaks is not alike.
    """
    v = F.when(usable("numeric_value"), F.col("numeric_value"))
    step = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 16) + 20_000)).cast("int")
    mine = pairs.select("class", F.explode(F.array("name", "other")).alias("name")).distinct()
    # never null, else the join would test the name for null and so compute it twice
    name = F.coalesce(event_name(units), F.lit("none")).alias("name")
    e = pick(events, "id", "class", "text_value", "numeric_value").select("id", F.coalesce("class", F.lit("none")).alias("class"), name, step.alias("_v"))
    small = F.broadcast if n_pairs <= MAX_NAMES else lambda x: x
    cells = cut(e.join(small(mine), ["class", "name"], "left_semi").groupBy("class", "name", "id", "_v").agg(F.count("*").alias("k")))
    spread = cells.groupBy("class", "name", "_v").agg(F.sum("k").alias("k"))
    ids = cells.groupBy("class", "name", "id").agg(F.sum("k").alias("k"))
    frequent = ids.groupBy("class", F.col("name").alias("other")).agg(F.sum("k").alias("_all"), F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("_twice"))
    pairs = small(pairs)
    a = pairs.join(spread, ["class", "name"]).select("class", "name", "other", "_v", F.col("k").alias("a"), F.lit(0).cast("long").alias("b"))
    b = pairs.join(spread.withColumnRenamed("name", "other"), ["class", "other"]).select("class", "name", "other", "_v", F.lit(0).cast("long").alias("a"), F.col("k").alias("b"))
    by = ["class", "name", "other"]
    both = a.unionByName(b).groupBy(*by, "_v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a pair has at most as many steps as doubles have sixteenths of octaves
    pair = Window.partitionBy(*by)
    so_far = pair.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_gap", F.abs(F.sum("a").over(so_far) / F.sum("a").over(pair) - F.sum("b").over(so_far) / F.sum("b").over(pair)))
    test = both.groupBy(*by).agg(F.max("_gap").alias("_gap"), F.sum("a").alias("_k"), F.sum("b").alias("_m"), F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("_strange"), F.max(F.col("_v").isNotNull() & (F.col("a") > 0)).alias("_values"))
    rare, has = pairs.join(ids, ["class", "name"]), ids.select(F.col("class").alias("_c"), F.col("name").alias("_o"), F.col("id").alias("_id"))
    met = rare.join(has, (F.col("class") == F.col("_c")) & (F.col("other") == F.col("_o")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").groupBy(*by).agg(F.sum("k").alias("_met"))
    t = test.join(frequent, ["class", "other"]).join(met, by, "left").na.fill({"_met": 0, "_twice": 0})
    share = F.col("_twice") / F.col("_all")
    calm = (F.col("_gap") <= 1.95 * F.sqrt(1 / F.col("_k") + 1 / F.col("_m"))) & (F.col("_strange") <= F.floor(F.col("_k") / 100))
    known = (F.col("_met") >= F.col("_k") * share - 3 * F.sqrt(F.col("_k") * share * (1 - share))) & ((F.col("_met") > 0) | F.col("_values"))
    return t.filter(calm & known).select(*by, F.col("_m").alias("_weight"))


def type_table(events: DataFrame, units: DataFrame, max_types: int = MAX_TYPES, fold: bool = True) -> tuple[list[str], DataFrame]:
    """The event types with a place in the arrays, in order of name, and the table ``class, name,
    count, type, type_name`` with the type of every name.

    Counts cover all rows, and nothing but the ``max_types`` most frequent types comes to the
    driver; ``type`` is the place in the arrays, or for rarer types a number above. With ``fold``
    a name one slip away from one SLIP_RATIO times as frequent is a misspelling of it if its rows
    look like a sample of the other's (``_alike``); codes of diagnoses, quantities of ``units`` and
    names of more than SLIP_LETTERS letters are never taken for misspellings.
    """
    # texts repeat: they are counted first and named once each
    texts = pick(events, "class", "text_value").groupBy("class", "text_value").count()
    named = texts.select(F.coalesce("class", F.lit("none")).alias("class"), event_name(units).alias("name"), "count")
    names = cut(named.groupBy("class", "name").agg(F.sum("count").alias("count")))
    target = names.withColumn("into", F.col("name"))
    if fold:
        quantities = sorted({r["quantity"] for r in _unit_rows(units) if r["quantity"]})
        pairs = cut(_slips(names, quantities))
        if n_pairs := pairs.count():
            into = cut(_alike(events, units, pairs, n_pairs).groupBy("class", "name").agg(F.max_by("other", F.struct("_weight", "other")).alias("into")))
            # each name is SLIP_RATIO times as rare as what it is folded into, so eight steps reach the end
            for _ in range(3):
                further = into.select(F.col("class").alias("_c"), F.col("name").alias("_n"), F.col("into").alias("_i"))
                into = into.join(further, (F.col("class") == F.col("_c")) & (F.col("into") == F.col("_n")), "left").select("class", "name", F.coalesce("_i", "into").alias("into"))
            target = names.join(into, ["class", "name"], "left").withColumn("into", F.coalesce("into", "name"))
    target = cut(target.withColumn("type_name", F.concat_ws(":", "class", "into")))
    own = target.groupBy("type_name").agg(F.sum("count").alias("_k"))
    dense = sorted(r["type_name"] for r in own.orderBy(F.desc("_k"), "type_name").limit(max_types).collect())
    place = events.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dense)], "type_name string, _place long")
    own = cut(own.join(F.broadcast(place), "type_name", "left").withColumn("type", F.coalesce("_place", F.monotonically_increasing_id() + len(dense))))
    return dense, target.join(own.select("type_name", "type"), "type_name").select("class", "name", "count", "type", "type_name")


def _folded(t: pa.Table) -> pa.RecordBatch:
    """One row per entity and type: rows added up, the latest time, values added up."""
    entity = pc.dictionary_encode(t.column("_id").combine_chunks(), null_encoding="encode")
    types, which = np.unique(t.column("_type").to_numpy(), return_inverse=True)
    width = max(1, len(types))
    code = entity.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + which
    cells, slot = np.unique(code, return_inverse=True)
    last = np.full(len(cells), np.iinfo(np.int64).min)
    np.maximum.at(last, slot, t.column("_t").to_numpy())
    n = t.column("_n").to_numpy() if "_n" in t.column_names else None
    return pa.RecordBatch.from_pydict({
        "_id": entity.dictionary.take(pa.array(cells // width)), "_type": pa.array(types[cells % width], pa.int64()), "_n": pa.array(np.bincount(slot, weights=n, minlength=len(cells)).astype(np.int64)),
        "_t": pa.array(last, pa.int64()), "_v": pa.array(np.bincount(slot, weights=t.column("_v").to_numpy(), minlength=len(cells)), pa.float64()),
    })


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: rows of (_id, _type, _t, _v) to one row per entity and type in a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield _folded(pa.Table.from_batches(held))
            held = []
    if held:
        yield _folded(pa.Table.from_batches(held))


def _blocks(width: int, now: int):
    """Reduce side: cells sorted by entity to dense blocks of BLOCK_IDS entities by the first
    ``width`` types, and lists of the cells of further types."""
    none = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def dense(t: pa.Table) -> Iterator[pa.RecordBatch]:
            entity = pc.dictionary_encode(t.column("_id").combine_chunks(), null_encoding="encode")
            ids, which = entity.dictionary, entity.indices.to_numpy(zero_copy_only=False)
            kind, n, when, v = (t.column(c).to_numpy() for c in ("_type", "_n", "_t", "_v"))
            since_of = lambda x: pa.array((now - x) // 1_000_000, pa.int64(), mask=x == none)
            common = kind < width
            flat = which.astype(np.int64) * width + kind
            for a in range(0, len(ids), BLOCK_IDS):
                b = min(len(ids), a + BLOCK_IDS)
                here = (which >= a) & (which < b)
                mine = here & common
                f, cells = flat[mine] - a * width, (b - a) * width
                counts = np.bincount(f, weights=n[mine], minlength=cells).astype(np.int64)
                last = np.full(cells, none)
                np.maximum.at(last, f, when[mine])
                total = np.bincount(f, weights=v[mine], minlength=cells)
                offsets = pa.array(np.arange(0, cells + 1, width), pa.int32())
                rows = np.bincount(which[here] - a, weights=n[here], minlength=b - a).astype(np.int64)
                more = pa.Table.from_arrays([pa.array(x[here & ~common]) for x in (which - a, kind, n, when, v)], ["_id", "_type", "_n", "_t", "_v"])
                rare = _folded(more)
                begin = np.searchsorted(rare.column(0).to_numpy(), np.arange(b - a + 1))
                rest = pa.StructArray.from_arrays([rare.column(1), rare.column(2), since_of(rare.column(3).to_numpy()), rare.column(4)], ["type", "n", "since_s", "total"])
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(a, b - a), "n_rows": pa.array(rows, pa.int64()), "n": pa.ListArray.from_arrays(offsets, pa.array(counts)),
                    "since_s": pa.ListArray.from_arrays(offsets, since_of(last)), "total": pa.ListArray.from_arrays(offsets, pa.array(total, pa.float64())),
                    "rest": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rest),
                })

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK_ROWS // 4:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("_id").combine_chunks()
            tail = ids[len(ids) - 1]
            same = pc.fill_null(pc.equal(ids, tail), False) if tail.is_valid else pc.is_null(ids)
            begun = int(pc.index(same, True).as_py())
            if begun:
                yield from dense(t.slice(0, begun))
            # what came of the last entity so far is folded to a row per type
            held = [_folded(t.slice(begun))]
        if held:
            yield from dense(pa.Table.from_batches(held))

    return run


def typed_events(events: DataFrame, units: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct rows as ``_id, _type, _t, _v``."""
    spark = events.sparkSession
    e = first_of_repeats(pick(events, "id", "time", "class", "text_value", "numeric_value", "_src"), ["id", "time", "class", "text_value", "numeric_value"])
    least = -(2**63)
    e = e.select(
        F.col("id").alias("_id"), F.coalesce("class", F.lit("none")).alias("_c"), event_name(units).alias("_n"), F.coalesce(epoch_us("time", spark), F.lit(least)).alias("_t"),
        F.when(usable("numeric_value"), F.col("numeric_value")).otherwise(F.lit(0.0)).alias("_v"),
    )
    named = types.select(F.col("class").alias("_c"), F.col("name").alias("_n"), F.col("type").alias("_type"), "count")
    out = ["_id", F.col("_type").cast("long").alias("_type"), "_t", "_v"]
    if named.limit(MAX_NAMES + 1).count() <= MAX_NAMES:
        # every name has a type; an inner join would test the name for null and so compute it twice
        return e.join(F.broadcast(named.drop("count")), ["_c", "_n"], "left").select(*out)
    often = cut(named.orderBy(F.desc("count"), "_c", "_n").limit(MAX_NAMES))
    e = e.join(F.broadcast(often.drop("count")), ["_c", "_n"], "left")
    seldom = named.drop("count").join(often.select("_c", "_n"), ["_c", "_n"], "left_anti")
    return e.filter("_type is not null").select(*out).unionByName(e.filter("_type is null").drop("_type").join(seldom, ["_c", "_n"]).select(*out))


def entity_features(events: DataFrame, units: DataFrame, as_of_us: int | None = None, max_types: int = MAX_TYPES, layout: str = "arrays", fold: bool = True) -> DataFrame:
    """One row per id: ``id, n_rows`` and for the ``max_types`` most frequent event types, in order
    of their names, the arrays ``n`` (rows), ``since_s`` (seconds from the latest row to
    ``as_of_us``, by default the latest time of the table; null if there is none) and ``total`` (sum
    of the numeric values; null and NaN add nothing). ``rest`` lists the cells of rarer types as
    (type, n, since_s, total), by the numbers of ``type_table``. ``layout="columns"`` gives columns
    ``n__TYPE, since_s__TYPE, total__TYPE`` instead of the arrays. ``feature_names(...)`` has
    the types in order.

    Of rows equal in all columns but _src one counts. Null id is an entity of its own. Rows without
    time count but have no recency. An empty table gives an empty table.

    Rows are folded by entity and type in numpy where they lie, so that an entity with any share
    of all rows sends a few hundred cells per task; cells then meet in the entity's hash bucket,
    where bincount and a maximum scatter fill dense blocks.
    """
    return _features(events, units, type_table(events, units, max_types, fold), as_of_us, layout)


def _features(events: DataFrame, units: DataFrame, table: tuple[list[str], DataFrame], as_of_us: int | None, layout: str = "arrays") -> DataFrame:
    names, types = table
    if as_of_us is None:
        as_of_us = pick(events, "time").agg(F.max(epoch_us("time", events.sparkSession))).first()[0] or 0
    cells = typed_events(events, units, types).mapInArrow(_cells, "_id long, _type long, _n long, _t long, _v double")
    cells = cells.repartition(F.xxhash64("_id")).sortWithinPartitions("_id")
    rest = "array<struct<type:long,n:long,since_s:long,total:double>>"
    out = cells.mapInArrow(_blocks(max(1, len(names)), as_of_us), f"id long, n_rows long, n array<long>, since_s array<long>, total array<double>, rest {rest}")
    if layout == "columns":
        return out.select("id", "n_rows", *[F.col(a)[i].alias(f"{a}__{n}") for i, n in enumerate(names) for a in ("n", "since_s", "total")], "rest")
    return out


def feature_names(events: DataFrame, units: DataFrame, max_types: int = MAX_TYPES) -> list[str]:
    """The event types behind the positions of the arrays of ``entity_features``."""
    return type_table(events, units, max_types)[0]


def feature_cells(events: DataFrame, units: DataFrame, as_of_us: int | None = None, max_types: int = MAX_TYPES, fold: bool = True) -> DataFrame:
    """The filled cells of ``entity_features``: ``id, type, n, since_s, total``, with the names of
    all types."""
    table = names, types = type_table(events, units, max_types, fold)
    wide = _features(events, units, table, as_of_us)
    z = wide.select("id", F.explode(F.arrays_zip(F.lit(names) if names else F.array(), "n", "since_s", "total")).alias("x"))
    z = z.select("id", "x.*").toDF("id", "type", "n", "since_s", "total").filter("n > 0")
    rare = wide.select("id", F.explode("rest").alias("x")).select("id", "x.*").join(types.select("type", "type_name").distinct(), "type")
    return z.unionByName(rare.select("id", F.col("type_name").alias("type"), "n", "since_s", "total"))
