"""Frequency of every term, by heavy-light aggregation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.frames import pick

#: Candidates that a task keeps while it looks for heavy terms: any term with more than one in
#: KEEP of the task's occurrences is among them.
KEEP = 4096
#: Heavy terms at most; they are collected and sent to all tasks. Only speed depends on it.
HEAVY = 2048
#: Rows whose light terms are added up before they are sent on.
FOLD_ROWS = 500_000
#: A term of more than this share of its class's records is common; of at most RARE records, rare.
COMMON, RARE = 0.25, 2

RUN = regex.compile(r"[\p{L}\p{N}]+")


def terms_of(text: str) -> list[str]:
    """Longest runs of letters and digits of the lower-cased text that have two or more characters
    and start with a letter, in order, with repeats."""
    return [m for m in RUN.findall(text.lower()) if len(m) > 1 and m[0].isalpha()]


def _counts(batch: pa.RecordBatch) -> tuple[dict[tuple, int], dict[tuple, int], dict]:
    """Occurrences and records of each (group, term), and records of each group. A text that
    repeats within the batch is taken apart once."""
    occurs: dict[tuple, int] = defaultdict(int)
    records: dict[tuple, int] = defaultdict(int)
    rows: dict = defaultdict(int)
    g = pc.dictionary_encode(batch.column(0), null_encoding="encode")
    t = pc.dictionary_encode(batch.column(1))
    groups, texts = g.dictionary.to_pylist(), t.dictionary.to_pylist()
    code, n = np.unique(t.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(groups)) + g.indices.to_numpy(zero_copy_only=False), return_counts=True)
    for c, k in zip(code.tolist(), n.tolist()):
        group = groups[c % len(groups)]
        rows[group] += k
        seen = terms_of(texts[c // len(groups)])
        for x in seen:
            occurs[group, x] += k
        for x in set(seen):
            records[group, x] += k
    return occurs, records, rows


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries summary of the task's terms."""
    kept: dict[tuple, int] = {}
    for b in batches:
        for x, k in _counts(b)[0].items():
            kept[x] = kept.get(x, 0) + k
        if len(kept) > KEEP:
            over = sorted(kept.values(), reverse=True)[KEEP]
            kept = {x: k - over for x, k in kept.items() if k > over}
    yield pa.RecordBatch.from_pydict({"g": pa.array([x[0] for x in kept], pa.string()), "term": pa.array([x[1] for x in kept], pa.string()), "n": pa.array(list(kept.values()), pa.int64())})


def heavy_terms(df: DataFrame, group: str, text: str, most: int = HEAVY) -> list[tuple]:
    """(group, term) of the terms that occur most, at most ``most``, found over all rows."""
    t = pick(df, group, text).toDF("g", "t").filter("t is not null").withColumn("g", F.col("g").cast("string"))
    found = t.mapInArrow(_candidates, "g string, term string, n long").groupBy("g", "term").agg(F.sum("n").alias("n"))
    return [(r["g"], r["term"]) for r in found.orderBy(F.desc("n"), "g", "term").limit(most).collect()]


def _counter(heavy: list[tuple]):
    index = {x: i for i, x in enumerate(heavy)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        light_o: dict[tuple, int] = defaultdict(int)
        light_r: dict[tuple, int] = defaultdict(int)
        rows = 0

        def emit(keys: list[tuple], o: list[int], r: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"g": pa.array([k[0] for k in keys], pa.string()), "term": pa.array([k[1] for k in keys], pa.string()), "occurrences": pa.array(o, pa.int64()), "records": pa.array(r, pa.int64())})

        def light() -> Iterator[pa.RecordBatch]:
            keys = list(light_o)
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield emit(part, [light_o[k] for k in part], [light_r[k] for k in part])

        for b in batches:
            o, r, _ = _counts(b)
            for x, k in o.items():
                i = index.get(x)
                if i is None:
                    light_o[x] += k
                    light_r[x] += r[x]
                else:
                    occurs[i] += k
                    records[i] += r[x]
            rows += b.num_rows
            if rows >= FOLD_ROWS or len(light_o) > FOLD_ROWS:
                yield from light()
                light_o.clear()
                light_r.clear()
                rows = 0
        yield from light()
        some = np.flatnonzero(occurs)
        if len(some):
            yield emit([heavy[i] for i in some], occurs[some].tolist(), records[some].tolist())

    return run


def term_counts(df: DataFrame, group: str, text: str, heavy: list[tuple] | None = None) -> DataFrame:
    """Every term of each group: ``group, term, occurrences, records``.

    The heavy terms (by default found in ``df``) are counted in arrays, one per task; the others
    are added up over a batch of rows and shuffled. Both tables are united by adding up. Rows with
    null text are no records; a null group is a group of its own; empty texts are records without
    terms; every repeated row counts. Groups are compared as strings.
    """
    heavy = heavy_terms(df, group, text) if heavy is None else heavy
    t = pick(df, group, text).toDF("g", "t").filter("t is not null").withColumn("g", F.col("g").cast("string"))
    counted = t.mapInArrow(_counter(heavy), "g string, term string, occurrences long, records long")
    return counted.groupBy("g", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).withColumnRenamed("g", group)


def marked_terms(df: DataFrame, group: str, text: str, heavy: list[tuple] | None = None, common: float = COMMON, rare: int = RARE) -> DataFrame:
    """``term_counts`` with ``mark``: ``common`` for terms in more than ``common`` of the records
    of their group, otherwise ``rare`` for terms in at most ``rare`` records, otherwise null."""
    counts = term_counts(df, group, text, heavy)
    total = pick(df, group, text).toDF("g", "t").filter("t is not null").groupBy(F.col("g").cast("string").alias("_g")).agg(F.count("*").alias("_all"))
    marked = counts.join(total, counts[group].eqNullSafe(total["_g"]))
    mark = F.when(F.col("records") > common * F.col("_all"), "common").when(F.col("records") <= rare, "rare")
    return marked.select(group, "term", "occurrences", "records", mark.alias("mark"))


def event_terms(events: DataFrame) -> DataFrame:
    """Terms of the distinct rows of an event table, by class. The heavy terms are looked for in
    all rows, repeats included, which spares a second removal of repeats."""
    e = pick(events, "id", "time", "class", "text_value", "numeric_value").filter("text_value is not null")
    return marked_terms(e.distinct(), "class", "text_value", heavy_terms(e, "class", "text_value"))
