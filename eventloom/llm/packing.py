"""Containers of fixed capacity filled with items of varying length: best-two-fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.frames import cut, pick
from eventloom.llm.tokenizer import VOCABULARY, token_counts

#: Items that one task packs. More items are packed in blocks; containers that a block leaves
#: unfilled are opened again and their items packed together with those of other blocks.
BLOCK = 50_000
#: A container filled to this share stays closed.
FULL = 0.995
#: What is left open is packed again only if the block closed at least the other part of its items.
STALLED = 0.5


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item. Sizes are 0 to capacity; those of 0 go into the
    first container.

    A container is filled greedily, always with the largest item that fits. Then its smallest item
    is replaced by two unpacked items that fill the gap it leaves, and the gap there was, more
    tightly; that is repeated while it helps. Items of one size are interchangeable, so the
    work is on the distinct sizes, of which there are at most ``capacity``.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    waiting: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        waiting.setdefault(int(sizes[i]), []).append(i)
    waiting.pop(0, None)
    left = sorted(waiting)

    def take(size: int) -> int:
        item = waiting[size].pop()
        if not waiting[size]:
            del waiting[size]
            left.pop(bisect_left(left, size))
        return item

    def put(size: int, item: int) -> None:
        if size not in waiting:
            waiting[size] = []
            insort(left, size)
        waiting[size].append(item)

    def pair(room: int, more_than: int) -> tuple[int, int] | None:
        """Two waiting sizes with the largest sum up to room and above more_than."""
        best, found = more_than, None
        lo, hi = 0, bisect_right(left, room) - 1
        while lo <= hi and best < room:
            s = left[lo] + left[hi]
            if s > room:
                hi -= 1
            elif lo == hi and len(waiting[left[lo]]) < 2:
                break
            else:
                if s > best:
                    best, found = s, (left[lo], left[hi])
                lo += 1
        return found

    container = 0
    while left:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while left:
            at = bisect_right(left, gap) - 1
            if at < 0:
                break
            size = left[at]
            inside.append((size, take(size)))
            gap -= size
        while gap and left:
            size, item = inside[-1]
            two = pair(gap + size, size)
            if two is None:
                break
            inside.pop()
            inside += sorted(((s, take(s)) for s in two), reverse=True)
            inside.sort(reverse=True)
            gap += size - sum(two)
            put(size, item)
        for _, item in inside:
            out[item] = container
        container += 1
    return out


def packed(items: DataFrame, containers: DataFrame, key: str, size: str, block: int = BLOCK) -> DataFrame:
    """Every item in a container of each kind: ``container_kind, container_id, KEY, copy, part,
    first, n``. ``containers`` has ``container_kind`` and ``capacity_tokens`` (a table of
    definitions: more than 1000 rows are refused; null or non-positive capacities are left out).

    Only an item larger than the capacity is split: into parts of the full capacity and a rest;
    ``first`` is where the part begins in the item and ``n`` its size. Items of size 0 are in a
    container of their block; items of null size have none (``container_id`` null). Rows of equal
    key and size are ``copy`` 0, 1, ...; every row comes out once per kind. An empty table gives
    an empty table.

    Blocks of ``block`` items on average are drawn by a hash and packed independently, each kind in
    as many as its items need. What they leave in containers that are not full is packed again in
    as many blocks as that needs, until one is enough, so space is lost at the end of one block only.
    If more than the share STALLED stays in such containers, the items themselves leave the space
    (all of 0.6 capacities, say), and the containers of that kind stay as they are. A task never
    holds more than a block.
    """
    kinds = [(r[0], int(r[1])) for r in pick(containers, "container_kind", "capacity_tokens").distinct().limit(1001).collect() if r[1] and r[1] > 0]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    spark = items.sparkSession
    rows = pick(items, key, size).toDF("_k", "_size").groupBy("_k", "_size").agg(F.count("*").alias("_c"))
    rows = rows.select("_k", F.col("_size").cast("long").alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_copy"))
    schema = f"container_kind string, container_id long, _k {rows.schema['_k'].dataType.simpleString()}, _copy long, _part int, _first long, _n long"
    if not kinds:
        return spark.createDataFrame([], schema).withColumnsRenamed({"_k": key, "_copy": "copy", "_part": "part", "_first": "first", "_n": "n"})
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(kinds)])).alias("x")
    rows = rows.select("*", kind).select("_k", "_copy", "_size", F.col("x.kind").alias("_kind"), F.col("x.capacity").alias("_capacity"))
    none = rows.filter("_size is null").select(F.col("_kind").alias("container_kind"), F.lit(None).cast("long").alias("container_id"), "_k", "_copy", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_first"), F.lit(0).cast("long").alias("_n"))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / F.col("_capacity")) - 1, F.lit(0)).cast("int"))).alias("_part")
    work = rows.filter("_size is not null").select("*", parts)
    work = work.select("_kind", "_capacity", "_k", "_copy", "_part", (F.col("_part") * F.col("_capacity")).alias("_first"), F.least(F.col("_size") - F.col("_part") * F.col("_capacity"), F.col("_capacity")).alias("_n"))
    work = cut(work)
    done: list[DataFrame] = [none]
    items_of = {r[0]: r[1] for r in work.groupBy("_kind").count().collect()}
    level = 0
    while items_of:
        blocks = {k: -(-n // block) for k, n in items_of.items()}
        many = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("_kind")]
        tagged = work.withColumn("_block", F.pmod(F.xxhash64("_k", "_copy", "_part", F.lit(level)), many))
        bins = tagged.groupBy("_kind", "_block").applyInArrow(_packed_block, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tagged.schema.fields)}, _bin long, _open boolean")
        again: dict[str, int] = {}
        if max(blocks.values()) > 1:
            bins = cut(bins)
            left = {r[0]: r[1] for r in bins.filter("_open").groupBy("_kind").count().collect()}
            again = {k: n for k, n in left.items() if blocks[k] > 1 and n <= STALLED * items_of[k]}
        reopened = F.col("_open") & F.col("_kind").isin(*again)
        number = (F.lit(level).cast("long") * (1 << 56) + F.col("_block") * (1 << 28) + F.col("_bin")).alias("container_id")
        done.append(bins.filter(~reopened).select(F.col("_kind").alias("container_kind"), number, "_k", "_copy", "_part", "_first", "_n"))
        work = bins.filter(reopened).drop("_block", "_bin", "_open")
        items_of, level = again, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnsRenamed({"_k": key, "_copy": "copy", "_part": "part", "_first": "first", "_n": "n"})


def _packed_block(table: pa.Table) -> pa.Table:
    """Adds to a block's items their container and whether it may be opened again."""
    t = table.sort_by([("_k", "ascending"), ("_copy", "ascending"), ("_part", "ascending")])
    n, capacity = t.column("_n").to_numpy(), t.column("_capacity")[0].as_py()
    where = best_two_fit(n, capacity)
    fill = np.bincount(where, weights=n)
    return t.append_column("_bin", pa.array(where, pa.int64())).append_column("_open", pa.array(fill[where] < FULL * capacity))


def document_containers(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The texts of documents, measured in tokens, in containers of each kind: ``container_kind,
    container_id, doc_id, copy, part, first_token, n_tokens``. Null texts have no container."""
    d = pick(documents, "doc_id", "text")
    return packed(_sized(d, path), containers, "doc_id", "n_tokens").withColumnsRenamed({"first": "first_token", "n": "n_tokens"})


def _sized(documents: DataFrame, path: str) -> DataFrame:
    texts = token_counts(documents.filter("text is not null"), path=path)
    return texts.unionByName(documents.filter("text is null").select("doc_id", F.lit(None).cast("long").alias("n_tokens")))


def container_fill(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """How well each kind is filled: ``container_kind, containers, tokens, least, unused``. least is
    the smallest number of containers that could hold the tokens, unused the share left empty."""
    p = pick(packing, "container_kind", "container_id", "n_tokens").filter("container_id is not null")
    per = p.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    per = per.join(pick(containers, "container_kind", "capacity_tokens").distinct(), "container_kind")
    return per.select("container_kind", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))
