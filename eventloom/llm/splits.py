"""Splits that keep related records together: hash-to-min components, weighted rendezvous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.frames import cut, pick

SHARES = {"train": 80, "validation": 10, "test": 10}
ROUNDS = 60
#: Members of a cluster from which its minimum is broadcast instead of joined.
LARGE = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = ROUNDS) -> DataFrame:
    """Connected components: ``group_id`` (the smallest member) and ``id``, a row for every node,
    the smallest included.

    Hash-to-min: each node holds a cluster, at first itself and its neighbours, and in each round
    sends the cluster to the cluster's minimum and the minimum to all members, until nothing
    changes; that takes a number of rounds logarithmic in the longest path. Clusters are rows
    (node, member), so that a hub is no record but many rows, and the minimum is a partial
    aggregation. Each round is written to the checkpoint folder. Edges with a null end and
    self-links say nothing (a node that has only those is left out); repeats and both directions
    are one edge. An empty table gives an empty table. Raises RuntimeError after ``rounds``.
    """
    e = pick(edges, a, b).toDF("a", "b").filter("a is not null and b is not null and a <> b")
    both = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("member")) for x, y in ("ab", "ba", "aa", "bb")]))
    state = cut(e.select(both.alias("x")).select("x.*").distinct())
    mark = lambda s: tuple(s.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first())
    before = mark(state)
    for _ in range(rounds):
        least = state.groupBy("node").agg(F.min("member").alias("m"), F.count("*").alias("n"))
        # at most one cluster per LARGE rows is large
        large = F.broadcast(least.filter(F.col("n") > LARGE).select("node", F.col("m").alias("_m")))
        met = state.join(large, "node", "left")
        met = met.filter("_m is null").drop("_m").join(least.select("node", "m"), "node").unionByName(met.filter("_m is not null").withColumnRenamed("_m", "m"))
        sent = F.explode(F.array(F.struct(F.col("m").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("m").alias("member"))))
        state = cut(met.select(sent.alias("x")).select("x.*").distinct())
        after = mark(state)
        if after == before:
            return state.groupBy("node").agg(F.min("member").alias("group_id")).select("group_id", F.col("node").alias("id"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def id_edges(events: DataFrame, id_links: DataFrame) -> DataFrame:
    """Pairs of ids that belong together: active rows of ``id_links``, and demographic rows of
    ``events`` whose text names another id (each number in it that fits an id)."""
    links = pick(id_links, "id_a", "id_b", "status").filter("status = 'active'").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    named = pick(events, "id", "class", "text_value").filter(F.col("class") == "demographic")
    named = named.select(F.col("id").alias("a"), F.explode(F.regexp_extract_all("text_value", F.lit(r"([0-9]+)"), 1)).alias("b"))
    named = named.select("a", F.expr("try_cast(b as bigint)").alias("b"))
    return links.unionByName(named).filter("a is not null and b is not null and a <> b")


def related_ids(events: DataFrame, id_links: DataFrame) -> DataFrame:
    """``group_id`` (smallest id of a group) and ``id``, each other member."""
    return components(id_edges(events, id_links)).filter("id <> group_id").select("group_id", "id")


def rendezvous(key: Column, shares: dict[str, int], salt: str = "") -> Column:
    """The split of a key: each split draws a number from the md5 of key and split, -ln(u) / share,
    and the smallest wins. A key's split depends on nothing else, and when a share changes only
    keys into or out of that split move."""
    draws = []
    for name, share in shares.items():
        hexes = F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(name), key.cast("string"))), 1, 12)
        u = (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 48)
        draws.append(F.struct((-F.log(u) / float(share)).alias("d"), F.lit(name).alias("s")))
    return F.least(*draws)["s"] if len(draws) > 1 else F.lit(next(iter(shares)))


def split_ids(events: DataFrame, id_links: DataFrame, shares: dict[str, int] | None = None, salt: str = "") -> DataFrame:
    """Every id of ``events`` with its group (its own id if it has no relatives) and split:
    ``id, group_id, split``. Null ids, which are no entity, do not come out."""
    ids = pick(events, "id").filter("id is not null").distinct()
    groups = components(id_edges(events, id_links))
    s = ids.join(groups, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    return s.select("id", "group_id", rendezvous(F.col("group_id"), shares or SHARES, salt).alias("split"))
