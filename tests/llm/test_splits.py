import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from eventloom.llm import splits as S


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent)


@pytest.mark.parametrize("large", [S.LARGE, 20])
def test_random_chain_and_hub(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE", large)
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000 + k) for k in range(1, 300)] + [(None, 3), (9, None), (77777, 77777)]
    edges += [(b, a) for a, b in edges[:40]]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows_of(S.components(df), "group_id", "id") == brute(edges)
    assert S.components(df.limit(0)).count() == 0


def test_related_ids(spark, events):
    e = events([(5, "2021-01-01", "demographic", "merged with 2", None), (6, "2021-01-01", "demographic", "birth_date", None), (7, "2021-01-01", "note", "merged with 6", None), (8, None, "demographic", None, None), (9, None, "demographic", "see also record 99999999999999999999", None), (4, None, "demographic", "alias of 4", None)])
    links = spark.createDataFrame([(2, 1, "x", "active"), (1, 2, "x", "active"), (6, 7, "x", "withdrawn"), (8, 300, "x", "active"), (8, None, "x", "active"), (6, 6, "x", "active")], "id_a long, id_b long, reason string, status string")
    assert rows_of(S.related_ids(e, links), "group_id", "id") == [(1, 2), (1, 5), (8, 300)]
    assert rows_of(S.related_ids(e.selectExpr("*", "1 as node", "2 as m", "3 as member"), links), "group_id", "id") == [(1, 2), (1, 5), (8, 300)]
    got = S.split_ids(e, links)
    by = {x["id"]: x for x in got.collect()}
    assert set(by) == {4, 5, 6, 7, 8, 9} and by[5]["group_id"] == 1 and by[6]["group_id"] == 6
    assert S.split_ids(events([]), links).count() == 0


def test_shares(spark):
    ids = spark.range(20_000).select("id", S.rendezvous(F.col("id"), S.SHARES).alias("s"), S.rendezvous(F.col("id"), S.SHARES | {"test": 20}).alias("t"))
    n = {r["s"]: r["count"] for r in ids.groupBy("s").count().collect()}
    assert abs(n["train"] / 20_000 - 0.8) < 0.01 and abs(n["test"] / 20_000 - 0.1) < 0.01
    assert ids.filter("s <> t and t <> 'test'").count() == 0  # a larger share only draws keys in
