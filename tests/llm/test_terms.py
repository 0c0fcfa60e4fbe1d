from collections import Counter

from conftest import rows_of

from eventloom.llm import terms as R


def brute(rows):
    occurs, records, total = Counter(), Counter(), Counter()
    for g, t in rows:
        if t is None:
            continue
        total[g] += 1
        seen = R.terms_of(t)
        occurs.update((g, x) for x in seen)
        records.update((g, x) for x in set(seen))
    return sorted(((g, x, n, records[g, x], "common" if records[g, x] > 0.25 * total[g] else "rare" if records[g, x] <= 2 else None) for (g, x), n in occurs.items()), key=str)


def test_terms_of():
    assert R.terms_of("Spo2: wearable_ONE 5mg µg °C a b-c ÉTÉ x2") == ["spo2", "wearable", "one", "µg", "été", "x2"]
    assert R.terms_of("") == [] and R.terms_of("1 22 _") == []


def test_against_brute_force_with_any_heavy_set(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice("ab") if r.random() < 0.97 else None, None if r.random() < 0.05 else " ".join(r.choices(["glucose", "mg", "dl", "x1", "rare%d" % r.randrange(900), ""], k=r.randrange(0, 6)))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "class string, text_value string").repartition(5)
    for heavy in (None, [], [("a", "glucose"), ("b", "mg"), ("a", "never")]):
        got = sorted((tuple(x) for x in R.marked_terms(df, "class", "text_value", heavy).select("class", "term", "occurrences", "records", "mark").collect()), key=str)
        assert got == brute(rows)


def test_heavy_terms_are_the_frequent_ones(spark):
    df = spark.createDataFrame([("a", "often sometimes")] * 500 + [("a", f"often once{k}") for k in range(500)], "g string, t string")
    assert R.heavy_terms(df, "g", "t", 2) == [("a", "often"), ("a", "sometimes")]


def test_events_count_repeats_once(spark, events):
    e = events([(1, "2021-01-01", "note", "same text", None)] * 3 + [(1, "2021-01-01", "note", None, 1), (1, "2021-01-01", "note", "", None), (2, "2021-01-01", None, "same", None)])
    assert rows_of(R.event_terms(e), "class", "term", "occurrences", "records", "mark") == [("note", "same", 1, 1, "common"), ("note", "text", 1, 1, "common"), (None, "same", 1, 1, "common")]
    assert R.event_terms(events([])).count() == 0
    assert R.event_terms(e.selectExpr("*", "1 as g", "2 as term", "3 as records")).count() == 3


def test_very_long_text(spark, events):
    e = events([(1, "2021-01-01", "note", "alpha beta " * 50_000, None)])
    assert rows_of(R.event_terms(e), "term", "occurrences", "records") == [("alpha", 50_000, 1), ("beta", 50_000, 1)]
