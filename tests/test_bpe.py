import random
from collections import Counter

import pytest
from conftest import rows_of

from eventloom.config import SPLIT_PATTERN
from eventloom.operators import bpe
from eventloom.operators.distfit import recommend


def naive(words, vocab_size):
    words = [(list(w), n) for w, n in words]
    merges = []
    while len(merges) < vocab_size - 256:
        count = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                count[p] += n
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        new = 256 + len(merges)
        merges.append(best)
        for w, _ in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [new]
                i += 1
    return merges


def test_goldens():
    assert bpe.learn_merges([(b"ab", 10), (b"cd", 5)], 257) == [(97, 98)]
    m = bpe.Merger([(97, 97), (256, 97)])
    assert [m.chunk(c) for c in ("aaa", "aaaa", "aaaaa")] == [(257,), (256, 256), (256, 257)]
    with pytest.raises(ValueError):
        bpe.learn_merges([], 255)
    assert bpe.learn_merges([], 300) == []


def test_against_naive_merging():
    r = random.Random(5)
    words = [("".join(r.choices("aab cé", k=r.randrange(1, 9))).encode(), r.randrange(1, 6)) for _ in range(60)]
    for size in (256, 257, 270, 400):
        assert bpe.learn_merges(words, size) == naive(words, size)


def test_corpus(spark, table):
    docs = table("documents")
    m = bpe.train_merges(docs, 400)
    texts = [r["text"] for r in docs.collect() if r["text"]]
    chunks = Counter(c for t in texts for c in bpe.Merger([]).pattern.findall(t))
    assert m == naive([(c.encode(), n) for c, n in chunks.items()], 400)
    enc = bpe.Merger(m)
    got = docs.select("text", bpe.encoder(m)("text").alias("ids")).collect()
    for r in got[:60]:
        assert (r["ids"] is None) == (r["text"] is None)
        if r["text"] is not None:
            assert r["ids"] == enc.encode(r["text"])
    assert enc.decode(enc.encode("naïve 🙂")) == "naïve 🙂"
    with pytest.raises(ValueError):
        enc.decode([10**6])
    with pytest.raises(UnicodeDecodeError):
        enc.decode([255])


def test_same_ids_as_another_encoder(table):
    """The default pattern and merges learned from the documents, against an encoder of its own."""
    import tiktoken

    texts = [r["text"] for r in table("documents").collect() if r["text"]]
    m = bpe.Merger(bpe.train_from_texts(texts, 700))
    other = tiktoken.Encoding("x", pat_str=SPLIT_PATTERN, mergeable_ranks=m.mergeable_ranks(), special_tokens={})
    assert m.vocab_size == 700 and [m.encode(t) for t in texts] == [other.encode_ordinary(t) for t in texts]
    long = "ab" * 3000 + "é" * 500
    assert m.encode(long) == other.encode_ordinary(long)


def test_texts_one_after_the_other_and_ranks(spark, table):
    docs = table("documents")
    assert bpe.train_from_texts((r["text"] for r in docs.collect()), 400) == bpe.train_merges(docs, 400)
    got = {r["token_id"]: bytes(r["bytes"]) for r in bpe.ranks(spark, [(97, 98), (256, 99)]).collect()}
    assert len(got) == 258 and got[255] == b"\xff" and got[257] == b"abc"
    with pytest.raises(ValueError, match="distinct chunks"):
        bpe.train_merges(docs, 400, most_chunks=10)


def test_pair_counts(spark):
    c = spark.createDataFrame([("abab", 2), ("é", 1), ("x", 9)], "chunk string, n long")
    assert rows_of(bpe.pair_counts(c), "left", "right", "n") == [(97, 98, 4), (98, 97, 2), (195, 169, 1)]


def test_distribution_advice(spark):
    import numpy as np

    r = np.random.default_rng(2)
    groups = {"n": r.normal(50, 5, 400), "l": r.lognormal(3, 1, 400), "neg": r.normal(0, 5, 400), "sat": np.minimum(100, r.normal(97, 2, 400)), "few": r.normal(0, 1, 29)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(None, float(v)) for v in groups["n"]], "k string, numeric_value double")
    got = dict(rows_of(recommend(df, ["k"]), "k", "recommendation"))
    assert got["l"] == "lognormal" and got["neg"] == "normal" and got["n"] in ("normal", "gamma", "lognormal", "minmax") and "few" not in got and None in got
    assert recommend(df.limit(0), ["k"]).count() == 0
