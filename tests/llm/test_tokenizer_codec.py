import random

import numpy as np
import pytest
import tiktoken

from eventloom.llm import tokenizer as K

MULTI = K.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")


@pytest.fixture(scope="module", params=[K.VOCABULARY, MULTI])
def pair(request):
    tokens = K.read_ranks(request.param)
    return K.Codec(tokens), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_real_texts(pair, table):
    codec, other = pair
    texts = [r["text"] for r in table("documents", "sf0.01").select("text").collect() if r["text"]]
    for t in texts:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t) and codec.decode(ids) == t and codec.count(t) == len(ids)


def test_random_bytes_and_letters(pair):
    codec, other = pair
    r = random.Random(1)
    for _ in range(4000):
        s = bytes(r.randrange(256) for _ in range(r.randrange(1, 14)))
        assert codec.encode_piece(s) == other._encode_single_piece(s)
        s = "".join(r.choice("aeiothnsrl-= ") for _ in range(r.randrange(1, 40))).encode()
        assert codec.encode_piece(s) == other._encode_single_piece(s)


def test_long_runs_take_linear_time(pair):
    codec, other = pair
    for s in (b"a" * 20_000, b"ab" * 9000, b" " * 15_000, "é".encode() * 5000, b"=-" * 4000, bytes(range(256)) * 40):
        assert codec.encode_piece(s) == other._encode_single_piece(s)


def test_special_spellings_are_text(pair):
    codec, other = pair
    t = "a<|endoftext|>b <unk> [PAD]"
    assert codec.encode(t) == other.encode_ordinary(t) and codec.decode(codec.encode(t)) == t


def test_decoding_errors(pair):
    codec, _ = pair
    assert codec.decode([]) == "" and codec.decode_bytes(np.array([], np.int64)) == b""
    for bad in ([-1], [10**6]):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_bad_vocabularies(tmp_path):
    p = tmp_path / "v.tiktoken"
    p.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        K.read_ranks(str(p))
    with pytest.raises(ValueError):
        K.Codec([b"a", b"b"])


def test_tables(spark):
    long = "wort " * 30_000 + "あ" * 5000
    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (3, None), (4, long), (5, " \n ")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as _t", "3 as n_tokens")
    codec = K.Codec(K.read_ranks())
    e = K.encoded(df)
    got = [(r["doc_id"], r["ids"]) for r in e.collect()]
    assert sorted(got) == sorted([(1, codec.encode("Hello  world")), (2, []), (3, []), (3, []), (4, codec.encode(long)), (5, codec.encode(" \n "))])
    assert {r["doc_id"]: r["text"] for r in K.decoded(e).collect()}[4] == long
    assert {r["doc_id"]: r["n_tokens"] for r in K.token_counts(df).collect()} == {1: len(codec.encode("Hello  world")), 2: 0, 3: 0, 4: len(codec.encode(long)), 5: len(codec.encode(" \n "))}
    assert K.encoded(df.limit(0)).count() == 0
