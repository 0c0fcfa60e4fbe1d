import math
import warnings

import pytest
from conftest import rows_of

from eventloom.config import TokenizerConfig
from eventloom.operators import decode, encode, score
from eventloom.operators.training import text_modes, train
from eventloom.sources import events as sources
from eventloom.sources import store

EXAMPLE = [
    (1, "1960-05-01", "demographic", "birth_date", None), (1, "2023-01-01T08:00:00", "lab", "hemoglobin", 13.0), (1, "2023-02-01T10:00:00", "admission", None, None), (1, "2023-02-01T14:00:00", "lab", "hemoglobin", 10.5),
]
STATES = {"state_transitions": {"inpatient": ["admission"]}, "initial_state": "outpatient", "milestone_per_state": {"outpatient": "week", "inpatient": "8hr"}}
CONCEPT = {"text_mode_default": "concept"}


def tokens(df, model):
    return [r["token"] for r in encode.encode(df, model).orderBy("id", "pos").collect()]


def test_worked_example(events):
    e = events(EXAMPLE)
    m = train(e, TokenizerConfig(**CONCEPT, **STATES))
    assert tokens(e, m) == ["<|sos|>", "<|age_62|>", "<|lab|>", "hemoglobin", "<|L1|>", "<|delta_time_0|>", "<|Q1|>", "<|ms_week_5|>", "<|admission|>", "<|delta_time_0|>", "<|Q0|>", "<|ms_8hr_0|>", "<|lab|>", "hemoglobin", "<|L0|>", "<|eos|>"]
    s = encode.encode(e, m)
    assert [r["row_no"] for r in s.orderBy("pos").collect()] == [-1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, -1]
    back = decode.decode(s, m).orderBy("_src").collect()
    assert [(r["class"], r["text_value"], r["numeric_value"]) for r in back] == [("lab", "hemoglobin", 13.0), ("admission", None, None), ("lab", "hemoglobin", 10.5)]
    assert [str(r["time"]) for r in back] == ["1970-01-01 00:00:00", "1970-01-16 15:00:00", "1970-02-01 06:00:00"]
    late = decode.decode(s, m, compat_times=True, first_id=0).orderBy("_src").collect()
    assert [str(r["time"]) for r in late] == ["1970-01-16 15:00:00", "1970-02-01 06:00:00", "1970-02-01 06:00:00"] and {r["id"] for r in late} == {0}
    d = encode.debug(e, m).orderBy("_src").collect()
    assert d[0]["tokens"] == ["<|sos|>"] and d[2]["tokens"][-1] == "<|admission|>"
    q = encode.sequences(s)
    assert [len(r["ids"]) for r in q.collect()] == [16] and encode.training_pairs(q, with_values=True).selectExpr("size(x)", "size(yv)").first()[:] == (15, 15)


def test_fused_example(events):
    e = events(EXAMPLE)
    m = train(e, TokenizerConfig(num_seq="fused", **CONCEPT, **STATES))
    assert tokens(e, m) == ["<|sos|>", "<|age_62|>", "<|lab|>", "hemoglobin::L1", "<|delta_time_0_Q1|>", "<|ms_week_5|>", "<|admission|>", "<|delta_time_0_Q0|>", "<|ms_8hr_0|>", "<|lab|>", "hemoglobin::L0", "<|eos|>"]


def labs(n=40):
    return [(1 + k // 20, f"2023-01-{1 + k % 20:02d}T{k % 24:02d}:00:00", "lab", "hemoglobin" if k % 2 else None, 10 + 0.37 * k) for k in range(n)] + [(5, "2023-03-01", "dx", "a//b", None), (5, "2023-03-01", "dx", "", None)]


@pytest.mark.parametrize("kind, seq", [("discrete", "factored"), ("discrete", "fused"), ("continuous", "factored"), ("continuous", "fused")])
def test_round_trip(events, kind, seq):
    e = events(labs())
    m = train(e, TokenizerConfig(num_type=kind, num_seq=seq, concept_splitters={"dx": "//"}, continuous_clip_min=0, continuous_clip_max=100, time_scales=[3600, 90_000], time_scale_names=["h", "d", "w"], **CONCEPT))
    s = encode.encode(e, m)
    back = decode.decode(s, m)
    # within an id, rows come back in order of time
    want = e.orderBy("id", "time", "_src").collect()
    got = back.orderBy("id", "_src").collect()
    assert [(r["id"], r["class"], r["text_value"]) for r in got] == [(r["id"], r["class"], r["text_value"]) for r in want]
    for a, b in zip(got, want):
        if seq == "fused" and b["text_value"] is None:
            assert a["numeric_value"] is None  # nothing to fuse to
        elif b["numeric_value"] is not None:
            assert a["numeric_value"] == pytest.approx(b["numeric_value"], abs=1e-6 if kind == "continuous" else 2.0)
    if kind == "continuous":
        first = [r["time"] for r in got if r["id"] == 1]
        true = [r["time"] for r in want if r["id"] == 1]
        # every difference lies within the clip thresholds, so times come back too
        assert [(t - first[0]).total_seconds() for t in first] == pytest.approx([(t - true[0]).total_seconds() for t in true], abs=1)


def test_fusion_and_namespaces(events):
    rows = [(1, f"2023-01-0{k + 1}", c, t, k) for k, (c, t) in enumerate([("abcd", "XX//aa"), ("efgh", "cc//XX"), ("ijkl", "XX")] * 2)]
    e = events(rows)
    split = {"concept_splitters": {"abcd": "//", "efgh": "//"}}
    m = train(e, TokenizerConfig(n_bins=2, level_threshold=0, num_seq="fused", namespace_concepts_by_class=True, fuse_class_to_concept=True, **split, **CONCEPT))
    shown = {r["_src"]: r["tokens"] for r in encode.debug(e, m).collect()}
    assert shown[0][-2:] == ["<|abcd:XX|>", "abcd:aa::Q0"] and shown[1][-2:] == ["<|efgh:cc|>", "efgh:XX::Q0"]
    assert shown[2][-1] == "<|ijkl:XX|>::Q0"
    t = {r["token"]: r["type"] for r in m.vocab.collect()}
    assert t["<|abcd:XX|>"] == "class_concept" and t["abcd:aa::Q1"] == "fused_concept_Q" and t["<|ijkl:XX|>::Q0"] == "class_concept_Q"
    back = decode.decode(encode.encode(e, m), m)
    assert rows_of(back, "class", "text_value") == sorted([(c, t) for _, _, c, t, _ in rows])


def test_collisions_and_unknown(events):
    e = events([(1, "2023-01-01", "a:b", "x", None), (1, "2023-01-02", "a", "b", None)])
    with pytest.raises(ValueError, match="collide"):
        train(e, TokenizerConfig(fuse_class_to_concept=True, **CONCEPT))
    m = train(events([(1, "2023-01-01", "a", "b", None), (1, "2023-01-02", "a", "c", None)]), TokenizerConfig(**CONCEPT))
    new = events([(1, "2023-01-01", "a", "d", None), (1, "2023-01-02", "z", None, None)])
    with pytest.raises(Exception, match="not in the vocabulary"):
        encode.encode(new, m).collect()
    assert rows_of(encode.unknown_tokens(new, m), "token", "n") == [("<|z|>", 1), ("d", 1)]
    assert tokens(events([(1, "2023-01-01", "a", "b", 5)]), m) == ["<|sos|>", "<|a|>", "b", "<|eos|>"]  # no numbers were seen for it


def test_modes(events):
    e = events([(1, "2023-01-01", c, f"t{k}", None) for c, n in (("few", 64), ("many", 65), ("split", 99)) for k in range(n)] + [(1, "2023-01-01", "nulls", f"t{k}" if k else None, None) for k in range(65)])
    c = TokenizerConfig(concept_splitters={"split": "1"})
    assert text_modes(e, c) == {"few": "concept", "many": "bpe", "split": "concept", "nulls": "bpe"}
    assert text_modes(e, TokenizerConfig(text_mode_default="bpe", text_mode_overrides={"few": "concept"}))["few"] == "concept"


def test_byte_pairs(events):
    texts = [f"note {k} über Größe {k * 7} 🙂" for k in range(80)]
    rows = [(1, f"2023-01-01T{k // 60:02d}:{k % 60:02d}:00", "note", t, float(k)) for k, t in enumerate(texts)] + [(1, "2023-01-02", "lab", "glucose", k) for k in range(20)]
    e = events(rows)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        m = train(e, TokenizerConfig(num_seq="fused", final_vocab_size=700))
    assert any("fused" in str(w.message) for w in seen) and m.uses_bpe and m.modes == {"note": "bpe", "lab": "concept"}
    s = encode.encode(e, m)
    back = decode.decode(s, m).filter("class = 'note'")
    assert rows_of(back, "text_value") == sorted((t,) for t in texts)
    ids = m.vocab.selectExpr("min(token_id)", "count(*)", "count(distinct token_id)").first()
    assert ids[0] == m.base and ids[1] == ids[2]
    kinds = dict(rows_of(decode.token_types(s, m).groupBy("type").count(), "type", "count"))
    assert kinds["bpe"] > 500 and kinds["L"] == 80 if "L" in kinds else True
    assert "<UNK:99999>" in [r["token"] for r in decode.token_strings(s.limit(1).selectExpr("id", "pos", "cast(99999 as bigint) as token_id", "val"), m).collect()]
    small = train(e, TokenizerConfig(final_vocab_size=1))
    assert small.merges == [] and small.base == 256


def test_density(events):
    e = events([(1, f"2023-01-01T{k:02d}:00:00", "lab", "hemoglobin", 10 + k) for k in range(12)])
    m = train(e, TokenizerConfig(n_bins=4, **CONCEPT))
    s = encode.encode(e, m).drop("token")
    a = {(r["pos"]): r for r in score.adjusted(s.selectExpr("*", "3D as bits"), m).collect()}
    edges = [11.5, 16.5, 19.5]
    width = {0: 5.0, 1: 5.0, 2: 3.0, 3: 3.0}
    q = [r for r in a.values() if r["group"] == "numeric"]
    assert len(q) == 12
    for r in q:
        k = m.vocab.filter(f"token_id = {r['token_id']}").first()["qual_index"] if r["pos"] < 20 else None
        if k is not None:
            assert r["adjustment"] == pytest.approx(math.log2(width[k])), edges
    r = score.bits_per_row(s.selectExpr("*", "3D as bits"), m).first()
    assert r["n_rows"] == 12 and r["tokens_per_row"] == pytest.approx((12 * 3 + 11 * 2 + 1) / 12) and r["bpr_raw"] == pytest.approx(3 * r["tokens_per_row"])
    with pytest.raises(ValueError, match="tail_mode"):
        score.adjusted(s.selectExpr("*", "3D as bits"), m, "x")


def test_density_of_scaled_and_censored(events):
    e = events([(1, f"2023-01-{1 + k // 24:02d}T{k % 24:02d}:00:00", "lab", "x", 5 + (k * 37 % 100) / 10) for k in range(100)])
    m = train(e, TokenizerConfig(num_type="continuous", distributions={"minmax": ["lab"]}, **CONCEPT))
    p = m.numeric.first()["p"]
    assert p["distribution"] == "minmax"
    s = encode.encode(e, m).drop("token").selectExpr("*", "1D as bits", "2D as v_bits", "0D as loc", "1D as scale")
    num = score.adjusted(s, m).filter("group = 'numeric'")
    assert num.selectExpr("min(adjustment)", "max(adjustment)").first()[:] == pytest.approx((math.log2(p["vmax"] - p["vmin"]),) * 2)
    tails = score.adjusted(s, m, "censored").filter("group = 'numeric'").filter("val <= 0 or val >= 1")
    low = [r["adjustment"] for r in tails.collect() if r["val"] <= 0]
    assert low and low[0] == pytest.approx(1.0 - 2.0)  # half of the mass lies below 0: one bit


def test_contexts(events):
    e = events(labs())
    m = train(e, TokenizerConfig(num_type="continuous", num_seq="fused", **CONCEPT))
    c = decode.numeric_context(encode.encode(e, m).drop("token"), m)
    got = {(r["type"], r["ctx_kind"]) for r in c.select("type", "ctx_kind").distinct().collect()}
    assert ("time_delta", "time") in got and ("concept", "row") in got and ("class", "row") not in got and ("sos", None) in got


def test_store(spark, events, tmp_path):
    e = events(labs() + [(1, "1950-01-01", "demographic", "birth_date", None)])
    m = train(e, TokenizerConfig(num_type="continuous", text_mode_overrides={"dx": "bpe", ("lab", "x"): "concept"}, **CONCEPT))
    store.save(m, str(tmp_path / "m"))
    n = store.load(spark, str(tmp_path / "m"))
    assert n.config == m.config and n.merges == m.merges and n.modes == m.modes
    assert rows_of(encode.encode(e, n), "id", "pos", "token_id") == rows_of(encode.encode(e, m), "id", "pos", "token_id")
    store.save(m, str(tmp_path / "p"), with_births=False)
    assert store.load(spark, str(tmp_path / "p")).births is None
    with pytest.raises(RuntimeError):
        store.save(None, str(tmp_path / "q"))
    store.export_sequences(encode.sequences(encode.encode(e, m)).selectExpr("*", "'train' as split"), str(tmp_path / "s"), "split")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_sources(spark, tmp_path, events):
    p = tmp_path / "e.csv"
    p.write_text("id,time,class,text_value,numeric_value\n1,2023-01-01 00:00:00,lab,x,1.5\n1,2023-01-02 00:00:00,lab,,\n")
    c = sources.read_csv(spark, str(p))
    assert [(r["text_value"], r["numeric_value"]) for r in c.orderBy("_src").collect()] == [("x", 1.5), (None, None)]
    with pytest.raises(ValueError, match="class"):
        sources.canonical(c.drop("class"))
    assert sources.canonical(sources.renamed(c.withColumnRenamed("class", "item"), {"item": "class"})).count() == 2
    m = spark.createDataFrame([(1, None, "LAB//a//b", 1.0), (1, None, "MEDS_BIRTH", None), (2, None, "ADMISSION", None), (2, None, "lab / x", None), (2, None, None, None)], "subject_id long, time timestamp_ntz, code string, numeric_value double")
    assert rows_of(sources.from_meds(m), "class", "text_value") == sorted([("lab", "a//b"), ("demographic", "birth_date"), ("admission", None), ("lab / x", None), (None, None)], key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
    assert ("lab", "x") in rows_of(sources.from_meds(m, r"\s*/+\s*"), "class", "text_value")


def test_edge_tables(spark, events):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        one = events([(1, None, "lab", None, None)])
        m = train(one, TokenizerConfig(**CONCEPT))
        assert tokens(one, m) == ["<|sos|>", "<|lab|>", "<|eos|>"] and tokens(events([]), m) == []
        assert decode.decode(encode.encode(events([]), m), m).count() == 0
        assert score.bits_per_row(encode.encode(events([]), m).drop("token").selectExpr("*", "1D as bits"), m).first()["bpr"] in (0.0, None)
        ties = events([(1, "2023-01-01", "lab", t, None) for t in "dacb"])
        assert tokens(ties, train(ties, TokenizerConfig(**CONCEPT)))[1:-1] == [x for t in "dacb" for x in ("<|lab|>", t)]


def test_global_row_index(events):
    e = events([(3, "2023-01-02", "a", None, None), (1, "2023-01-02", "a", None, None), (1, None, "a", None, None), (2, "2023-01-01", "a", None, None)])
    assert rows_of(encode.global_row_index(e), "row_idx", "id", "_src") == [(0, 1, 2), (1, 1, 1), (2, 2, 3), (3, 3, 0)]
