import datetime as dt

from conftest import EVENTS
from test_timeline import random_rows

from eventloom.config import TokenizerConfig
from eventloom.operators.timeline import timeline
from eventloom.operators.training import train
from eventloom.streaming.incremental import encode_stream, timeline_stream


def run(spark, tmp_path, rows, make, name):
    """Feeds rows in order of time, in files of one micro-batch each."""
    source = tmp_path / name
    source.mkdir()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[5]))
    for k in range(0, len(rows), 150):
        spark.createDataFrame(rows[k : k + 150], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / (name + "_c"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    config = TokenizerConfig(state_transitions={"in": ["admission"], "out": ["discharge"]}, initial_state="out", milestone_per_state={"in": "8hr", "out": "week"}, text_mode_default="concept")
    rows = random_rows(11, 450)
    # micro-batches follow the files, and within them time: give each row a time of its own
    rows = [(i, t, c, x, v, k) for i, t, c, x, v, k in rows if t is not None]
    pick = lambda rs: {r["_src"]: (r["_sos"], r["_dt_us"], r["_state"], r["_ms"], r["_age"]) for r in rs if not r["_birth"]}
    batch = timeline(spark.createDataFrame(rows, EVENTS), config).collect()
    assert pick(run(spark, tmp_path, rows, lambda s: timeline_stream(s, config), "lines")) == pick(batch)


def test_encoding_a_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2023, 1, 1, k), "lab", "x", float(k), k) for k in range(5)]
    m = train(spark.createDataFrame(rows, EVENTS), TokenizerConfig(text_mode_default="concept"))
    got = sorted(run(spark, tmp_path, rows, lambda s: encode_stream(s, m), "encoded"), key=lambda r: r["_rn"])
    assert [x["token"] for x in got[0]["tokens"]] == ["<|sos|>", "<|lab|>", "x", "<|L0|>"] and [x["token"] for x in got[4]["tokens"]][-3:] == ["<|lab|>", "x", "<|L4|>"]
