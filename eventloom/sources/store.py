"""Models and sequences on disk: parquet tables and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import TokenizerConfig
from eventloom.operators.training import TokenizerModel

TABLES = ("numeric", "gaps", "vocab", "births")


def save(model: TokenizerModel | None, path: str, with_births: bool = True) -> None:
    """Writes a model to a folder. Birth dates of the training entities can be left out. Saving
    nothing raises RuntimeError."""
    if model is None:
        raise RuntimeError("there is no trained model to save")
    spark = model.vocab.sparkSession
    for t in TABLES:
        df = getattr(model, t)
        if df is not None and (t != "births" or with_births):
            df.write.mode("overwrite").parquet(f"{path}/{t}")
    spark.createDataFrame(list(enumerate(model.merges)) or [], "rank long, pair struct<a:int,b:int>").write.mode("overwrite").parquet(f"{path}/merges")
    rest = json.dumps({"config": model.config.to_json(), "modes": model.modes, "uses_bpe": model.uses_bpe})
    spark.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load(spark: SparkSession, path: str) -> TokenizerModel:
    """Reads a model. Settings that an older model lacks take their defaults; without a table of
    birth dates only those in the data count."""
    rest = json.loads(spark.read.text(f"{path}/model").first()[0])
    merges = [(r["pair"]["a"], r["pair"]["b"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    try:
        births = spark.read.parquet(f"{path}/births")
    except Exception:  # noqa: BLE001 - the reader's way to say that there is none
        births = None
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES[:3]}
    return TokenizerModel(TokenizerConfig.from_json(rest["config"]), rest.get("modes", {}), tables["numeric"], tables["gaps"], tables["vocab"], births, merges, rest.get("uses_bpe", bool(merges)))


def export_sequences(seqs: DataFrame, path: str, split: str | None = None) -> None:
    """Writes sequences as parquet, values as 32-bit floats, in a folder per value of ``split``."""
    s = seqs.withColumn("vals", F.col("vals").cast("array<float>"))
    w = s.write.mode("overwrite")
    (w.partitionBy(split) if split else w).parquet(path)
