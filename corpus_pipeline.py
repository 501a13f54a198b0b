"""Training-corpus pipeline: language ID, near-dedup, decontamination, PII, BPE. Each stage reads its predecessor's Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, decontam, langid, pii, simhash
from folioscope.llm.common import checkpoint_dir, table

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]
# A trained network decides the first stage, which SQL cannot say; tests hold run() against the stages' own rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
