"""The corpus pipeline: documents in, shards out; each stage is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidar.llm import decontaminate, mixing, near_dedup, quality, sharding
from evidar.llm.common import Workspace, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Hashed signatures, a trained basis and a trained classifier decide: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
