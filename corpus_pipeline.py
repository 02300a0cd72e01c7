"""A corpus clean-up as stages over the documents table, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthospark.llm import stages
from orthospark.llm._tables import written

#: In order; each takes (spark, docs, sf_dir).
STAGES = stages.STAGES

#: Learned models decide in the first stage; no SQL says the same. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
