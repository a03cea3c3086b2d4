"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding of the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadyield.llm import stages
from steadyield.llm.lineage import cut

STAGES = [
    ("quality_rules", stages.keep_good_documents),
    ("near_dedup", stages.keep_one_of_each_group),
    ("decontaminate", stages.drop_benchmark_leaks),
    ("mix_sources", stages.mix_to_targets),
    ("shard", stages.assign_shards),
]

#: Shingle sets, alignments and the sketch have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
