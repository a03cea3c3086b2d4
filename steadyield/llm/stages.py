"""Pipeline stages: each lets one operator's decisions take effect on a table like documents.

A stage keeps all columns, whatever they are called, and works on all rows of
its predecessor: what it adds for itself has names that the table doesn't have.
Empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadyield.llm import benchmark_leaks, feistel_shards, near_dedup, quality_rules, source_mix


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """These names, each lengthened until no column of the table has it; case doesn't tell names apart."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null texts go."""
    return quality_rules.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat its id, the one whose columns' hashes are smallest. Rows without an id stay."""
    (place,) = free_names(docs, "__nth")
    kept = near_dedup.near_duplicates(docs, width=5).filter("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns), F.hash(*docs.columns)))
    one = stay.withColumn(place, nth).filter(F.col(place) == 1).drop(place)
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return benchmark_leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of finish times. Rows alike in all columns count as so many documents."""
    h, g, turns, finish = free_names(docs, "__h", "__g", "__turns", "__finish")
    keyed = docs.withColumns({h: F.xxhash64(*docs.columns), g: F.hash(*docs.columns)})
    served = source_mix.queue(source_mix.mix_sources(keyed, carry=(h, g)), ordered=False).select(h, g, "finish")
    taken = served.groupBy(h, g).agg(F.collect_list("finish").alias(turns))
    rows = keyed.join(taken, [h, g]).dropDuplicates([h, g])
    return rows.withColumn(finish, F.explode(turns)).orderBy(finish, h).select(docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, which take the place of columns with these names."""
    (tie,) = free_names(docs, "__tie")
    return feistel_shards.shard_rows(docs.withColumn(tie, F.xxhash64(*docs.columns)), "doc_id", tie).drop(tie)
