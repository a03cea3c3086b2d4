"""Incremental feeds: new disclosures, and the analyses that they call for.

The feed polls overlapping ranges, so a disclosure may come many times; it is
kept once against all that was ever stored. A watermark would forget, so there
is none: the store itself is what new rows are checked against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from steadyield.operators.policy import TitleWords, analysis_batch, analysis_state, classify_pages, classify_titles


def store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows, none before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


MOST_DAYS = 1000  # a poll looks back a month at most; a batch of more days than this is an error


def append_batch(path: str, key: str, day: str | None = None) -> Callable[[DataFrame, int], None]:
    """Appends a micro-batch's rows whose key is new. A batch that runs again finds its rows stored and adds none.

    With day, a date on which alone a key can occur, the store is kept by it
    and only the days of the batch are read; without, all that is stored.
    """

    def write(batch: DataFrame, batch_no: int) -> None:
        rows, old = batch.dropDuplicates([key]), store(batch.sparkSession, path, batch.schema)
        if day is None:
            rows.join(old.select(key), key, "left_anti").select(batch.columns).write.mode("append").parquet(path)
            return
        days = [r[0] for r in batch.select(day).distinct().limit(MOST_DAYS + 1).collect()]
        if len(days) > MOST_DAYS:
            raise ValueError("a batch of too many days")
        seen = old.filter(F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() if None in days else F.lit(False)))
        rows.join(seen.select(key), key, "left_anti").select(batch.columns).repartition(day).write.mode("append").partitionBy(day).parquet(path)

    return write


def disclosure_feed(spark: SparkSession, landing: str, schema: StructType, path: str, checkpoint: str, words: TitleWords = TitleWords(), active: DataFrame | None = None, day: str | None = None) -> StreamingQuery:
    """Reads landed listings, keeps classified titles of active securities and appends the new ones; ends when all is read. With day, the store is kept by that date."""
    landed = spark.readStream.schema(schema).parquet(landing)
    kept = classify_titles(landed, words)
    if active is not None:
        kept = kept.join(active.select("security_code"), "security_code", "left_semi")
    return kept.writeStream.foreachBatch(append_batch(path, "disclosure_id", day)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyse(targets: DataFrame, results: DataFrame, pages: DataFrame, version: str, limit: int = 100) -> DataFrame:
    """Results of one run of analyses: what is new, changed or worth another attempt, up to the limit. Documents without pages failed."""
    todo = analysis_batch(analysis_state(targets, results, version), limit)
    read = classify_pages(pages.join(todo.select(F.col("disclosure_id").alias("doc_id")), "doc_id", "left_semi"))
    out = todo.select("disclosure_id").join(read.withColumnRenamed("doc_id", "disclosure_id"), "disclosure_id", "left")
    return out.withColumns({"status": F.when(F.col("classification").isNull(), "text_extraction_failed").otherwise("completed"), "analyzer_version": F.lit(version)})
