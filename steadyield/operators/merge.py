"""Keyed maintenance of tables: each function takes the old table and a batch and returns the new table.

Plain files have no MERGE, so a merge is a join and the caller writes the
result to a new place before it takes the old one's. Batches carry batch_no;
of rows with one key the highest wins, of equal ones the row whose other
columns, in their order, hold the higher values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, *keys: str, order: str = "batch_no") -> DataFrame:
    others = [c for c in batch.columns if c not in (*keys, order)]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *map(F.desc, others)))
    return batch.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def side_by_side(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Full outer join with the rows as structs o and n."""
    o = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("o"))
    n = new.select(*keys, F.struct(*(c for c in new.columns if c not in keys)).alias("n"))
    return o.join(n, list(keys), "full_outer")


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c, t in df.dtypes if t == "string"})


def upsert(old: DataFrame, batch: DataFrame, *keys: str, order: str = "batch_no") -> DataFrame:
    """New rows replace old ones of the same key."""
    new = last_of_batch(batch, *keys, order=order).drop(order)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(old.columns))


def upsert_master(old: DataFrame, listed: DataFrame, key: str = "security_code", source: str | None = None) -> DataFrame:
    """The list overwrites and activates; what the list lacks stays, inactive; blanks are null.

    Where source names a column, only rows of sources that the list holds become inactive.
    """
    new = blank_to_null(listed)
    m = side_by_side(old, new.select(*(c for c in old.columns if c != "is_active")), key)
    columns = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in (key, "is_active")]
    active = F.col("n").isNotNull()
    if source is not None:
        own = new.select(F.col(source).alias("__source")).filter("__source is not null").distinct()
        m = m.join(own, F.col(f"o.{source}") == F.col("__source"), "left")
        active |= F.coalesce(F.col("o.is_active"), F.lit(False)) & F.col("__source").isNull()
    return m.select(key, *columns, active.alias("is_active"))


def coalescing_upsert(old: DataFrame, batch: DataFrame, key: str, overwrite: tuple[str, ...] = (), order: str = "batch_no") -> DataFrame:
    """A new null keeps the old value, except in the columns that overwrite."""
    m = side_by_side(old, last_of_batch(batch, key, order=order).select(old.columns), key)
    taken = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in overwrite else F.coalesce(f"n.{c}", f"o.{c}")
    return m.select(key, *(taken(c).alias(c) for c in old.columns if c != key))


def replace_range(old: DataFrame, new: DataFrame, when: str, start: Column, end: Column, source: Column) -> DataFrame:
    """Old rows of the source within the range give way to the new ones."""
    return old.filter(~F.coalesce(source & F.col(when).between(start, end), F.lit(False))).unionByName(new.select(old.columns))


def widen_status(old: DataFrame, batch: DataFrame, key: str = "security_code") -> DataFrame:
    """Merges sync results: the covered range grows only with a complete run, the observed range always; the last status stands."""
    m = side_by_side(old, batch, key)
    complete = F.col("n.sync_status") == "complete"
    low = lambda c: F.least(f"o.{c}", f"n.{c}")
    high = lambda c: F.greatest(f"o.{c}", f"n.{c}")
    return m.select(
        key,
        F.when(complete, low("covered_from")).otherwise(F.col("o.covered_from")).alias("covered_from"),
        F.when(complete, high("covered_to")).otherwise(F.col("o.covered_to")).alias("covered_to"),
        low("observed_from").alias("observed_from"),
        high("observed_to").alias("observed_to"),
        F.coalesce("n.sync_status", "o.sync_status").alias("sync_status"),
    )


def mark_partial(requested: DataFrame, observed: DataFrame, key: str = "security_code") -> DataFrame:
    """Status rows of a run: securities that it asked for and did not see are partial."""
    return requested.join(observed, key, "left").withColumn("sync_status", F.when(F.col("observed_from").isNull(), "partial").otherwise("complete"))


def replace_months(old: DataFrame, new: DataFrame, months: DataFrame, month: str = "coverage_month") -> DataFrame:
    """Months in the batch are replaced whole; one that came empty loses its rows."""
    return old.join(months.select(month).distinct(), month, "left_anti").unionByName(new.select(old.columns))


def record_attempts(old: DataFrame, batch: DataFrame, key: str = "disclosure_id") -> DataFrame:
    """Results overwrite, and the number of attempts goes up by one."""
    m = side_by_side(old, batch, key)
    new = F.col("n").isNotNull()
    columns = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in (key, "attempts")]
    return m.select(key, *columns, F.when(new, F.coalesce("o.attempts", F.lit(0)) + 1).otherwise(F.col("o.attempts")).alias("attempts"))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, each key once."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(old.columns))


def merge_filings(old: DataFrame, fetched: DataFrame, key: str = "doc_id", order: str = "batch_no") -> DataFrame:
    """The fetched filings over the old ones, with is_new for ids seen for the first time; rows without an id go."""
    named = lambda df: df.filter(F.trim(key) != "")
    before = named(old).withColumn("__fetched", F.lit(False))
    new = last_of_batch(named(fetched), key, order=order).select(*old.columns).withColumn("__fetched", F.lit(True))
    m = side_by_side(before, new, key)
    columns = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != key]
    return m.select(key, *columns, F.col("o").isNull().alias("is_new"))


def preview(filings: DataFrame, when: str = "submitted_at", key: str = "doc_id", limit: int = 8) -> DataFrame:
    """The newest filings with their place, and one row after them for how many more there are."""
    newest = filings.orderBy(F.desc_nulls_last(when), key).limit(limit)
    top = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(when), key)).cast("long")).withColumn("n_more", F.lit(None).cast("long"))
    rest = filings.agg((F.count(F.lit(1)) - limit).alias("n_more")).filter("n_more > 0").withColumn("place", F.lit(limit + 1).cast("long"))
    return top.unionByName(rest, allowMissingColumns=True)


def swap_if_filled(table: DataFrame, folder: str, name: str) -> str:
    """Writes the table beside the old ones under a name of its own and returns its path; an empty table is an error. Old ones stay as they are."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    if not table.sparkSession.read.schema(table.schema).parquet(path).take(1):
        raise ValueError("the new table is empty; the old one stays")
    return path
