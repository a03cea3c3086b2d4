"""Writing a table's next version, checking it, and only then making it the current one.

Versions lie side by side; a manifest beside them names which one counts. A
version that fails its checks, or a run that dies, leaves the old one current.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from steadyield.functions.expr import is_true

MANIFEST = "version string, published_at long, n_rows long"


class AuditError(ValueError):
    """A staged version broke a rule or lost rows."""


def _staged(rows: DataFrame, path: str, checks: dict[str, Column], by: tuple[str, ...] = ()) -> int:
    """Writes the rows, counting them and what breaks a check on the way, and counts what can be read back."""
    seen = Observation(f"staged-{uuid.uuid4().hex}")
    broken = [F.count_if(~is_true(c)).alias(f"broken_{k}") for k, c in enumerate(checks.values())]
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *broken)
    (observed.hint("rebalance", *by) if by else observed).write.partitionBy(*by).parquet(path)
    told = seen.get
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path).count()
    wrong = [f"{name}: {told[f'broken_{k}']}" for k, name in enumerate(checks) if told[f"broken_{k}"]]
    if stored != told["n_rows"]:
        wrong.append(f"{told['n_rows']} rows went out, {stored} came back")
    if wrong:
        raise AuditError("; ".join(wrong))
    return told["n_rows"]


def manifest(spark: SparkSession, folder: str, schema: str = MANIFEST) -> DataFrame:
    """What has been published in a folder; nothing where there is none yet."""
    try:
        spark.read.parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def publish(rows: DataFrame, folder: str, checks: dict[str, Column] | None = None, key: tuple[str, ...] = ()) -> str:
    """Makes the rows a folder's current version if every check holds for each of them and no key repeats; else an AuditError, and nothing changes. Checks that are null count as broken."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    n = _staged(rows, f"{folder}/data/{version}", checks or {})
    if key and (again := spark.read.schema(rows.schema).parquet(f"{folder}/data/{version}").groupBy(*key).count().filter("count > 1").limit(1).count()):
        raise AuditError(f"repeated keys: {again} or more")
    spark.createDataFrame([(version, time.time_ns(), n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The current version's rows; before the first there is none, which is an error."""
    last = manifest(spark, folder).orderBy(F.desc("published_at")).first()
    if last is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/data/{last.version}")


def publish_months(rows: DataFrame, months: DataFrame, folder: str, checks: dict[str, Column] | None = None, month: str = "coverage_month") -> str:
    """Replaces whole months: those named get the rows given for them, or none. Rows of other months are an error."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    named = months.select(month).distinct()
    path = f"{folder}/data/version={version}"
    _staged(rows, path, checks or {}, (month,))
    # the rows are worked out once: what was written is asked, not they
    counted = spark.read.schema(rows.schema).parquet(path).groupBy(month).agg(F.count(F.lit(1)).alias("n_rows"))
    if counted.join(named, month, "left_anti").limit(1).count():
        raise AuditError("rows of a month that is not replaced")
    entry = named.join(counted, month, "left").select(month, F.lit(version).alias("version"), F.lit(time.time_ns()).alias("published_at"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def current_months(spark: SparkSession, folder: str, schema: str, month: str = "coverage_month") -> tuple[DataFrame, DataFrame]:
    """Rows of each month's current version, and what each month holds: (month, version, n_rows), emptied ones too."""
    known = manifest(spark, folder, f"{month} date, {MANIFEST}")
    newest = Window.partitionBy(month).orderBy(F.desc("published_at"))
    held = known.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").select(month, "version", "n_rows")
    stored = spark.read.schema(f"{schema}, version string").parquet(f"{folder}/data")
    return stored.join(held.select(month, "version"), [month, "version"], "left_semi").drop("version"), held
