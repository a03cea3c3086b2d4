"""The catalogue of constraints."""

from pyspark.sql import functions as F

from steadyield.operators.constraints import CATALOGUE, catalogue_audit
from steadyield.sources import schemas

SHA = "ab" * 32


def audited(spark, name, *rows, **others):
    df = schemas.conform(spark.createDataFrame([{k: v for k, v in r.items()} for r in rows]), name)
    return {(r.table, r.rule): r.violations for r in catalogue_audit({name: df, **others}).collect() if r.violations}


def test_every_table_and_column_is_declared(spark):
    assert set(CATALOGUE) == set(schemas.SCHEMAS)
    for name, c in CATALOGUE.items():
        columns = {f.name for f in schemas.schema(name)}
        used = {*c.present, *c.filled, *c.least, *c.among, *c.shaped, *c.parents, *(k for key in c.keys for k in key)}
        assert used <= columns, name
    assert sum(len(c.rules()) + len(c.keys) + len(c.parents) for c in CATALOGUE.values()) > 85


def test_cross_column_rules(spark):
    base = {"source_kind": "monthly_pdf", "source_url": "u", "record_count": 0}
    rows = [{**base, "sync_status": s, "content_sha256": h, "last_error": e} for s, h, e in (("complete", SHA, None), ("failed", None, "x"), ("complete", None, None), ("failed", SHA, None), ("complete", SHA, "x"))]
    assert audited(spark, "sources", *rows) == {("sources", "status and result agree"): 3}
    done = {"disclosure_id": "1", "analyzer_version": "v", "attempts": 0, "url": "https://x", "security_code": "1", "company_name": "c", "title": "t"}
    rows = [{**done, "disclosure_id": str(k), "status": s, "classification": c} for k, (s, c) in enumerate((("completed", "confirmed"), ("completed", None), ("pending", "confirmed"), ("pending", None)))]
    assert audited(spark, "results", *rows) == {("results", "completed ones have a classification"): 1, ("results", "others have none"): 1}


def test_nulls_keys_parents_and_empty_tables(spark):
    rows = [{"security_code": c, "company_name": "x"} for c in ("1", "1", None, None)]
    securities = schemas.conform(spark.createDataFrame(rows), "securities")
    assert audited(spark, "securities", *rows) == {("securities", "unique security_code"): 1, ("securities", "security_code is there"): 2}
    prices = [{"security_code": c, "trading_date": "2024-01-01", "source": "s"} for c in ("1", "2", "2")]
    assert audited(spark, "prices", *prices, securities=securities.limit(0)) == {("prices", "security_code exists"): 3, ("prices", "unique security_code, trading_date, source"): 1}
    for name in CATALOGUE:
        empty = schemas.conform(spark.range(0).select(F.col("id").alias("x")), name)
        assert catalogue_audit({name: empty}).agg(F.sum("violations")).first()[0] == 0
