"""The audit of all stored tables over rows with planted breaches, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.operators.constraints import catalogue_audit
from steadyield.plans.standins import Inputs
from steadyield.sources import schemas

_SHA = "'" + "0a" * 32 + "'"
_ANALYSED = {"security_code": "'7203'", "company_name": "'c'", "url": "'https://x'", "content_sha256": _SHA, "content_length_bytes": "1", "http_status_code": "200", "page_count": "1", "extracted_text_length": "1", "status": "'completed'", "classification": "'confirmed'", "evidence_page_number": "1", "analyzer_version": "'v'", "attempts": "0"}
_BAD_ANALYSIS = {
    "security_code is not blank": ("security_code", "' '"), "company_name is not blank": ("company_name", "''"), "url is not blank": ("url", "' '"), "analyzer_version is not blank": ("analyzer_version", "''"), "content_length_bytes is at least 0": ("content_length_bytes", "-1"), "page_count is at least 0": ("page_count", "-1"),
    "extracted_text_length is at least 0": ("extracted_text_length", "-1"), "evidence_page_number is at least 1": ("evidence_page_number", "0"), "attempts is at least 0": ("attempts", "-1"), "classification is known": ("classification", "'maybe'"), "url has its shape": ("url", "'http://x'"), "content_sha256 has its shape": ("content_sha256", "'0A'"),
    "http_status_code is an HTTP status": ("http_status_code", "99"), "completed ones have a classification": ("classification", "NULL"), "others have none": ("status", "'pending'"),
}
_ID = "CAST(k AS STRING)"
_DAY, _MONTH = "DATE '2024-01-31'", "DATE '2024-01-01'"
# For each table: the rows' numbers, what a sound row holds, and by rule the column and value that break it, for its remainder of the number by 101.
PLANTED: dict[str, tuple[str, dict[str, str], dict[str, tuple[str, str]]]] = {
    "securities": ("SELECT c_custkey AS k FROM customer", {"security_code": _ID, "company_name": "'c'"}, {"security_code is there": ("security_code", "NULL"), "company_name is there": ("company_name", "NULL"), "company_name is not blank": ("company_name", "'  '")}),
    "prices": ("SELECT o_orderkey AS k FROM orders", {"security_code": _ID, "trading_date": _DAY, "source": "'s'"}, {"security_code is there": ("security_code", "NULL"), "trading_date is there": ("trading_date", "NULL"), "source is not blank": ("source", "''")}),
    "filings": ("SELECT o_orderkey AS k FROM orders", {"doc_id": _ID}, {"doc_id is there": ("doc_id", "NULL")}),
    "financials": ("SELECT o_orderkey AS k FROM orders", {"security_code": "'7203'", "doc_id": _ID, "extracted_item_count": "3", "issued_shares": "5"}, {"security_code is there": ("security_code", "NULL"), "doc_id is there": ("doc_id", "NULL"), "extracted_item_count is at least 0": ("extracted_item_count", "-1"), "issued_shares is at least 0": ("issued_shares", "-5")}),
    "actions": ("SELECT o_orderkey AS k FROM orders", {"security_code": "'7203'", "effective_date": _DAY, "adjustment_factor": "0.5", "ex_right_type": "'1'", "source": "'s'", "source_url": "'u'"}, {"security_code is there": ("security_code", "NULL"), "effective_date is there": ("effective_date", "NULL"), "adjustment_factor is there": ("adjustment_factor", "NULL"), "adjustment_factor is positive": ("adjustment_factor", "0"), "ex_right_type is known": ("ex_right_type", "'4'"), "source is not blank": ("source", "' '"), "source_url is not blank": ("source_url", "''")}),
    "sync_status": ("SELECT c_custkey AS k FROM customer", {"security_code": _ID, "requested_from": _MONTH, "requested_to": _DAY, "covered_from": _MONTH, "covered_to": _DAY, "sync_status": "'complete'", "api_record_count": "1", "action_record_count": "0"}, {"requested days are in order": ("requested_to", "DATE '2023-12-31'"), "covered days are in order": ("covered_from", "DATE '2024-02-01'"), "sync_status is known": ("sync_status", "'done'"), "api_record_count is at least 0": ("api_record_count", "-1"), "action_record_count is at least 0": ("action_record_count", "-2")}),
    "sources": ("SELECT o_orderkey AS k FROM orders", {"source_kind": "'monthly_pdf'", "coverage_start": _MONTH, "coverage_end": _DAY, "content_sha256": _SHA, "sync_status": "'complete'", "record_count": "1", "source_url": "'u'"}, {"source_kind is known": ("source_kind", "'web'"), "covered days are in order": ("coverage_end", "DATE '2023-01-01'"), "content_sha256 has its shape": ("content_sha256", "'zz'"), "record_count is at least 0": ("record_count", "-1"), "source_url is not blank": ("source_url", "' '"), "status and result agree": ("last_error", "'e'")}),
    "snapshots": ("SELECT c_custkey AS k FROM customer", {"coverage_month": "CAST(add_months(DATE '1900-01-01', CAST(k AS INT)) AS DATE)", "content_sha256": _SHA, "source_count": "1", "record_count": "0", "source_url": "'u'"}, {"content_sha256 is there": ("content_sha256", "NULL"), "coverage_month is there": ("coverage_month", "NULL"), "source_url is not blank": ("source_url", "''"), "source_count is at least 1": ("source_count", "0"), "record_count is at least 0": ("record_count", "-1"), "content_sha256 has its shape": ("content_sha256", "'x'")}),
    "watchlist": ("SELECT o_orderkey AS k FROM orders", {"coverage_month": _MONTH, "security_code": "'7203'", "allocation_date": _DAY, "adjustment_factor": "0.5", "source_url": "'u'"}, {"source_url is not blank": ("source_url", "''"), "security_code has its shape": ("security_code", "'72'"), "adjustment_factor is positive": ("adjustment_factor", "-1"), "allocation_date is in its month": ("allocation_date", "DATE '2024-02-01'")}),
    "results": ("SELECT event_id AS k FROM events", {"disclosure_id": _ID, "title": "'t'"} | _ANALYSED, {"disclosure_id is there": ("disclosure_id", "NULL"), "title is not blank": ("title", "' '")} | _BAD_ANALYSIS),
    "report_results": ("SELECT o_orderkey AS k FROM orders", {"doc_id": _ID} | _ANALYSED, {"doc_id is there": ("doc_id", "NULL")} | _BAD_ANALYSIS),
}
SPREAD = 101


def planted(x: Inputs, name: str) -> DataFrame:
    """A table's rows; number n of its rules is broken where the row's number leaves n divided by SPREAD."""
    rows, sound, bad = PLANTED[name]
    cells = dict(sound)
    for n, (column, value) in enumerate(bad.values(), 1):
        cells[column] = f"CASE WHEN k % {SPREAD} = {n} THEN {value} ELSE {cells.get(column, 'NULL')} END"
    return schemas.conform(x.sql(rows).selectExpr("k", *(f"{text} AS {c}" for c, text in cells.items())), name)


def table_constraints(x: Inputs) -> DataFrame:
    """All rules of all tables; every seventh security is stored twice, and only its table is a parent."""
    tables = {name: planted(x, name) for name in PLANTED}
    again = tables["securities"].filter("CAST(security_code AS BIGINT) % 7 = 0")
    tables["securities"] = tables["securities"].unionByName(again)
    own = ("prices", "securities")
    report = catalogue_audit({name: tables[name] for name in own}).unionByName(catalogue_audit({n: t for n, t in tables.items() if n not in own and n not in ("filings", "snapshots")}))
    return report.unionByName(catalogue_audit({"filings": tables["filings"]})).unionByName(catalogue_audit({"snapshots": tables["snapshots"]})).filter("violations > 0").select(F.col("table").alias("stored_table"), "rule", "violations")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"table_constraints": lambda spark, sf_dir: table_constraints(Inputs(spark, sf_dir))}


def _counts() -> str:
    """Each planted rule with the rows that it falls on; others that the same value breaks are added apart."""
    parts = [f"SELECT '{name}' AS stored_table, '{rule.replace(chr(39), chr(39) * 2)}' AS rule, count(*) AS violations FROM ({rows}) WHERE k % {SPREAD} = {n}" for name, (rows, _, bad) in PLANTED.items() for n, rule in enumerate(bad, 1)]
    return " UNION ALL ".join(parts)


def _also(name: str, rule: str, by: str) -> str:
    rows, _, bad = PLANTED[name]
    return f"SELECT '{name}', '{rule}', count(*) FROM ({rows}) WHERE k % {SPREAD} = {list(bad).index(by) + 1}"


SQL = {
    "table_constraints": f"""WITH planted AS ({_counts()}
      -- a blank address isn't one, a failed check of a source's hash leaves it complete
      UNION ALL {_also('results', 'url has its shape', 'url is not blank')} UNION ALL {_also('report_results', 'url has its shape', 'url is not blank')}
      UNION ALL SELECT 'securities', 'unique security_code', count(*) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % {SPREAD} <> 1
      UNION ALL SELECT 'securities', rule, sum(n) FROM (SELECT 'company_name is there' AS rule, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % {SPREAD} = 2 UNION ALL SELECT 'company_name is not blank', count(*) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % {SPREAD} = 3) GROUP BY rule
      UNION ALL SELECT 'prices', 'security_code exists', count(*) FROM orders WHERE o_orderkey % {SPREAD} <> 1 AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % {SPREAD} <> 1))
      SELECT stored_table, rule, CAST(sum(violations) AS BIGINT) AS violations FROM planted GROUP BY ALL HAVING sum(violations) > 0""",
}
