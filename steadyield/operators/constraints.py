"""The stored tables' constraints as data, and their audit in one pass over each table.

A rule is a condition on a row under a name. A row breaks it only where the
condition is false: one that gives null isn't broken, as in a database, so a
column that must be there has a rule of its own. Keys and parents take a
grouping and a join more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.operators.quality import audit, orphans, repeated_keys, rule_violations


@dataclass(frozen=True)
class Constraints:
    """Columns that must be there, that must not be blank, that are not below a bound, that are one of some words, that have a shape; further conditions; keys; parents by column."""

    present: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()
    least: dict[str, int] = field(default_factory=dict)
    among: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shaped: dict[str, str] = field(default_factory=dict)
    conditions: dict[str, str] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    parents: dict[str, str] = field(default_factory=dict)

    def rules(self) -> dict[str, str]:
        """Every rule on a single row as SQL, by name."""
        quoted = lambda words: ", ".join(f"'{w}'" for w in words)
        return (
            {f"{c} is there": f"{c} IS NOT NULL" for c in self.present} | {f"{c} is not blank": f"trim({c}) <> ''" for c in self.filled} | {f"{c} is at least {n}": f"{c} >= {n}" for c, n in self.least.items()}
            | {f"{c} is known": f"{c} IN ({quoted(words)})" for c, words in self.among.items()} | {f"{c} has its shape": f"{c} RLIKE '{shape}'" for c, shape in self.shaped.items()} | self.conditions
        )


# Words, bounds and shapes that the stored columns keep to.
SHA256, HTTPS, CODE = "^[0-9a-f]{64}$", "^https://", "^[0-9A-Z]{4}$"
_ANALYSIS = {
    "filled": ("security_code", "company_name", "url", "analyzer_version"),
    "least": {"content_length_bytes": 0, "page_count": 0, "extracted_text_length": 0, "evidence_page_number": 1, "attempts": 0},
    "among": {"status": ("pending", "completed", "fetch_failed", "text_extraction_failed"), "classification": ("confirmed", "not_confirmed", "manual_review")},
    "shaped": {"url": HTTPS, "content_sha256": SHA256},
    "conditions": {"http_status_code is an HTTP status": "http_status_code BETWEEN 100 AND 599", "completed ones have a classification": "status <> 'completed' OR classification IS NOT NULL", "others have none": "status = 'completed' OR classification IS NULL"},
}
_MONTH = {"coverage_month is a month's first day": "coverage_month = trunc(coverage_month, 'MM')"}
CATALOGUE: dict[str, Constraints] = {
    "securities": Constraints(present=("security_code", "company_name"), filled=("security_code", "company_name"), keys=(("security_code",),)),
    "prices": Constraints(present=("security_code", "trading_date"), filled=("source",), keys=(("security_code", "trading_date", "source"),), parents={"security_code": "securities"}),
    "filings": Constraints(present=("doc_id",), filled=("doc_id",), keys=(("doc_id",),), parents={"security_code": "securities"}),
    "financials": Constraints(present=("security_code", "doc_id"), least={"extracted_item_count": 0, "issued_shares": 0}, keys=(("doc_id",),), parents={"security_code": "securities", "doc_id": "filings"}),
    "actions": Constraints(present=("security_code", "effective_date", "adjustment_factor"), filled=("source", "source_url"), among={"ex_right_type": ("1", "2", "3")}, conditions={"adjustment_factor is positive": "adjustment_factor > 0"}, parents={"security_code": "securities"}),
    "sync_status": Constraints(least={"api_record_count": 0, "action_record_count": 0}, among={"sync_status": ("complete", "partial", "failed")}, conditions={"requested days are in order": "requested_from <= requested_to", "covered days are in order": "covered_from <= covered_to"}, keys=(("security_code",),)),
    "sources": Constraints(
        filled=("source_url",), least={"record_count": 0}, among={"source_kind": ("monthly_pdf", "daily_excel"), "sync_status": ("complete", "failed")}, shaped={"content_sha256": SHA256},
        conditions={"covered days are in order": "coverage_start <= coverage_end", "status and result agree": "(sync_status = 'complete' AND content_sha256 IS NOT NULL AND last_error IS NULL) OR (sync_status = 'failed' AND last_error IS NOT NULL)"},
    ),
    "snapshots": Constraints(present=("coverage_month", "content_sha256"), filled=("source_url",), least={"source_count": 1, "record_count": 0}, shaped={"content_sha256": SHA256}, conditions=_MONTH, keys=(("coverage_month",),)),
    "watchlist": Constraints(filled=("source_url",), shaped={"security_code": CODE}, conditions=_MONTH | {"allocation_date is in its month": "allocation_date >= coverage_month AND allocation_date < add_months(coverage_month, 1)", "adjustment_factor is positive": "adjustment_factor > 0"}, parents={"coverage_month": "snapshots"}),
    "results": Constraints(present=("disclosure_id",), **(_ANALYSIS | {"filled": ("disclosure_id", "title", *_ANALYSIS["filled"])}), keys=(("disclosure_id",),)),
    "report_results": Constraints(present=("doc_id",), **(_ANALYSIS | {"filled": ("doc_id", *_ANALYSIS["filled"])}), keys=(("doc_id",),)),
}


def catalogue_audit(tables: dict[str, DataFrame], catalogue: dict[str, Constraints] = CATALOGUE) -> DataFrame:
    """Rows (table, rule, violations) for every rule of the tables given; a parent that isn't given is not looked for.

    Violations of a key count the keys that repeat, of a parent the rows
    without one. Empty tables have none.
    """
    parts = []
    for name, df in tables.items():
        c = catalogue[name]
        parts.append(rule_violations(df, name, {rule: F.expr(text) for rule, text in c.rules().items()}))
        parts += [repeated_keys(df, name, *key) for key in c.keys]
        parts += [orphans(df, name, column, tables[parent], catalogue[parent].keys[0][0]) for column, parent in c.parents.items() if parent in tables]
    return audit(*parts)
