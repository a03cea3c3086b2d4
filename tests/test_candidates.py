"""The screen, its reasons, changes and requests."""

import hashlib

import pytest

from steadyield.operators.candidates import Criteria, SearchRequest, candidates, changes, exclusion_reasons, full_report, reason_breakdown, reasons_for, search, with_evidence_only

COLUMNS = "security_code string, annual_financial_id long, close_price double, is_adjustment_coverage_complete boolean, is_progressive_dividend_5y_adjusted boolean, is_progressive_dividend_5y_raw boolean, progressive_dividend_status_5y_adjusted string, progressive_dividend_status_5y string, dividend_yield_percent double, payout_ratio_percent double, per_ratio double, pbr_ratio double, roe_percent double, per_undervaluation_years double, investment_efficiency_10y double, free_cash_flow_jpy double, dividend_cagr_5y_adjusted_percent double, dividend_cagr_5y_percent double, adjusted_annual_dividends_yen_5y array<double>"
GOOD = {"annual_financial_id": 1, "close_price": 100.0, "is_adjustment_coverage_complete": True, "is_progressive_dividend_5y_adjusted": True, "is_progressive_dividend_5y_raw": True, "progressive_dividend_status_5y_adjusted": "progressive", "progressive_dividend_status_5y": "progressive", "dividend_yield_percent": 4.0, "payout_ratio_percent": 40.0, "per_ratio": 10.0, "pbr_ratio": 1.0, "roe_percent": 12.0, "per_undervaluation_years": 3.0, "investment_efficiency_10y": 2.0, "free_cash_flow_jpy": 5.0, "dividend_cagr_5y_adjusted_percent": 3.0, "dividend_cagr_5y_percent": 3.0, "adjusted_annual_dividends_yen_5y": [1.0, 2.0]}
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def table(spark, *rows):
    return spark.createDataFrame([tuple({"security_code": str(k), **GOOD, **r}[n] for n in NAMES) for k, r in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "beyond the first 300"),
        ({"dividend_yield_percent": 2.5}, "yield too low (2.50%)"),
        ({"dividend_yield_percent": None}, "yield unknown"),
        ({"payout_ratio_percent": 70.5}, "payout out of range (70.50%)"),
        ({"per_ratio": 26.0}, "PER too high (26.00x)"),
        ({"per_ratio": 0.0}, "PER unknown"),
        ({"pbr_ratio": 3.25}, "PBR too high (3.25x)"),
        ({"roe_percent": 7.0}, "ROE too low (7.00%)"),
        ({"per_undervaluation_years": 6.0}, "too many years of profit (6.00y)"),
        ({"investment_efficiency_10y": 1.5}, "efficiency too low (1.50)"),
        ({"free_cash_flow_jpy": 0.0}, "free cash flow not positive"),
        ({"is_progressive_dividend_5y_adjusted": False, "progressive_dividend_status_5y_adjusted": "dividend_cut"}, "dividend cut within five periods"),
        ({"annual_financial_id": None}, "price or filing missing"),
    ],
)
def test_one_reason_each(spark, change, reason):
    rows = table(spark, change)
    assert list(exclusion_reasons(rows, Criteria()).first().reasons) == [reason]
    assert candidates(rows, Criteria()).count() == (reason.startswith("beyond") or "missing" in reason)


def test_bounds(spark):
    edge = {"payout_ratio_percent": 0.0, "dividend_yield_percent": 3.0, "per_ratio": 25.0, "pbr_ratio": 3.0, "roe_percent": 8.0, "per_undervaluation_years": 5.5, "investment_efficiency_10y": 1.7}
    assert candidates(table(spark, edge), Criteria()).count() == 1


def test_ranking_and_changes(spark):
    rows = table(spark, {"dividend_yield_percent": 4.0}, {"dividend_yield_percent": 5.0}, {"dividend_cagr_5y_adjusted_percent": None}, {"dividend_cagr_5y_adjusted_percent": 9.0})
    order = [r.security_code for r in candidates(rows, Criteria()).collect()]
    assert order == ["1", "3", "0", "2"]
    now, before = rows.filter("security_code <> '1'"), rows.filter("security_code <> '3'")
    got = {(r.security_code, r.change) for r in changes(now, before, "v").collect()}
    assert got == {("3", "added"), ("1", "removed")}
    assert changes(now, before.limit(0), "v").count() == 0


def test_ids_follow_from_both_lists(spark):
    rows = table(spark, {}, {}, {}, {})
    now, before = rows.filter("security_code in ('2', '1')"), rows.filter("security_code in ('1', '3')")
    stamp = lambda n, b, v="v": {r.event_id.split(":")[0] for r in changes(n, b, v).collect()}
    assert stamp(now, before) == {hashlib.sha256(b"previous_version=v\nprevious=1,3\ncurrent=1,2").hexdigest()[:20]}
    assert len(stamp(now, before) | stamp(now, before.limit(1)) | stamp(now, before, "w") | stamp(rows, before)) == 4


def test_breakdown(spark):
    rows = table(spark, {"roe_percent": 1.0}, {"roe_percent": 2.0}, {"per_ratio": 30.0})
    got = [(r.reason, r.n) for r in reason_breakdown(exclusion_reasons(rows, Criteria())).orderBy("place").collect()]
    assert got == [("ROE too low", 2), ("PER too high", 1)]


def test_search(spark):
    rows = table(spark, *({"roe_percent": float(k)} for k in range(30)))
    got = search(rows, SearchRequest(sort="roe", limit=5)).collect()
    assert [r.roe_percent for r in got] == [29.0, 28.0, 27.0, 26.0, 25.0, 24.0] and got[0].latest_adjusted_dividend_yen == 2.0
    for bad in ({"limit": 0}, {"limit": 21}, {"sort": "x"}, {"max_per_ratio": -1.0}, {"max_per_ratio": float("nan")}, {"max_pbr_ratio": 0.0}, {"max_payout_ratio_percent": 0.0}, {"min_dividend_yield_percent": -1.0}, {"require_positive_free_cash_flow": 1}, {"limit": True}, {"min_roe_percent": None}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


def test_search_has_the_screens_defaults(spark):
    rows = table(spark, {}, {"free_cash_flow_jpy": 0.0}, {"pbr_ratio": 3.5}, {"roe_percent": 7.9}, {"per_undervaluation_years": 6.0}, {"investment_efficiency_10y": 1.6}, {"per_ratio": None})
    assert [r.security_code for r in search(rows, SearchRequest()).collect()] == ["0"]


def test_first_run_is_what_the_caller_says(spark):
    rows = table(spark, {}, {})
    none = rows.limit(0)
    assert changes(rows, none, "v", first_run=False).count() == 2 and changes(rows, none, "v", first_run=True).count() == 0
    assert changes(rows, none, "v").count() == 0


def test_settings(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "name string, value string")
    got = Criteria.from_settings(rows(("min_roe_percent", "9.5"), ("require_positive_free_cash_flow", "FALSE"), ("max_candidates", "10")))
    assert (got.min_roe_percent, got.require_positive_free_cash_flow, got.max_candidates, got.max_per_ratio) == (9.5, False, 10, 25.0)
    for bad in ([("nope", "1")], [("min_roe_percent", " ")], [("min_roe_percent", "1"), ("min_roe_percent", "2")], [("max_candidates", "0")], [("require_positive_free_cash_flow", "maybe")]):
        with pytest.raises(ValueError):
            Criteria.from_settings(rows(*bad))


def test_evidence_only(spark):
    rows = table(spark, {}, {"dividend_yield_percent": 3.5}, {"roe_percent": 1.0})
    proof = spark.createDataFrame([("0", "u0", True, "2024-01-01"), ("1", "u1", False, "2024-01-02"), ("2", "u2", True, "2024-01-03")], "security_code string, evidence_url string, is_confirmed boolean, published_date string")
    listed = candidates(rows, Criteria(max_candidates=1))
    got = sorted((r.security_code, r.part, r.evidence_url) for r in with_evidence_only(listed, rows, proof, Criteria(max_candidates=1)).collect())
    assert got == [("0", 1, "u0"), ("1", 2, "u1")]


def test_all_settings_are_read(spark):
    many = spark.createDataFrame([("min_roe_percent", "9")] + [(f"other_{k}", "1") for k in range(150)], "name string, value string")
    with pytest.raises(ValueError, match="unknown"):
        Criteria.from_settings(many)
    with pytest.raises(ValueError, match="twice"):
        Criteria.from_settings(spark.createDataFrame([("min_roe_percent", "9")] * 150, "name string, value string"))


def test_asked_for_codes_without_data(spark):
    asked = spark.createDataFrame([("0",), ("9",), ("9",)], "security_code string")
    got = {r.security_code: list(r.reasons) for r in reasons_for(asked, exclusion_reasons(table(spark, {"roe_percent": 1.0}), Criteria())).collect()}
    assert got == {"0": ["ROE too low (1.00%)"], "9": ["no data"]}


def test_report_notes_the_record(spark):
    from datetime import date

    from pyspark.sql import functions as F

    rows = table(spark, {}, {"is_adjustment_coverage_complete": False}).withColumns({"part": F.when(F.col("security_code") == "0", 1).otherwise(2), "evidence_url": F.when(F.col("security_code") == "1", "u")})
    need = {"company_name": "string", "dividend_adjustment_status": "string", "latest_cumulative_adjustment_factor": "double", "oldest_cumulative_adjustment_factor_5y": "double"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in need.items() if c not in rows.columns})
    rows = rows.withColumns({"adjusted_fiscal_periods_5y": F.array(F.lit(date(2024, 3, 31)), F.lit(date(2025, 3, 31))), "adjusted_annual_dividends_yen_5y": F.array(F.lit(None).cast("double"), F.lit(2.5))})
    policies = spark.createDataFrame([("1", "confirmed")], "security_code string, classification string")
    got = {r.security_code: (r.note, r.record_used, r.added_reason, r.has_text_evidence, r.classification, r.adjusted_history) for r in full_report(rows, policies).collect()}
    history = "2024-03-31:missing / 2025-03-31:2.5"
    assert got == {"0": ("restated for splits", "adjusted", "meets the conditions", False, None, history), "1": ("not restated: check corporate actions", "raw", "policy text evidence", True, "confirmed", history)}


def test_criteria_from_variables_and_defaults(spark):
    got = Criteria.from_environment({"CANDIDATE_MIN_ROE_PERCENT": " 9.5 ", "CANDIDATE_MAX_ROWS": "20", "CANDIDATE_MAX_POLICY_TEXT_ROWS": "0", "CANDIDATE_REQUIRE_POSITIVE_FREE_CASH_FLOW": "False", "CANDIDATE_MAX_PER_RATIO": " ", "OTHER": "x"})
    assert got == Criteria(min_roe_percent=9.5, max_candidates=20, max_evidence_only=0, require_positive_free_cash_flow=False)
    for bad in ({"CANDIDATE_MAX_PER_RATIO": "0"}, {"CANDIDATE_MAX_ROWS": "5001"}, {"CANDIDATE_MAX_ROWS": "1.5"}, {"CANDIDATE_MIN_ROE_PERCENT": "nan"}, {"CANDIDATE_REQUIRE_POSITIVE_FREE_CASH_FLOW": "yes"}):
        with pytest.raises(ValueError):
            Criteria.from_environment(bad)
    settings = spark.createDataFrame([("max_per_ratio", "20")], "name string, value string")
    whole = Criteria.completed(settings)
    assert whole.count() == 10 and Criteria.from_settings(whole) == Criteria(max_per_ratio=20.0)
    assert "PER <= 20" in Criteria.from_settings(whole).describe()
