"""Registered queries of the screener over the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.operators import adjust, candidates, dividends, screener
from steadyield.plans.standins import AS_OF, Inputs

LOOSE = candidates.Criteria(min_dividend_yield_percent=3.0, max_payout_ratio_percent=95.0, max_per_ratio=25.0, max_pbr_ratio=3.0, min_roe_percent=2.0, max_per_discount_years=60.0, min_investment_efficiency=1.2, require_positive_free_cash_flow=False)
TIGHT = candidates.Criteria(min_dividend_yield_percent=5.0, max_payout_ratio_percent=95.0, max_per_ratio=20.0, max_pbr_ratio=3.0, min_roe_percent=5.0, max_per_discount_years=40.0, min_investment_efficiency=1.7, require_positive_free_cash_flow=True)

SEARCH = candidates.SearchRequest(min_dividend_yield_percent=2.0, max_payout_ratio_percent=120.0, max_per_ratio=30.0, max_pbr_ratio=4.0, min_roe_percent=1.0, max_per_discount_years=80.0, min_investment_efficiency=1.0, require_positive_free_cash_flow=True, sort="cagr", limit=20)

RATIOS = ["market_capitalization_jpy", "market_capitalization_million_yen", "per_ratio", "pbr_ratio", "roe_percent", "roa_percent", "equity_ratio_percent", "operating_profit_margin_percent", "net_income_margin_percent", "dividend_yield_percent", "payout_ratio_percent", "free_cash_flow_jpy", "treasury_shares_ratio_percent", "net_cash_jpy", "per_undervaluation_years", "investment_efficiency_10y"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as delimited text, nulls named, so that any engine can compare them."""
    return df.withColumns({c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",", "null") for c in columns})


def base(x: Inputs) -> DataFrame:
    return screener.screener_base(x.securities, x.prices, x.financials)


def sourced_actions(x: Inputs) -> DataFrame:
    """The actions, and another source's rows of them with factors of its own."""
    return x.actions.withColumn("source", F.lit("exchange")).unionByName(x.actions.withColumns({"source": F.lit("vendor"), "adjustment_factor": F.lit(0.1)}))


def coverage(x: Inputs) -> DataFrame:
    return adjust.adjustment_coverage(dividends.raw_metrics(x.securities, x.financials), sourced_actions(x), x.sources, x.snapshots, x.watchlist, x.prices, source="exchange")


def adjusted(x: Inputs) -> DataFrame:
    return adjust.adjusted_metrics(x.securities, x.financials, coverage(x), sourced_actions(x), source="exchange")


def combined(x: Inputs) -> DataFrame:
    return screener.combined_view(base(x), dividends.raw_metrics(x.securities, x.financials), adjusted(x))


def screener_base(x: Inputs) -> DataFrame:
    return rounded(base(x), *RATIOS).select("security_code", "company_name", "market", "trading_date", "close_price", "annual_financial_id", "fiscal_period_end", *RATIOS)


def sheet_indicators(x: Inputs) -> DataFrame:
    return rounded(screener.sheet_indicators(x.financials, x.prices), "equity_ratio_percent", "roe_percent", "per_ratio").select("security_code", "annual_financial_id", "equity_ratio_percent", "roe_percent", "per_ratio")


def raw_dividends(x: Inputs) -> DataFrame:
    m = dividends.raw_metrics(x.securities, x.financials)
    whole = F.array_join(F.transform("annual_dividends_yen_5y", lambda v: v.cast("long").cast("string")), ",", "null")
    return m.withColumn("annual_dividends_yen_5y", whole).withColumn("fiscal_periods_5y", F.array_join(F.transform("fiscal_periods_5y", lambda v: v.cast("string")), ","))


def adjustment_coverage(x: Inputs) -> DataFrame:
    return coverage(x)


def adjusted_dividends(x: Inputs) -> DataFrame:
    return adjusted(x).select("security_code", "dividend_adjustment_status", "is_adjustment_coverage_complete", "latest_cumulative_adjustment_factor", "oldest_cumulative_adjustment_factor_5y", "latest_adjusted_annual_dividend_yen", "oldest_adjusted_annual_dividend_yen_5y", "adjusted_increase_count_5y", "adjusted_unchanged_count_5y", "adjusted_cut_count_5y", "is_progressive_dividend_5y_adjusted", "progressive_dividend_status_5y_adjusted", "dividend_cagr_5y_adjusted_percent")


def single_adjustments(x: Inputs) -> DataFrame:
    return adjust.adjust_dividends(dividends.one_record_per_period(x.financials), x.actions, AS_OF).select("security_code", "fiscal_period_end", "factor", "adjusted_dividend_yen", "is_rejected")


def candidate_list(x: Inputs) -> DataFrame:
    shown = candidates.candidate_report(candidates.candidates(combined(x), LOOSE))
    return rounded(shown, "dividend_yield_percent", "payout_ratio_percent", "per_ratio", "pbr_ratio", "roe_percent", "per_undervaluation_years", "investment_efficiency_10y", "growth_percent")


def eligible_cache(x: Inputs) -> DataFrame:
    return rounded(candidates.eligible(combined(x)), "dividend_yield_percent", "roe_percent").select("security_code", "trading_date", "dividend_yield_percent", "roe_percent", "dividend_cagr_5y_adjusted_percent")


def search_by_growth(x: Inputs) -> DataFrame:
    found = candidates.search(candidates.eligible(combined(x)), SEARCH)
    return rounded(found, "dividend_yield_percent", "roe_percent").select("security_code", "dividend_cagr_5y_adjusted_percent", "dividend_yield_percent", "roe_percent", "latest_adjusted_dividend_yen")


def candidate_changes(x: Inputs) -> DataFrame:
    c = combined(x)
    return candidates.changes(candidates.candidates(c, TIGHT), candidates.candidates(c, LOOSE), "v1")


def exclusion_reasons(x: Inputs) -> DataFrame:
    return candidates.exclusion_reasons(combined(x), TIGHT).select("security_code", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"))


def reason_breakdown(x: Inputs) -> DataFrame:
    return candidates.reason_breakdown(candidates.exclusion_reasons(combined(x), TIGHT))


def share_changes(x: Inputs) -> DataFrame:
    return rounded(dividends.share_changes(x.financials, AS_OF), "share_change_ratio", "dividend_change_ratio").select("security_code", "fiscal_period_end", "share_change_ratio", "kind", "dividend_change_ratio")


def unsupported_actions(x: Inputs) -> DataFrame:
    return adjust.unsupported_report(x.actions, x.securities, adjusted(x))


def indicator_report(x: Inputs) -> DataFrame:
    return screener.indicator_report(combined(x))


def fetch_range(x: Inputs) -> DataFrame:
    status = x.securities.select("security_code", F.lit("complete").alias("sync_status"), F.when(F.col("security_code").cast("long") % 7 != 0, F.lit("2001-03-31").cast("date")).alias("covered_to"))
    return adjust.fetch_range(x.financials, status, x.securities)


def price_matches(x: Inputs) -> DataFrame:
    return screener.match_prices(x.securities, x.prices, least=0.5)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {f.__name__: f for f in (screener_base, sheet_indicators, raw_dividends, adjustment_coverage, adjusted_dividends, single_adjustments, candidate_list, eligible_cache, search_by_growth, candidate_changes, exclusion_reasons, reason_breakdown, share_changes, unsupported_actions, indicator_report, fetch_range, price_matches)}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for name, f in QUERIES.items()}
