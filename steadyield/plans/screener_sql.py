"""The screener's registered queries as SQL for another engine, for comparison."""

from __future__ import annotations

from steadyield.operators.candidates import Criteria, SearchRequest
from steadyield.plans.screener_queries import LOOSE, RATIOS, SEARCH, TIGHT
from steadyield.plans.standins import AS_OF, with_stand_ins

_LATEST = """
price AS (SELECT * FROM prices WHERE close_price IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY trading_date DESC, updated_at DESC NULLS LAST, daily_price_id DESC) = 1),
filing AS (SELECT * FROM financials
  QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY fiscal_period_end DESC, submitted_at DESC NULLS LAST, extracted_at DESC NULLS LAST, annual_financial_id DESC) = 1)"""

_BASE = (
    _LATEST
    + """,
base0 AS (SELECT s.security_code, s.company_name, s.market, p.trading_date, p.close_price, f.* EXCLUDE (security_code),
    CASE WHEN treasury_shares <= issued_shares THEN treasury_shares ELSE 0 END AS deducted,
    current_assets_jpy + investment_securities_jpy * CAST(0.7 AS DOUBLE) - liabilities_jpy AS net_cash_jpy
  FROM securities s LEFT JOIN price p USING (security_code) LEFT JOIN filing f USING (security_code) WHERE s.is_active),
base AS (SELECT *, close_price * issued_shares AS market_capitalization_jpy, close_price * issued_shares / 1000000 AS market_capitalization_million_yen,
    CASE WHEN eps_yen > 0 THEN close_price / eps_yen END AS per_ratio, CASE WHEN bps_yen > 0 THEN close_price / bps_yen END AS pbr_ratio,
    CASE WHEN equity_jpy > 0 THEN net_income_jpy / equity_jpy * 100 END AS roe_percent,
    CASE WHEN total_assets_jpy > 0 THEN net_income_jpy / total_assets_jpy * 100 END AS roa_percent,
    CASE WHEN total_assets_jpy > 0 THEN equity_jpy / total_assets_jpy * 100 END AS equity_ratio_percent,
    CASE WHEN revenue_jpy <> 0 THEN operating_profit_jpy / revenue_jpy * 100 END AS operating_profit_margin_percent,
    CASE WHEN revenue_jpy <> 0 THEN net_income_jpy / revenue_jpy * 100 END AS net_income_margin_percent,
    CASE WHEN close_price > 0 THEN annual_dividend_yen / close_price * 100 END AS dividend_yield_percent,
    CASE WHEN eps_yen > 0 THEN annual_dividend_yen / eps_yen * 100 END AS payout_ratio_percent,
    operating_cash_flow_jpy + investing_cash_flow_jpy AS free_cash_flow_jpy,
    CASE WHEN issued_shares > 0 AND treasury_shares <= issued_shares THEN treasury_shares / issued_shares * 100 ELSE 0 END AS treasury_shares_ratio_percent,
    CASE WHEN issued_shares > 0 AND net_income_jpy > 0 THEN (close_price * (issued_shares - deducted) - net_cash_jpy) / net_income_jpy END AS per_undervaluation_years,
    CASE WHEN close_price > 0 THEN (eps_yen * 10 + bps_yen) / close_price END AS investment_efficiency_10y
  FROM base0)"""
)

_PERIODS = """
record AS (SELECT * FROM financials
  QUALIFY row_number() OVER (PARTITION BY security_code, fiscal_period_end ORDER BY submitted_at DESC NULLS LAST, extracted_at DESC NULLS LAST, annual_financial_id DESC) = 1),
period AS (SELECT security_code, annual_financial_id, fiscal_period_end, annual_dividend_yen,
    count(*) OVER (PARTITION BY security_code) AS history, row_number() OVER w AS k,
    lead(fiscal_period_end) OVER w AS before_end, lead(annual_dividend_yen) OVER w AS before_dividend
  FROM record WINDOW w AS (PARTITION BY security_code ORDER BY fiscal_period_end DESC, annual_financial_id DESC) QUALIFY k <= 5)"""

_RAW = (
    _PERIODS
    + """,
raw0 AS (SELECT security_code, max(history) AS history, count(*) AS n, count(annual_dividend_yen) AS n_dividend,
    count(*) FILTER (annual_dividend_yen <= 0) AS n_non_positive,
    count(*) FILTER (k <= 4 AND annual_dividend_yen > before_dividend) AS ups, count(*) FILTER (k <= 4 AND annual_dividend_yen = before_dividend) AS same,
    count(*) FILTER (k <= 4 AND annual_dividend_yen < before_dividend) AS cuts,
    bool_and(fiscal_period_end - before_end BETWEEN 300 AND 430) FILTER (k <= 4) AS regular,
    max(annual_dividend_yen) FILTER (k = 1) AS d1, max(annual_dividend_yen) FILTER (k = 2) AS d2, max(annual_dividend_yen) FILTER (k = 5) AS d5,
    max(fiscal_period_end) FILTER (k = 1) AS e1, max(fiscal_period_end) FILTER (k = 5) AS e5,
    min(k) FILTER (k <= 4 AND (annual_dividend_yen IS NULL OR before_dividend IS NULL OR annual_dividend_yen < before_dividend)) AS fall,
    min(k) FILTER (k <= 4 AND (annual_dividend_yen IS NULL OR before_dividend IS NULL OR annual_dividend_yen <= before_dividend)) AS stall,
    string_agg(CAST(fiscal_period_end AS VARCHAR), ',' ORDER BY fiscal_period_end) AS ends,
    string_agg(coalesce(CAST(CAST(annual_dividend_yen AS BIGINT) AS VARCHAR), 'null'), ',' ORDER BY fiscal_period_end) AS dividends
  FROM period GROUP BY security_code),
raw AS (SELECT s.security_code, coalesce(history, 0) AS available_history_period_count, coalesce(n, 0) AS recent_period_count, coalesce(n_dividend, 0) AS dividend_period_count,
    ups AS dividend_increase_count_5y, same AS dividend_unchanged_count_5y, cuts AS dividend_cut_count_5y, regular AS has_regular_fiscal_periods_5y,
    d1 AS latest_annual_dividend_yen, d2 AS previous_annual_dividend_yen, d5 AS oldest_annual_dividend_yen_5y, e1 AS latest_fiscal_period_end, e5 AS oldest_fiscal_period_end_5y,
    CASE WHEN n_dividend = n THEN coalesce(fall, least(n, 5)) END AS consecutive_non_decrease_periods,
    CASE WHEN n_dividend = n THEN coalesce(stall, least(n, 5)) END AS consecutive_increase_periods,
    ends AS fiscal_periods_5y, dividends AS annual_dividends_yen_5y,
    CASE WHEN n < 5 THEN 'insufficient_history' WHEN n_dividend < 5 THEN 'missing_dividend' WHEN regular IS DISTINCT FROM true THEN 'irregular_fiscal_periods'
      WHEN n_non_positive > 0 THEN 'non_positive_dividend' WHEN cuts > 0 THEN 'dividend_cut' ELSE 'progressive' END AS progressive_dividend_status_5y,
    CASE WHEN n < 5 OR n_dividend < 5 OR regular IS DISTINCT FROM true THEN NULL WHEN n_non_positive > 0 OR cuts > 0 THEN false ELSE true END AS is_progressive_dividend_5y_raw,
    CASE WHEN n >= 5 AND n_dividend >= 5 AND regular AND d1 > 0 AND d5 > 0 THEN round((pow(d1 / d5, 0.25) - 1) * 100, 6) END AS dividend_cagr_5y_percent
  FROM securities s LEFT JOIN raw0 USING (security_code))"""
)

_COVERAGE = """,
market AS (SELECT max(trading_date) AS latest FROM prices WHERE close_price IS NOT NULL),
bounds AS (SELECT min(coverage_start) AS covered_from, max(coverage_end) AS covered_to FROM sources WHERE sync_status = 'complete'),
gaps AS (SELECT count(*) AS n FROM (SELECT CAST(unnest(generate_series(date_trunc('month', covered_from), date_trunc('month', covered_to), INTERVAL 1 MONTH)) AS DATE) AS m FROM bounds)
  WHERE NOT EXISTS (SELECT 1 FROM sources WHERE sync_status = 'complete' AND coverage_start <= m AND coverage_end >= last_day(m))),
pending AS (SELECT count(*) FILTER (s.coverage_month IS NULL OR s.source_count <= 0 OR s.record_count <> coalesce(w.n, 0) OR CAST(s.fetched_at + INTERVAL 9 HOUR AS DATE) < least(last_day(m), latest)) AS bad
  FROM (SELECT CAST(unnest(generate_series(date_trunc('month', covered_to) + INTERVAL 1 MONTH, date_trunc('month', latest), INTERVAL 1 MONTH)) AS DATE) AS m, latest FROM bounds, market)
  LEFT JOIN snapshots s ON s.coverage_month = m LEFT JOIN (SELECT coverage_month, count(*) AS n FROM watchlist GROUP BY 1) w ON w.coverage_month = m),
coverage AS (SELECT r.security_code, covered_from, covered_to,
    gaps.n = 0 AND covered_from <= r.oldest_fiscal_period_end_5y AND latest IS NOT NULL AND (covered_to >= latest OR (covered_to IS NOT NULL AND pending.bad = 0
      AND NOT EXISTS (SELECT 1 FROM watchlist w WHERE w.security_code = r.security_code AND w.coverage_month > covered_to AND w.coverage_month <= date_trunc('month', latest)))) AS range_is_complete,
    (SELECT count(*) FROM actions a WHERE a.security_code = r.security_code AND a.effective_date > r.oldest_fiscal_period_end_5y AND a.effective_date <= covered_to
      AND a.ex_right_type IS DISTINCT FROM '1' AND a.ex_right_type IS DISTINCT FROM '2' AND a.adjustment_factor <> 1) AS unsupported_action_count
  FROM raw r, bounds, market, gaps, pending)"""

_ADJUSTED = """,
scaled0 AS (SELECT p.security_code, p.annual_financial_id, p.fiscal_period_end, p.annual_dividend_yen, p.k, p.before_end, c.range_is_complete, c.unsupported_action_count,
    coalesce(product(a.adjustment_factor), 1) AS f
  FROM period p LEFT JOIN coverage c USING (security_code)
  LEFT JOIN actions a ON a.security_code = p.security_code AND a.effective_date > p.fiscal_period_end AND a.effective_date <= c.covered_to AND a.ex_right_type IN ('1', '2') AND a.adjustment_factor > 0
  GROUP BY ALL),
scaled AS (SELECT *, CASE WHEN range_is_complete AND unsupported_action_count = 0 THEN round(f, 10) END AS factor,
    CASE WHEN range_is_complete AND unsupported_action_count = 0 THEN round(annual_dividend_yen * f, 6) END AS d,
  FROM scaled0),
stepped AS (SELECT *, lead(d) OVER (PARTITION BY security_code ORDER BY fiscal_period_end DESC, annual_financial_id DESC) AS before FROM scaled),
adjusted0 AS (SELECT security_code, bool_and(range_is_complete) AS complete, max(unsupported_action_count) AS blocked, count(*) AS n, count(annual_dividend_yen) AS n_raw, count(d) AS n_adjusted,
    count(*) FILTER (d <= 0) AS n_non_positive, count(*) FILTER (k <= 4 AND d > before) AS ups, count(*) FILTER (k <= 4 AND d = before) AS same, count(*) FILTER (k <= 4 AND d < before) AS cuts,
    bool_and(fiscal_period_end - before_end BETWEEN 300 AND 430) FILTER (k <= 4) AS regular,
    max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 5) AS d5, max(factor) FILTER (k = 1) AS f1, max(factor) FILTER (k = 5) AS f5
  FROM stepped GROUP BY security_code),
adjusted AS (SELECT s.security_code,
    CASE WHEN complete IS NOT TRUE THEN 'adjustment_data_incomplete' WHEN blocked > 0 THEN 'unsupported_corporate_action' ELSE 'complete' END AS dividend_adjustment_status,
    complete IS TRUE AND blocked = 0 AS is_adjustment_coverage_complete, f1 AS latest_cumulative_adjustment_factor, f5 AS oldest_cumulative_adjustment_factor_5y,
    d1 AS latest_adjusted_annual_dividend_yen, d5 AS oldest_adjusted_annual_dividend_yen_5y, ups AS adjusted_increase_count_5y, same AS adjusted_unchanged_count_5y, cuts AS adjusted_cut_count_5y,
    CASE WHEN complete IS NOT TRUE OR blocked > 0 THEN NULL WHEN n < 5 OR n_raw < 5 OR n_adjusted < 5 OR regular IS DISTINCT FROM true THEN NULL WHEN n_non_positive > 0 OR cuts > 0 THEN false ELSE true END AS is_progressive_dividend_5y_adjusted,
    CASE WHEN complete IS NOT TRUE THEN 'adjustment_data_incomplete' WHEN blocked > 0 THEN 'unsupported_corporate_action' WHEN n < 5 THEN 'insufficient_history' WHEN n_raw < 5 OR n_adjusted < 5 THEN 'missing_dividend'
      WHEN regular IS DISTINCT FROM true THEN 'irregular_fiscal_periods' WHEN n_non_positive > 0 THEN 'non_positive_dividend' WHEN cuts > 0 THEN 'dividend_cut' ELSE 'progressive' END AS progressive_dividend_status_5y_adjusted,
    CASE WHEN complete AND blocked = 0 AND n >= 5 AND n_adjusted >= 5 AND regular AND d1 > 0 AND d5 > 0 THEN round((pow(d1 / d5, 0.25) - 1) * 100, 6) END AS dividend_cagr_5y_adjusted_percent
  FROM securities s LEFT JOIN adjusted0 USING (security_code))"""

_ALL = with_stand_ins("securities", "financials", "prices", "actions", "sources", "watchlist", "snapshots") + "," + _BASE + "," + _RAW + _COVERAGE + _ADJUSTED
_COMBINED = _ALL + ",\ncombined AS (SELECT * FROM base LEFT JOIN raw USING (security_code) LEFT JOIN adjusted USING (security_code))"
_GROWTH = "CASE WHEN is_adjustment_coverage_complete THEN dividend_cagr_5y_adjusted_percent ELSE dividend_cagr_5y_percent END"


def _thresholds(k: Criteria | SearchRequest) -> str:
    cash = " AND free_cash_flow_jpy > 0" if k.require_positive_free_cash_flow else ""
    return (
        f"dividend_yield_percent >= {k.min_dividend_yield_percent} AND payout_ratio_percent BETWEEN 0 AND {k.max_payout_ratio_percent}"
        f" AND per_ratio > 0 AND per_ratio <= {k.max_per_ratio} AND pbr_ratio > 0 AND pbr_ratio <= {k.max_pbr_ratio} AND roe_percent >= {k.min_roe_percent} AND per_undervaluation_years <= {k.max_per_discount_years}"
        f" AND investment_efficiency_10y >= {k.min_investment_efficiency}{cash}"
    )


def _met(k: Criteria) -> str:
    return f"is_adjustment_coverage_complete IS TRUE AND is_progressive_dividend_5y_adjusted IS TRUE AND {_thresholds(k)}"


def _list(name: str, k: Criteria) -> str:
    return f",\n{name} AS (SELECT *, {_GROWTH} AS growth_percent FROM combined WHERE {_met(k)} ORDER BY dividend_yield_percent DESC NULLS LAST, growth_percent DESC NULLS LAST, roe_percent DESC NULLS LAST, security_code LIMIT {k.max_candidates})"


def _rounded(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


def _shown(value: str, label: str, unit: str) -> str:
    return f"'{label} (' || printf('%.2f', CAST({value} AS DOUBLE)) || '{unit})'"


def _reasons(k: Criteria) -> str:
    def judged(value: str, name: str, too_far: str, label: str, unit: str, positive: bool = False) -> str:
        absent = f"{value} IS NULL" + (f" OR {value} <= 0" if positive else "")
        return f"CASE WHEN {absent} THEN '{name} unknown' WHEN {too_far} THEN {_shown(value, label, unit)} END"

    status = "coalesce(CASE WHEN is_adjustment_coverage_complete THEN progressive_dividend_status_5y_adjusted ELSE progressive_dividend_status_5y END, '')"
    names = f"CASE {status} WHEN 'dividend_cut' THEN 'dividend cut within five periods' WHEN 'non_positive_dividend' THEN 'no dividend' WHEN 'missing_dividend' THEN 'dividend data missing' WHEN 'irregular_fiscal_periods' THEN 'irregular fiscal periods' WHEN 'insufficient_history' THEN 'history too short' WHEN 'progressive' THEN 'record cannot be judged' WHEN '' THEN 'record cannot be judged' ELSE 'record: ' || {status} END"
    checks = [
        "CASE WHEN annual_financial_id IS NULL OR close_price IS NULL THEN 'price or filing missing' END",
        "CASE WHEN is_adjustment_coverage_complete IS NOT TRUE THEN 'adjustment data incomplete' END",
        f"CASE WHEN (CASE WHEN is_adjustment_coverage_complete THEN is_progressive_dividend_5y_adjusted ELSE is_progressive_dividend_5y_raw END) IS NOT TRUE THEN {names} END",
        judged("dividend_yield_percent", "yield", f"dividend_yield_percent < {k.min_dividend_yield_percent}", "yield too low", "%"),
        judged("payout_ratio_percent", "payout", f"payout_ratio_percent NOT BETWEEN 0 AND {k.max_payout_ratio_percent}", "payout out of range", "%"),
        judged("per_ratio", "PER", f"per_ratio > {k.max_per_ratio}", "PER too high", "x", True),
        judged("pbr_ratio", "PBR", f"pbr_ratio > {k.max_pbr_ratio}", "PBR too high", "x", True),
        judged("roe_percent", "ROE", f"roe_percent < {k.min_roe_percent}", "ROE too low", "%"),
        judged("per_undervaluation_years", "years of profit", f"per_undervaluation_years > {k.max_per_discount_years}", "too many years of profit", "y"),
        judged("investment_efficiency_10y", "efficiency", f"investment_efficiency_10y < {k.min_investment_efficiency}", "efficiency too low", ""),
    ]
    if k.require_positive_free_cash_flow:
        checks.append("CASE WHEN free_cash_flow_jpy IS NULL THEN 'free cash flow unknown' WHEN free_cash_flow_jpy <= 0 THEN 'free cash flow not positive' END")
    return f",\nfound AS (SELECT security_code, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS r0 FROM combined),\nreasons AS (SELECT security_code, CASE WHEN len(r0) > 0 THEN r0 ELSE ['beyond the first {k.max_candidates}'] END AS r FROM found)"


_REPORT = ["dividend_yield_percent", "payout_ratio_percent", "per_ratio", "pbr_ratio", "roe_percent", "per_undervaluation_years", "investment_efficiency_10y", "growth_percent"]
_MILLIONS = ["market_capitalization_jpy", "free_cash_flow_jpy", "net_cash_jpy", "revenue_jpy", "net_income_jpy"]
_SHORT = ["per_ratio", "pbr_ratio", "roe_percent", "roa_percent", "equity_ratio_percent", "operating_profit_margin_percent", "net_income_margin_percent", "dividend_yield_percent", "payout_ratio_percent", "per_undervaluation_years", "investment_efficiency_10y"]

SQL = {
    "screener_base": with_stand_ins("securities", "financials", "prices") + "," + _BASE + f" SELECT security_code, company_name, market, trading_date, close_price, annual_financial_id, fiscal_period_end, {_rounded(*RATIOS)} FROM base",
    "sheet_indicators": with_stand_ins("financials", "prices") + "," + _LATEST.replace("FROM financials", "FROM financials WHERE extraction_status = 'success'")
    + """ SELECT f.security_code, f.annual_financial_id, CASE WHEN total_assets_jpy > 0 THEN round(coalesce(equity_jpy, net_assets_jpy) / total_assets_jpy * 100, 6) END AS equity_ratio_percent,
        CASE WHEN coalesce(equity_jpy, net_assets_jpy) > 0 THEN round(net_income_jpy / coalesce(equity_jpy, net_assets_jpy) * 100, 6) END AS roe_percent, CASE WHEN eps_yen > 0 THEN round(close_price / eps_yen, 6) END AS per_ratio
      FROM filing f LEFT JOIN price p USING (security_code)""",
    "raw_dividends": with_stand_ins("securities", "financials") + "," + _RAW + " SELECT * FROM raw",
    "adjustment_coverage": _ALL + " SELECT * FROM coverage",
    "adjusted_dividends": _ALL + " SELECT * FROM adjusted",
    "single_adjustments": with_stand_ins("financials", "actions") + "," + _PERIODS.split("period AS (SELECT security_code")[0].rstrip().rstrip(",")
    + f""" SELECT r.security_code, r.fiscal_period_end, coalesce(product(a.adjustment_factor) FILTER (a.ex_right_type IN ('1', '2')), 1) AS factor,
        coalesce(bool_or(a.ex_right_type IS DISTINCT FROM '1' AND a.ex_right_type IS DISTINCT FROM '2' AND a.adjustment_factor <> 1) FILTER (a.security_code IS NOT NULL), false) AS is_rejected,
        CASE WHEN NOT is_rejected THEN round(annual_dividend_yen * factor, 6) END AS adjusted_dividend_yen
      FROM record r LEFT JOIN actions a ON a.security_code = r.security_code AND a.effective_date > r.fiscal_period_end AND a.effective_date <= DATE '{AS_OF}'
      GROUP BY r.security_code, r.annual_financial_id, r.fiscal_period_end, r.annual_dividend_yen""",
    "candidate_list": _COMBINED + _list("listed", LOOSE)
    + f" SELECT row_number() OVER (ORDER BY dividend_yield_percent DESC NULLS LAST, growth_percent DESC NULLS LAST, roe_percent DESC NULLS LAST, security_code) AS rank, security_code, company_name, trading_date, close_price, free_cash_flow_jpy, {_rounded(*_REPORT)}, CASE WHEN is_adjustment_coverage_complete THEN 'adjusted' ELSE 'raw' END AS record_used FROM listed",
    "eligible_cache": _COMBINED + f" SELECT security_code, trading_date, {_rounded('dividend_yield_percent', 'roe_percent')}, dividend_cagr_5y_adjusted_percent FROM combined WHERE annual_financial_id IS NOT NULL AND close_price IS NOT NULL AND is_adjustment_coverage_complete AND is_progressive_dividend_5y_adjusted",
    "search_by_growth": _COMBINED + f""" SELECT security_code, dividend_cagr_5y_adjusted_percent, {_rounded('dividend_yield_percent', 'roe_percent')}, d.d1 AS latest_adjusted_dividend_yen
      FROM combined JOIN adjusted0 d USING (security_code) WHERE annual_financial_id IS NOT NULL AND close_price IS NOT NULL AND is_adjustment_coverage_complete AND is_progressive_dividend_5y_adjusted
        AND {_thresholds(SEARCH).replace('dividend_yield_percent', 'combined.dividend_yield_percent', 1)}
      ORDER BY combined.dividend_cagr_5y_adjusted_percent DESC NULLS LAST, combined.dividend_yield_percent DESC NULLS LAST, combined.roe_percent DESC NULLS LAST, security_code LIMIT 21""",
    "candidate_changes": _COMBINED + _list("loose", LOOSE) + _list("tight", TIGHT)
    + """, moved AS (SELECT security_code, 'added' AS change FROM tight WHERE security_code NOT IN (SELECT security_code FROM loose) UNION ALL SELECT security_code, 'removed' FROM loose WHERE security_code NOT IN (SELECT security_code FROM tight)),
      old AS (SELECT coalesce(string_agg(security_code, ',' ORDER BY security_code), '') AS codes FROM loose), new AS (SELECT coalesce(string_agg(security_code, ',' ORDER BY security_code), '') AS codes FROM tight),
      stamp AS (SELECT substr(sha256('previous_version=v1' || chr(10) || 'previous=' || old.codes || chr(10) || 'current=' || new.codes), 1, 20) AS s FROM old, new)
      SELECT s || ':' || change || ':' || security_code AS event_id, security_code, change FROM moved, stamp WHERE (SELECT count(*) FROM loose) > 0""",
    "exclusion_reasons": _COMBINED + _reasons(TIGHT) + " SELECT security_code, len(r) AS n_reasons, array_to_string(r, '; ') AS reasons FROM reasons",
    "reason_breakdown": _COMBINED + _reasons(TIGHT)
    + r""", kinds AS (SELECT DISTINCT security_code, trim(regexp_replace(x, '\s*\([^()]*\)$', '')) AS reason FROM (SELECT security_code, unnest(r) AS x FROM reasons)),
      counted AS (SELECT reason, count(*) AS n FROM kinds GROUP BY reason), placed AS (SELECT *, least(row_number() OVER (ORDER BY n DESC, reason), 6) AS place FROM counted)
      SELECT place, CASE WHEN place > 5 THEN 'others' ELSE min(reason) END AS reason, CAST(sum(n) AS BIGINT) AS n FROM placed GROUP BY place""",
    "share_changes": with_stand_ins("financials") + "," + _PERIODS.split("period AS (SELECT security_code")[0].rstrip().rstrip(",")
    + f""", lagged AS (SELECT security_code, fiscal_period_end, issued_shares, annual_dividend_yen, lag(issued_shares) OVER w AS s0, lag(annual_dividend_yen) OVER w AS d0 FROM record WINDOW w AS (PARTITION BY security_code ORDER BY fiscal_period_end, annual_financial_id))
      SELECT security_code, fiscal_period_end, round(issued_shares / s0, 6) AS share_change_ratio, CASE WHEN issued_shares / s0 >= 1.5 THEN 'split_or_issue_suspected' ELSE 'consolidation_or_cancellation_suspected' END AS kind,
        CASE WHEN d0 > 0 THEN round(annual_dividend_yen / d0, 6) END AS dividend_change_ratio
      FROM lagged WHERE s0 > 0 AND issued_shares > 0 AND fiscal_period_end >= DATE '{AS_OF}' - INTERVAL 72 MONTH AND (issued_shares / s0 >= 1.5 OR issued_shares / s0 <= 0.67)""",
    "unsupported_actions": _ALL + """ SELECT a.security_code, s.company_name, a.effective_date, a.adjustment_factor, CASE WHEN ex_right_type = '3' THEN 'rights_issue' WHEN ex_right_type IS NULL THEN 'unknown_type' ELSE 'other' END AS kind,
        CASE dividend_adjustment_status WHEN 'unsupported_corporate_action' THEN 'not_adjusted' WHEN 'adjustment_data_incomplete' THEN 'range_incomplete' WHEN 'complete' THEN 'adjusted' ELSE 'no_data' END AS adjustment_state
      FROM actions a JOIN securities s ON s.security_code = a.security_code AND s.is_active LEFT JOIN adjusted d ON d.security_code = a.security_code
      WHERE ex_right_type IS DISTINCT FROM '1' AND ex_right_type IS DISTINCT FROM '2' AND adjustment_factor <> 1""",
    "indicator_report": _COMBINED + " SELECT security_code, company_name, trading_date, close_price, progressive_dividend_status_5y, " + ", ".join(f"round(CAST({c} AS DOUBLE) / 10000) / 100 AS {c.replace('_jpy', '_million_yen')}" for c in _MILLIONS) + ", " + ", ".join(f"round({c}, 2) + 0 AS {c}" for c in _SHORT) 
    + """, array_to_string(list_transform(list_zip(string_split(fiscal_periods_5y, ','), string_split(annual_dividends_yen_5y, ',')), lambda p: p[1] || ':' || CASE WHEN p[2] = 'null' THEN 'missing' ELSE p[2] || '.0' END), ' / ') AS dividend_history
      FROM combined WHERE annual_financial_id IS NOT NULL AND close_price IS NOT NULL""",
    "price_matches": with_stand_ins("securities", "financials", "prices") + "," + _LATEST + " SELECT s.security_code, trading_date, close_price, CASE WHEN close_price IS NULL THEN 'no_price' ELSE 'matched' END AS status FROM securities s LEFT JOIN price USING (security_code) WHERE is_active",
    "fetch_range": with_stand_ins("securities", "financials")
    + """, ends AS (SELECT security_code, fiscal_period_end, row_number() OVER (PARTITION BY security_code ORDER BY fiscal_period_end DESC) AS k FROM (SELECT DISTINCT security_code, fiscal_period_end FROM financials)),
      done AS (SELECT min(c) AS covered_to, count(*) FILTER (c IS NULL) AS open FROM (SELECT CASE WHEN CAST(security_code AS BIGINT) % 7 <> 0 THEN DATE '2001-03-31' END AS c FROM securities WHERE is_active))
      SELECT CASE WHEN open = 0 AND covered_to IS NOT NULL THEN covered_to + 1 ELSE (SELECT min(fiscal_period_end) FROM ends WHERE k = 5) END AS fetch_from FROM done""",
}
