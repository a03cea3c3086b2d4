"""Valuation ratios of listed securities from their latest price and latest annual filing.

A ratio whose inputs are missing, or whose denominator has no meaning, is null:
"cannot be judged" is not the same as zero. Only the share of treasury stock
turns to zero when unknown, because it enters other ratios as a deduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVESTMENT_HAIRCUT = 0.7


def latest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def latest_prices(prices: DataFrame) -> DataFrame:
    """Latest price of each security that has a close."""
    return latest_per(prices.filter("close_price is not null"), "security_code", F.desc("trading_date"), F.desc_nulls_last("updated_at"), F.desc("daily_price_id"))


def latest_financials(financials: DataFrame) -> DataFrame:
    """Latest annual filing of each security; unknown times come last."""
    return latest_per(financials, "security_code", F.desc("fiscal_period_end"), F.desc_nulls_last("submitted_at"), F.desc_nulls_last("extracted_at"), F.desc("annual_financial_id"))


def with_submission(financials: DataFrame, filings: DataFrame) -> DataFrame:
    """The financials with the time their filing was submitted; one whose filing is not listed has none."""
    times = filings.select("doc_id", "submitted_at")
    return financials.drop("submitted_at").join(times, "doc_id", "left")


def ratio(above: Column, below: Column, where: Column, scale: float = 1.0) -> Column:
    value = above.cast("double") / below.cast("double")
    return F.when(where, value * scale if scale != 1.0 else value)


def with_ratios(base: DataFrame) -> DataFrame:
    """All ratios of a row with close_price and the columns of an annual filing."""
    c = F.col
    treasury = F.when(c("treasury_shares") <= c("issued_shares"), c("treasury_shares")).otherwise(F.lit(0))
    market_cap = F.when(c("close_price").isNotNull() & c("issued_shares").isNotNull(), c("close_price") * c("issued_shares"))
    net_cash = c("current_assets_jpy") + c("investment_securities_jpy") * INVESTMENT_HAIRCUT - c("liabilities_jpy")
    valued = base.withColumns(
        {
            "market_capitalization_jpy": market_cap,
            "market_capitalization_million_yen": market_cap / 1_000_000,
            "per_ratio": ratio(c("close_price"), c("eps_yen"), c("eps_yen") > 0),
            "pbr_ratio": ratio(c("close_price"), c("bps_yen"), c("bps_yen") > 0),
            "roe_percent": ratio(c("net_income_jpy"), c("equity_jpy"), c("equity_jpy") > 0, 100.0),
            "roa_percent": ratio(c("net_income_jpy"), c("total_assets_jpy"), c("total_assets_jpy") > 0, 100.0),
            "equity_ratio_percent": ratio(c("equity_jpy"), c("total_assets_jpy"), c("total_assets_jpy") > 0, 100.0),
            "operating_profit_margin_percent": ratio(c("operating_profit_jpy"), c("revenue_jpy"), c("revenue_jpy") != 0, 100.0),
            "net_income_margin_percent": ratio(c("net_income_jpy"), c("revenue_jpy"), c("revenue_jpy") != 0, 100.0),
            "dividend_yield_percent": ratio(c("annual_dividend_yen"), c("close_price"), c("close_price") > 0, 100.0),
            "payout_ratio_percent": ratio(c("annual_dividend_yen"), c("eps_yen"), c("eps_yen") > 0, 100.0),
            "free_cash_flow_jpy": c("operating_cash_flow_jpy") + c("investing_cash_flow_jpy"),
            "treasury_shares_ratio_percent": F.coalesce(ratio(c("treasury_shares"), c("issued_shares"), (c("issued_shares") > 0) & (c("treasury_shares") <= c("issued_shares")), 100.0), F.lit(0.0)),
            "net_cash_jpy": net_cash,
            "investment_efficiency_10y": ratio(c("eps_yen") * 10 + c("bps_yen"), c("close_price"), c("close_price") > 0),
        }
    )
    # what the business costs beyond its cash, in years of profit
    price_of_business = c("close_price") * (c("issued_shares") - treasury) - c("net_cash_jpy")
    return valued.withColumn("per_undervaluation_years", ratio(price_of_business, c("net_income_jpy"), (c("issued_shares") > 0) & (c("net_income_jpy") > 0)))


def screener_base(securities: DataFrame, prices: DataFrame, financials: DataFrame) -> DataFrame:
    """One row for each active security, with or without a price and a filing."""
    price = latest_prices(prices).select("security_code", "trading_date", "close_price")
    filing = latest_financials(financials)
    return with_ratios(securities.filter("is_active").join(price, "security_code", "left").join(filing, "security_code", "left"))


def sheet_indicators(financials: DataFrame, prices: DataFrame) -> DataFrame:
    """The older report's ratios: successful filings only, net assets where equity is missing."""
    filing = latest_financials(financials.filter("extraction_status = 'success'")).withColumn("equity_jpy", F.coalesce("equity_jpy", "net_assets_jpy"))
    return with_ratios(filing.join(latest_prices(prices).select("security_code", "close_price"), "security_code", "left"))


def indicator_report(combined: DataFrame) -> DataFrame:
    """Rows for people: money in millions, ratios to two places, dividend histories as text."""
    from steadyield.operators.dividends import history_text

    money = ["market_capitalization_jpy", "free_cash_flow_jpy", "net_cash_jpy", "revenue_jpy", "net_income_jpy"]
    ratios = ["per_ratio", "pbr_ratio", "roe_percent", "roa_percent", "equity_ratio_percent", "operating_profit_margin_percent", "net_income_margin_percent", "dividend_yield_percent", "payout_ratio_percent", "per_undervaluation_years", "investment_efficiency_10y"]
    shown = combined.filter("annual_financial_id is not null and close_price is not null")
    return shown.select(
        "security_code", "company_name", "trading_date", "close_price",
        *((F.round(F.col(c) / 10_000) / 100).alias(c.replace("_jpy", "_million_yen")) for c in money),
        *(F.round(c, 2).alias(c) for c in ratios),
        "progressive_dividend_status_5y", history_text("fiscal_periods_5y", "annual_dividends_yen_5y").alias("dividend_history"),
    )


def match_rate(matched: DataFrame) -> float:
    """Share of rows with a price; an empty table counts as none."""
    return matched.agg(F.avg(F.when(F.col("status") == "matched", 1.0).otherwise(0.0))).first()[0] or 0.0


def match_prices(securities: DataFrame, prices: DataFrame, least: float = 0.8) -> DataFrame:
    """Active securities with their latest close and whether they have one; a rate below least is an error at once."""
    price = latest_prices(prices).select("security_code", "trading_date", "close_price")
    matched = securities.filter("is_active").select("security_code").join(price, "security_code", "left").withColumn("status", F.when(F.col("close_price").isNotNull(), "matched").otherwise("no_price"))
    if (rate := match_rate(matched)) < least:
        raise ValueError(f"only {rate:.1%} of the securities have a price")
    return matched


def combined_view(base: DataFrame, raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Ratios, raw record and adjusted record of each security of the base; a security without a record has nulls."""
    return base.join(raw, "security_code", "left").join(adjusted, "security_code", "left")
