"""The screener's input tables, derived from the star-schema tables by plain SQL.

Each text runs unchanged on Spark and on any engine with ordinary SQL, so that
results can be compared. All numbers come from whole parts of the sources'
numbers: sums and quotients of them are the same everywhere. Every text reads
its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-12-31"
COVERED_TO = "2001-05-31"

# c_custkey names the security
SECURITIES = """
SELECT CAST(c_custkey AS STRING) AS security_code, c_name AS company_name, c_custkey % 10 <> 0 AS is_active,
       CASE n_regionkey WHEN 0 THEN 'prime' WHEN 1 THEN 'standard' WHEN 2 THEN 'growth' ELSE 'prime' END AS market,
       c_mktsegment AS industry
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# an order is a filing for its year
FINANCIALS = """
SELECT o_orderkey AS annual_financial_id, CAST(o_orderkey AS STRING) AS doc_id, CAST(o_custkey AS STRING) AS security_code,
       make_date(year(o_orderdate), 12, 31) AS fiscal_period_end,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS submitted_at, o_orderdate AS extracted_at,
       CASE WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'success' END AS extraction_status,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST((year(o_orderdate) - 1990) * 20 + o_custkey % 7 + CASE WHEN o_orderkey % 23 = 0 THEN -45 ELSE 0 END AS DOUBLE) END AS annual_dividend_yen,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 1000 + o_custkey % 100 * 10 + CASE WHEN o_orderkey % 37 = 0 THEN 3000 ELSE 0 END END AS issued_shares,
       o_orderkey % 13 * 100 AS treasury_shares,
       CAST(300 + o_orderkey % 300 AS DOUBLE) AS eps_yen, CAST(1500 + o_orderkey % 2500 AS DOUBLE) AS bps_yen,
       (o_orderkey % 6 - 1) * 200000 + o_custkey AS net_income_jpy, (o_orderkey % 7) * 1000000 AS equity_jpy,
       (o_orderkey % 7) * 1000000 + 500 AS net_assets_jpy, (o_orderkey % 9) * 2500000 AS total_assets_jpy,
       (o_orderkey % 8) * 700000 AS revenue_jpy, (o_orderkey % 5 - 1) * 90000 AS operating_profit_jpy,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE (o_orderkey % 4) * 100000 END AS operating_cash_flow_jpy, -(o_orderkey % 3) * 60000 AS investing_cash_flow_jpy,
       (o_orderkey % 11) * 150000 AS current_assets_jpy, (o_orderkey % 3) * 50000 AS investment_securities_jpy, (o_orderkey % 6) * 120000 AS liabilities_jpy
FROM orders
"""

# the largest whole price of a day's lines is its close
PRICES = """
SELECT CAST(o_custkey AS STRING) AS security_code, CAST(l_shipdate AS DATE) AS trading_date,
       CASE WHEN max(l_orderkey) % 17 = 0 THEN NULL ELSE CAST(max(CAST(floor(l_extendedprice) AS BIGINT)) % 3000 + 700 AS DOUBLE) END AS close_price,
       max(l_shipdate) AS updated_at, max(l_orderkey) AS daily_price_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_custkey, CAST(l_shipdate AS DATE)
"""

ACTIONS = """
SELECT CAST(o_custkey AS STRING) AS security_code, CAST(o_orderdate AS DATE) AS effective_date,
       CASE min(o_orderkey) % 5 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.25 AS DOUBLE) WHEN 2 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS adjustment_factor,
       CASE WHEN min(o_orderkey) % 55 = 0 THEN NULL WHEN min(o_orderkey) % 5 = 2 THEN '2' WHEN min(o_orderkey) % 5 = 3 THEN '3' ELSE '1' END AS ex_right_type
FROM orders WHERE o_orderkey % 7 = 0
GROUP BY o_custkey, CAST(o_orderdate AS DATE)
"""

SOURCES = f"""
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS coverage_start, last_day(CAST(o_orderdate AS DATE)) AS coverage_end,
       'complete' AS sync_status
FROM orders WHERE o_orderdate < CAST('2001-06-01' AS TIMESTAMP)
"""

WATCHLIST = """
SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS coverage_month, CAST(o_custkey AS STRING) AS security_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= CAST('2001-06-01' AS TIMESTAMP) AND l_orderkey % 9 = 0
"""

SNAPSHOTS = f"""
SELECT m.coverage_month, 1 AS source_count, count(w.security_code) AS record_count,
       CAST('2001-12-15' AS TIMESTAMP) AS fetched_at
FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS coverage_month FROM lineitem WHERE l_shipdate >= CAST('2001-06-01' AS TIMESTAMP)) m
LEFT JOIN ({WATCHLIST}) w ON m.coverage_month = w.coverage_month
GROUP BY m.coverage_month
"""

STAND_INS = {"securities": SECURITIES, "financials": FINANCIALS, "prices": PRICES, "actions": ACTIONS, "sources": SOURCES, "watchlist": WATCHLIST, "snapshots": SNAPSHOTS}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


class Inputs:
    """Stand-in tables over one folder of source tables, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        """Runs a text over the source tables that it names, or over those given in their place."""
        import re

        names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        for t in names:
            text = re.sub(rf"(?<=FROM |JOIN ){t}\b", "{" + t + "}", text)
        return self.spark.sql(text, **{t: tables.get(t, self.table(t)) for t in names if "{" + t + "}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        return self.sql(STAND_INS[name])


def with_stand_ins(*names: str) -> str:
    """The WITH clause that gives a text these stand-ins; the engine must know STRING, make_date and last_day."""
    return "WITH " + ",\n".join(f"{n} AS ({STAND_INS[n]})" for n in names)
