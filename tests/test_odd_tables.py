"""Queries agree with their SQL on copies of the smallest tables that hold rows which these lack."""

from pathlib import Path

import duckdb
import pytest
from test_registry import QUERIES, SQL, rows

from steadyield.operators.candidates import Criteria, exclusion_reasons
from steadyield.operators.dividends import raw_metrics


@pytest.fixture(scope="module")
def without_orders(sf, tmp_path_factory):
    """An active customer without orders, whose number is asked for."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        if path.stem == "customer":
            con.execute(f"COPY (SELECT * FROM '{path}' UNION ALL SELECT * REPLACE (77 * 1001 AS c_custkey) FROM '{path}' WHERE c_custkey = 1) TO '{folder}/customer.parquet'")
        elif path.stem == "supplier":
            con.execute(f"COPY (SELECT * FROM '{path}' UNION ALL SELECT * REPLACE (11 * 1001 AS s_suppkey) FROM '{path}' WHERE s_suppkey = 1) TO '{folder}/supplier.parquet'")
        else:
            (folder / path.name).symlink_to(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{folder}/{path.name}'")
    yield str(folder), con
    con.close()


@pytest.mark.parametrize("name", ["raw_dividends", "exclusion_reasons", "reason_breakdown", "asked_reasons"])
def test_securities_without_filings_equal_the_sql(spark, without_orders, name):
    folder, con = without_orders
    df, wanted = QUERIES[name](spark, folder), con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in wanted.description], wanted.fetchall())


def test_security_without_filings_has_no_regular_periods(spark):
    financials = spark.createDataFrame([], "security_code string, annual_financial_id long, fiscal_period_end date, submitted_at timestamp, extracted_at timestamp, annual_dividend_yen double")
    got = raw_metrics(spark.createDataFrame([("1",)], "security_code string"), financials).first()
    assert (got.recent_period_count, got.progressive_dividend_status_5y, got.is_progressive_dividend_5y_raw) == (0, "irregular_fiscal_periods", None)


@pytest.mark.parametrize(("value", "shown"), [(0.125, "0.12"), (0.375, "0.38"), (1.005, "1.00"), (2.625, "2.62"), (-1234.5, "-1234.50")])
def test_values_in_reasons_are_rounded_as_printf_does(spark, value, shown):
    row = spark.sql(f"""SELECT '1' AS security_code, 1 AS annual_financial_id, 1.0D AS close_price, true AS is_adjustment_coverage_complete, true AS is_progressive_dividend_5y_adjusted, true AS is_progressive_dividend_5y_raw, 'progressive' AS progressive_dividend_status_5y_adjusted, 'progressive' AS progressive_dividend_status_5y,
        9.0D AS dividend_yield_percent, 50.0D AS payout_ratio_percent, 9.0D AS per_ratio, 1.0D AS pbr_ratio, {value}D AS roe_percent, 1.0D AS per_undervaluation_years, 9.0D AS investment_efficiency_10y, 1.0D AS free_cash_flow_jpy""")
    assert list(exclusion_reasons(row, Criteria()).first().reasons) == [f"ROE too low ({shown}%)"]
    assert duckdb.sql(f"SELECT printf('%.2f', CAST({value} AS DOUBLE))").fetchall() == [(shown,)]


@pytest.mark.parametrize("name", ["latest_wins", "audited_upsert"])
def test_lines_with_equal_numbers_give_one_result(spark, sf, tmp_path, name):
    """Line 8 of a part and line 7 of the part 1,000,000 above it have one number, so the SQL leaves open which wins."""
    got = []
    for way in ("", " DESC"):
        folder = tmp_path / f"lines{len(got)}"
        folder.mkdir()
        (folder / "orders.parquet").symlink_to(f"{sf}/orders.parquet")
        last = f"SELECT DISTINCT ON (l_orderkey) * FROM '{sf}/lineitem.parquet'"
        tied = f"SELECT * REPLACE (8 AS l_linenumber, 5 AS l_partkey) FROM ({last}) UNION ALL SELECT * REPLACE (7 AS l_linenumber, 1000005 AS l_partkey) FROM ({last})"
        duckdb.sql(f"COPY (SELECT * FROM (SELECT * FROM '{sf}/lineitem.parquet' UNION ALL {tied}) ORDER BY l_linenumber{way}, l_partkey) TO '{folder}/lineitem.parquet'")
        df = QUERIES[name](spark, str(folder))
        got.append(rows(df.columns, df.collect()))
    lines = duckdb.sql(f"SELECT count(DISTINCT l_orderkey) FROM '{sf}/lineitem.parquet'").fetchall()[0][0]
    assert got[0] == got[1] and sum("1e+06" in r for r in got[0]) == lines
