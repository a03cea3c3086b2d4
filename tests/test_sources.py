"""Readers of landed files."""

from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from steadyield.operators import facts as fact_ops
from steadyield.sources import readers, schemas


def test_bar_and_rights_rows(spark):
    bars = spark.createDataFrame([("13320", date(2024, 1, 1), 1.0, None), ("13320", date(2024, 1, 2), 0.5, "1"), ("13320", date(2024, 1, 3), 1.0, "9")], "code string, effective_date date, adjustment_factor double, ex_right_type string")
    assert [(r.security_code, r.is_quarantined) for r in readers.bar_actions(bars).orderBy("effective_date").collect()] == [("1332", False), ("1332", True)]
    rows = [("f", 1, 1, "プライム", ["9301", "三菱倉庫", "2024.10.30", "2024.10.31", "1:2 株式分割"]), ("f", 1, 2, None, ["9302", "x", "2024.10.30", "10:1 株式併合"]), ("f", 2, 1, "外国株", ["9303", "x", "2024.10.30", "1:2 株式分割"]), ("f", 2, 2, None, ["9304", "x", "2024.10.30", "1:2 株式分割"])]
    got = readers.rights_rows(spark.createDataFrame(rows, "source string, page_no int, row_no int, section string, cells array<string>")).orderBy("security_code").collect()
    assert [(r.security_code, r.effective_date, float(r.adjustment_factor), r.ex_right_type, r.section) for r in got] == [("9301", date(2024, 10, 30), 0.5, "1", "プライム"), ("9302", date(2024, 10, 30), 10.0, "2", "プライム")]


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x/list.html", '<a href="../d/140120240101.pdf">配当 <b>予想</b></a><a name=q>no</a>'), (2, None, None)], "page_id long, url string, html string")
    got = [tuple(r) for r in readers.listed_links(pages).collect()]
    assert got == [(1, 0, "http://a.example/d/140120240101.pdf", "配当 予想", "140120240101")]


def test_filing_lists(spark):
    rows = [("a", "010", "120", "会社", 1, "7203", "E1"), ("a", "010", "120", "会社", 2, "", "E1"), ("b", "010", "120", "投資信託", 1, "1", "E2"), ("c", "020", "120", "x", 1, "1", "E2"), ("d", "010", "999", "x", 1, "1", "E2")]
    listing = spark.createDataFrame(rows, "doc_id string, ordinance_code string, type_code string, filer_name string, list_no int, security_code string, filer_code string")
    kept = readers.annual_filings(listing)
    assert [(r.doc_id, r.list_no) for r in kept.collect()] == [("a", 2)]
    codes = spark.createDataFrame([("E1", "7203")], "filer_code string, security_code string")
    assert readers.with_codes(kept, codes).first().security_code == "7203"


def test_typed_rows(spark):
    rows = spark.createDataFrame([("1", "1,000", "2024/3/31"), ("2", "x", "2024/3/31"), ("", "1", "2024/3/31")], "code string, sales string, d string")
    good, bad = readers.typed(rows, {"code": "string", "sales": "long", "d": "date"}, ("code",), millions=("sales",))
    assert [tuple(r) for r in good.collect()] == [("1", 1_000_000_000, date(2024, 3, 31))] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.at_least(good, 2)


def fact(row_no, element, value, **more):
    return Row(**{"doc_id": "d", "row_no": row_no, "element_id": element, "label": "", "context_id": "CurrentYearInstant", "relative_year": "当期", "consolidated": "", "unit": "円", "value": value, **more})


def metrics_of(spark, *rows):
    return fact_ops.extract_metrics(spark.createDataFrame(list(rows))).first()


def test_metrics(spark):
    got = metrics_of(
        spark,
        fact(1, "x:TotalNumberOfSharesHeldTreasurySharesEtc", "500", unit="円"),
        fact(2, "x:TotalNumberOfSharesHeldTreasurySharesEtc", "300", unit="shares"),
        fact(3, "x:NetSales", "10", context_id="Prior1YearDuration", relative_year="前期"),
        fact(4, "x:NetSales", "20", context_id="CurrentYearDuration"),
        fact(5, "x:NetSales", "30", context_id="CurrentYearDuration"),
        fact(6, "x:DividendPaidPerShareSummaryOfBusinessResults", "－"),
        fact(7, "x:Assets", "－"),
        fact(8, "x:AccountingStandardsDEI", "IFRS"),
    )
    assert (got.treasury_shares, got.revenue, got.dividend_per_share, got.total_assets, got.standard, got.n_found) == (300.0, 20.0, 0.0, None, "IFRS", 4)


def test_rivals(spark):
    """The owners' profit, common shares and the year's own context win."""
    got = metrics_of(spark, fact(1, "x:ProfitLoss", "900"), fact(2, "x:ProfitLossAttributableToOwnersOfParent", "700"))
    assert got.net_income == 700.0
    got = metrics_of(spark, fact(1, "x:NetIncome", "1", context_id="CurrentYearDuration_NonConsolidatedMember"), fact(2, "x:NetIncome", "2", context_id="CurrentYearDuration"))
    assert got.net_income == 2.0
    issued = "x:TotalNumberOfIssuedSharesSummaryOfBusinessResults"
    got = metrics_of(spark, fact(1, issued, "5", context_id="CurrentYearInstant_PreferredStockMember"), fact(2, issued, "1000", context_id="CurrentYearInstant_CommonStockMember"))
    assert got.shares_issued == 1000.0
    got = metrics_of(spark, fact(1, "x:NumberOfSharesHeldInOwnNameTreasurySharesEtc", "4", unit="株"), fact(2, "x:TotalNumberOfSharesHeldTreasurySharesEtc", "9", unit="株"), fact(3, "x:TreasuryStock", "1", label="自己株式"))
    assert got.treasury_shares == 9.0


def test_standard_scope_and_periods(spark):
    rows = [
        fact(1, "x:Other", "日本基準", label="会計基準"), fact(2, "x:AccountingStandardsDEI", "IFRS", context_id=""), fact(3, "x:AccountingStandardsDEI", "Japan GAAP", context_id="FilingDateInstant"),
        fact(4, "jpigp_cor:Assets", "1"), fact(5, "jppfs_cor:Assets", "2", context_id="Prior1YearInstant"), fact(6, "x:CurrentFiscalYearStartDateDEI", "2023-04-01"), fact(7, "x:Some", "2024-03-31", label="当事業年度終了日、DEI"),
        fact(8, "x:Some", "なし", label="連結決算の有無"), fact(9, "x:Liabilities", "3", consolidated="連結"), fact(10, "x:Liabilities", "4", consolidated="個別"), fact(11, "x:Own", "6", label="流動資産計、 連結経営指標等"),
    ]
    got = metrics_of(spark, *rows)
    assert (got.standard, got.is_consolidated, got.total_assets, got.period_start, got.period_end, got.liabilities, got.current_assets) == ("Japan GAAP", False, 2.0, "2023-04-01", "2024-03-31", 4.0, 6.0)
    assert metrics_of(spark, fact(1, "x:Some", "y")).n_found == 0
    assert fact_ops.extract_metrics(spark.createDataFrame(rows).limit(0)).count() == 0
    by_file = metrics_of(spark, fact(1, "x:AccountingStandardsDEI", "IFRS", source_file="f/x.csv"), fact(2, "Assets", "1", source_file="f/jppfs_1.csv"), fact(3, "Assets", "2", source_file="f/jpigp_1.csv"))
    assert by_file.total_assets == 2.0


def test_overrides(spark):
    rows = spark.createDataFrame([("d", "1", "p", None), ("e", "2", "p", 5.0)], "doc_id string, security_code string, fiscal_period_end string, x double")
    fit = spark.createDataFrame([("d", "1", "p", 9.0)], "doc_id string, security_code string, fiscal_period_end string, x double")
    assert sorted((r.doc_id, r.x) for r in fact_ops.apply_overrides(rows, fit, ("x",)).collect()) == [("d", 9.0), ("e", 5.0)]
    wrong = fit.withColumn("security_code", F.lit("7"))
    with pytest.raises(Exception, match="does not fit"):
        fact_ops.apply_overrides(rows, wrong, ("x",)).collect()


@pytest.mark.parametrize("name", sorted(schemas.SCHEMAS))
def test_declared_tables(spark, tmp_path, name):
    """An old file that lacks columns, and one with more, read under the declared ones."""
    first = schemas.schema(name)[0]
    spark.sql(f"SELECT CAST(NULL AS {first.dataType.simpleString()}) AS {first.name}, 1 AS other").write.parquet(f"file://{tmp_path}/{name}")
    got = schemas.read_table(spark, f"file://{tmp_path}", name)
    assert [f.name for f in got.schema] == [f.name for f in schemas.schema(name)] and len(set(got.columns)) == len(got.columns) and got.count() == 1
    rows = schemas.conform(spark.sql(f"SELECT 'x' AS other, CAST(NULL AS STRING) AS {first.name}"), name)
    assert rows.schema.simpleString() == schemas.schema(name).simpleString() and rows.count() == 1
    assert schemas.conform(rows.limit(0), name).count() == 0


def test_values_that_cannot_be_cast(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schemas.conform(spark.sql("SELECT 'soon' AS trading_date"), "prices").collect()


def test_quotations(spark):
    """The shapes of the exchange's table: blank sessions, marks, signs, a row without a unit."""
    full = ["72030", "100", "トヨタ\n自動車", "4,000", "4,050", "3,990", "4,035.5", "4,040", "4,060", "4,010", "4,055", "カ4,054", "△35", "4,035.5", "12.3", "50.1"]
    late = ["130A", "1", "x", "－", "－", "－", "－", "10", "12", "9", "10", "/", "＋10", "", "", ""]
    rows = [(1, full), (2, late), (3, ["7203", "", *full[2:]]), (4, full[:15]), (5, ["コード", *full[1:]]), (6, None)]
    got = {r.n: r for r in readers.quotations(spark.createDataFrame(rows, "n int, cells array<string>")).collect()}
    assert sorted(got) == [1, 2]
    one, two = got[1], got[2]
    assert (one.security_code, one.quoted_name, one.trading_unit, one.open_price, one.high_price, one.low_price, one.close_price) == ("7203", "トヨタ 自動車", 100.0, 4000.0, 4060.0, 3990.0, 4055.0)
    assert (one.final_quote, one.change, one.previous_close, one.vwap, one.volume, one.turnover) == (4054.0, -35.0, 4090.0, 4035.5, 12.3, 50.1) and abs(one.change_percent + 3500 / 4090) < 1e-9
    assert (two.open_price, two.high_price, two.low_price, two.close_price, two.final_quote, two.previous_close, two.change_percent) == (10.0, 12.0, 9.0, 10.0, None, 0.0, None)


def test_only_domestic_shares_are_listed(spark):
    rows = spark.createDataFrame([("7203", "プライム（内国株式）"), ("1301", "スタンダード（内国株式）"), ("9999", "プライム（外国株式）"), ("1306", "ETF・ETN"), ("5000", "prime"), ("6000", None)], "code string, segment string")
    got = readers.listed_securities(rows, {"security_code": ("code",), "market": ("segment",)}).collect()
    assert [(r.security_code, r.market) for r in got] == [("7203", "prime"), ("1301", "standard")]
