"""Reading codes, numbers, dates, ratios, actions and addresses."""

from datetime import date

import pytest

from pyspark.sql import functions as F
from steadyield.functions import text


def read(spark, function, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in rows.select("k", function("v")).orderBy("k").collect()]


def test_codes(spark):
    assert read(spark, text.security_code, "13320", "130A0", "1332.0", " ７２０３ ", "72", None, "7203A") == ["1332", "130A", "1332", "7203", None, None, None]


def test_numbers(spark):
    assert read(spark, text.number, "1,234", "△5", "(12.5)", "-", "１２円", "1e3", "", "abc", None) == [1234.0, -5.0, -12.5, None, 12.0, 1000.0, None, None, None]
    assert read(spark, text.whole_number, "12", "1.5", "-3", "7.0") == [12, None, None, 7]


def test_days(spark):
    assert read(spark, text.day, "2024.10.30", "2024/1/5", "2024-02-30", "x") == [date(2024, 10, 30), date(2024, 1, 5), None, None]


@pytest.mark.parametrize(
    ("description", "factor", "kind", "unreadable"),
    [
        ("1:2 株式分割", 0.5, "1", False),
        ("1:3 分割", 0.3333333333, "1", False),
        ("1:1.2 分割", 0.8333333333, "1", False),
        ("10:1 株式併合", 10.0, "2", False),
        ("5:1 株式併合", 5.0, "2", False),
        ("1:0.1 株主無償割当て", 0.9090909091, "1", False),
        ("新株予約権の株主無償割当て", 1.0, "3", False),
        ("株主割当", 1.0, "3", False),
        ("1:2 受益権分割", None, None, False),
        ("分割比率 割当率", None, None, False),
        ("株式分割", None, "1", True),
        ("株式併合", None, "2", True),
        ("その他", None, None, False),
        (None, None, None, False),
    ],
)
def test_actions(spark, description, factor, kind, unreadable):
    made = read(spark, text.action, description)[0]
    assert (None if made.factor is None else float(made.factor), made.kind, made.unreadable) == (factor, kind, unreadable)


def test_forms(spark):
    assert read(spark, text.nfkc, "ｱ１ Ⅳ", None) == ["ア1 IV", None]
    assert read(spark, lambda c: text.collapsed(F.col(c)), "a \n b ") == ["a b"]


def test_filing_addresses(spark):
    got = read(spark, text.filing_id, "https://viewer.example/view/S100ABCD.pdf", "https://viewer.example/view?S100ABCD,,", "https://viewer.example/view", "S100ABCD")
    assert got == ["S100ABCD", "S100ABCD", None, None]


def test_signed_numbers(spark):
    got = spark.createDataFrame([(v,) for v in ("+5", "-5", "5.", " 7 ", "(3)", "12", "1.50", "+", "１２")], "v string").select(text.number("v").alias("n")).collect()
    assert [r.n for r in got] == [5, -5, 5, 7, -3, 12, 1.5, None, 12]


def test_found_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in ("1,234円", "(45)", "△1,5", "－", "n/a", "１２株", "1.5E3", "", None, "カ1,234", "ウ12", "/", "▲ 7", "12 34", "-8")], "v string")
    got = [tuple(r) for r in rows.select(text.found_number(F.col("v")), text.found_number(F.col("v"), quoted=True)).collect()]
    assert got == [(1234.0, 1234.0), (-45.0, 45.0), (-15.0, -15.0), (None, None), (None, None), (12.0, 12.0), (1500.0, 1.5), (None, None), (None, None), (1234.0, 1234.0), (12.0, 12.0), (None, None), (7.0, -7.0), (12.0, 1234.0), (-8.0, -8.0)]
