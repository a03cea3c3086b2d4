"""Adjustment of dividends and the coverage that it needs."""

from datetime import date, datetime

import pytest

from steadyield.operators import adjust

ACTION = "security_code string, effective_date date, adjustment_factor double, ex_right_type string"
PERIOD = "security_code string, annual_financial_id long, fiscal_period_end date, annual_dividend_yen double"


def day(text):
    return date.fromisoformat(text)


@pytest.mark.parametrize(
    ("period", "dividend", "actions", "factor", "adjusted", "rejected"),
    [
        ("2021-03-31", 100.0, [("2023-10-01", 0.5, "1")], 0.5, 50.0, False),
        ("2021-03-31", 100.0, [("2023-10-01", 0.1, "1")], 0.1, 10.0, False),
        ("2021-03-31", 10.0, [("2023-10-01", 5.0, "2")], 5.0, 50.0, False),
        ("2021-03-31", 100.0, [("2022-10-01", 0.5, "1"), ("2023-10-01", 0.2, "1")], 0.1, 10.0, False),
        ("2023-10-01", 100.0, [("2023-10-01", 0.5, "1")], 1.0, 100.0, False),
        ("2023-09-30", 100.0, [("2023-10-01", 0.5, "1")], 0.5, 50.0, False),
        ("2021-03-31", 100.0, [("2023-10-01", 0.8, "3")], 1.0, None, True),
        ("2021-03-31", 100.0, [("2023-10-01", 1.0, "3")], 1.0, 100.0, False),
        ("2021-03-31", 100.0, [("2023-10-01", 0.8, None)], 1.0, None, True),
        ("2021-03-31", 100.0, [("2025-10-01", 0.5, "1")], 1.0, 100.0, False),
        ("2021-03-31", 100.0, [], 1.0, 100.0, False),
    ],
)
def test_single_periods(spark, period, dividend, actions, factor, adjusted, rejected):
    periods = spark.createDataFrame([("1", 1, day(period), dividend)], PERIOD)
    rows = spark.createDataFrame([("1", day(d), f, k) for d, f, k in actions], ACTION)
    got = adjust.adjust_dividends(periods, rows, "2024-12-31").first()
    assert (pytest.approx(got.factor), got.is_rejected) == (factor, rejected)
    assert got.adjusted_dividend_yen == adjusted


def month(text):
    return day(text + "-01")


def coverage(spark, *, snapshots, watchlist=(), covered_to="2026-08", skip=(), latest="2026-10-01"):
    months = [f"{y}-{m:02d}" for y in range(2021, 2027) for m in range(1, 13)]
    months = [m for m in months if m <= covered_to and m not in skip]
    last = lambda m: day(f"{m}-{[31, 28 + (int(m[:4]) % 4 == 0), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][int(m[5:]) - 1]}")
    sources = spark.createDataFrame([(month(m), last(m), "complete") for m in months], "coverage_start date, coverage_end date, sync_status string")
    shots = spark.createDataFrame([(month(m), 1, n, datetime.fromisoformat(f)) for m, n, f in snapshots], "coverage_month date, source_count int, record_count int, fetched_at timestamp")
    listed = spark.createDataFrame([(month(m), c) for m, c in watchlist], "coverage_month date, security_code string")
    prices = spark.createDataFrame([("1", day(latest), 100.0)], "security_code string, trading_date date, close_price double")
    metrics = spark.createDataFrame([("1", day("2021-03-31")), ("2", None)], "security_code string, oldest_fiscal_period_end_5y date")
    got = adjust.adjustment_coverage(metrics, spark.createDataFrame([], ACTION), sources, shots, listed, prices).collect()
    return {r.security_code: r.range_is_complete for r in got}


SOUND = [("2026-09", 0, "2026-10-02T00:00:00"), ("2026-10", 0, "2026-10-02T00:00:00")]


def test_pending_months_are_bridged(spark):
    assert coverage(spark, snapshots=SOUND)["1"] is True
    assert not coverage(spark, snapshots=SOUND)["2"]
    assert coverage(spark, snapshots=SOUND[1:])["1"] is False
    assert coverage(spark, snapshots=[("2026-09", 0, "2026-09-24T00:00:00"), SOUND[1]])["1"] is False
    assert coverage(spark, snapshots=[("2026-09", 1, "2026-10-02T00:00:00"), SOUND[1]])["1"] is False
    assert coverage(spark, snapshots=[("2026-09", 1, "2026-10-02T00:00:00"), SOUND[1]], watchlist=[("2026-09", "1")])["1"] is False
    assert coverage(spark, snapshots=[("2026-09", 1, "2026-10-02T00:00:00"), SOUND[1]], watchlist=[("2026-09", "9")])["1"] is True


def test_gaps_and_no_pending_months(spark):
    assert coverage(spark, snapshots=SOUND, skip=("2023-05",))["1"] is False
    assert coverage(spark, snapshots=[], latest="2026-08-20")["1"] is True


def test_actions_of_several_sources(spark):
    periods = spark.createDataFrame([("1", 1, day("2021-03-31"), 100.0, 1, None)], "security_code string, annual_financial_id long, fiscal_period_end date, annual_dividend_yen double, recent_period_rank int, previous_fiscal_period_end date")
    coverage = spark.createDataFrame([("1", day("2020-01-01"), day("2026-01-01"), True, 0)], "security_code string, covered_from date, covered_to date, range_is_complete boolean, unsupported_action_count long")
    actions = spark.createDataFrame([("1", day("2023-10-01"), 0.5, "1", s) for s in ("exchange", "vendor")], ACTION + ", source string")
    assert adjust.adjusted_periods(periods, coverage, actions, source="exchange").first().adjusted_annual_dividend_yen == 50.0
    with pytest.raises(ValueError):
        adjust.adjusted_periods(periods, coverage, actions)
