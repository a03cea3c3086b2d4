"""Restating past dividends for splits and consolidations.

A security can be judged only if the sources of corporate actions cover the
whole span from its oldest period to the latest trading day. Months that the
monthly archive has not reached yet may be bridged by complete snapshots of
pending rights, except for securities that stand on such a snapshot's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from steadyield.functions.expr import cagr_percent, count_where, in_time_order, is_true, pick
from steadyield.operators.dividends import PERIODS, _regular, _steps, recent_periods, status_and_verdict

ADJUSTING_TYPES = ("1", "2")


def unsupported(kind: Column, factor: Column) -> Column:
    """An action that moves the share count in a way that is not adjusted for; an unknown type counts."""
    return ~kind.eqNullSafe("1") & ~kind.eqNullSafe("2") & (factor != 1)


def of_source(actions: DataFrame, source: str | None) -> DataFrame:
    """Actions of one source; the same action may stand in another source's rows with other values, so a table that tells sources needs one named."""
    if source is None and "source" in actions.columns:
        raise ValueError("actions of several sources: name the one that counts")
    return actions if source is None else actions.filter(F.col("source") == source)


def known_actions(actions: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions of listed securities, and a report of the codes without one: how many actions each loses."""
    codes = securities.select("security_code").distinct()
    lost = actions.join(codes, "security_code", "left_anti").groupBy("security_code").agg(F.count(F.lit(1)).alias("n_actions"))
    return actions.join(codes, "security_code", "left_semi"), lost


def months_between(start: Column, end: Column) -> Column:
    """First days of the months from start to end, none if they are out of order."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def missing_months(sources: DataFrame) -> DataFrame:
    """Months between the first and the last covered day that no complete source contains."""
    done = sources.filter("sync_status = 'complete'")
    span = done.agg(F.min("coverage_start").alias("a"), F.max("coverage_end").alias("z"))
    months = span.select(F.explode(months_between(F.col("a"), F.col("z"))).alias("month_start"))
    inside = (F.col("coverage_start") <= F.col("month_start")) & (F.col("coverage_end") >= F.last_day("month_start"))
    return months.join(done.select("coverage_start", "coverage_end").distinct(), inside, "left_anti")


def coverage_bounds(sources: DataFrame) -> DataFrame:
    """One row: first and last covered day and whether no month in between is missing."""
    span = sources.filter("sync_status = 'complete'").agg(F.min("coverage_start").alias("covered_from"), F.max("coverage_end").alias("covered_to"))
    gaps = missing_months(sources).agg(F.count(F.lit(1)).alias("gaps"))
    return span.crossJoin(F.broadcast(gaps)).select("covered_from", "covered_to", ((F.col("gaps") == 0) & F.col("covered_from").isNotNull()).alias("months_are_continuous"))


def pending_is_bridged(bounds: DataFrame, snapshots: DataFrame, watchlist: DataFrame) -> DataFrame:
    """The one-row bounds, with latest_trading_date, and whether every pending month has a sound snapshot."""
    months = bounds.select("latest_trading_date", F.explode(months_between(F.add_months("covered_to", 1), F.col("latest_trading_date"))).alias("coverage_month"))
    listed = watchlist.groupBy("coverage_month").agg(F.count(F.lit(1)).alias("listed"))
    fetched = F.to_date(F.from_utc_timestamp("fetched_at", "Asia/Tokyo"))
    bad = F.col("source_count").isNull() | (F.col("source_count") <= 0) | (F.col("record_count") != F.coalesce("listed", F.lit(0))) | (fetched < F.least(F.last_day("coverage_month"), F.col("latest_trading_date")))
    checked = months.join(snapshots.select("coverage_month", "source_count", "record_count", "fetched_at"), "coverage_month", "left").join(listed, "coverage_month", "left")
    verdict = checked.agg(count_where(bad).alias("bad_months"))
    return bounds.crossJoin(F.broadcast(verdict)).withColumn("pending_ok", F.col("covered_to").isNotNull() & (F.col("bad_months") == 0)).drop("bad_months")


def adjustment_coverage(metrics: DataFrame, actions: DataFrame, sources: DataFrame, snapshots: DataFrame, watchlist: DataFrame, prices: DataFrame, source: str | None = None) -> DataFrame:
    """For each security whether its span is covered and how many actions in it cannot be adjusted for."""
    market = prices.filter("close_price is not null").agg(F.max("trading_date").alias("latest_trading_date"))
    status = pending_is_bridged(coverage_bounds(sources).crossJoin(F.broadcast(market)), snapshots, watchlist)
    one = F.broadcast(status)
    listed = watchlist.crossJoin(one).filter((F.col("coverage_month") > F.col("covered_to")) & (F.col("coverage_month") <= F.trunc("latest_trading_date", "MM")))
    listed = listed.select("security_code").distinct().withColumn("is_listed", F.lit(True))
    base = metrics.select("security_code", "oldest_fiscal_period_end_5y").crossJoin(one).join(listed, "security_code", "left")
    reached = (F.col("covered_to") >= F.col("latest_trading_date")) | (F.col("pending_ok") & F.col("is_listed").isNull())
    complete = is_true(F.col("months_are_continuous")) & (F.col("covered_from") <= F.col("oldest_fiscal_period_end_5y")) & F.col("latest_trading_date").isNotNull() & reached
    hits = of_source(actions, source).select(F.col("security_code").alias("__code"), "effective_date", "adjustment_factor", "ex_right_type")
    within = (F.col("security_code") == F.col("__code")) & (F.col("effective_date") > F.col("oldest_fiscal_period_end_5y")) & (F.col("effective_date") <= F.col("covered_to"))
    joined = base.withColumn("range_is_complete", complete).join(hits, within, "left")
    return joined.groupBy("security_code", "covered_from", "covered_to", "range_is_complete").agg(count_where(unsupported(F.col("ex_right_type"), F.col("adjustment_factor"))).alias("unsupported_action_count"))


def adjusted_periods(periods: DataFrame, coverage: DataFrame, actions: DataFrame, source: str | None = None) -> DataFrame:
    """Each period's cumulative factor and adjusted dividend; an action applies to periods that end before it takes effect."""
    p = periods.join(coverage, "security_code", "left")
    usable = of_source(actions, source).filter(F.col("ex_right_type").isin(*ADJUSTING_TYPES) & (F.col("adjustment_factor") > 0)).select(F.col("security_code").alias("__code"), "effective_date", "adjustment_factor")
    later = (F.col("security_code") == F.col("__code")) & (F.col("effective_date") > F.col("fiscal_period_end")) & (F.col("effective_date") <= F.col("covered_to"))
    keys = ["security_code", "annual_financial_id", "fiscal_period_end", "annual_dividend_yen", "recent_period_rank", "previous_fiscal_period_end", "covered_from", "covered_to", "range_is_complete", "unsupported_action_count"]
    factor = F.coalesce(F.product(F.col("adjustment_factor").cast("double")), F.lit(1.0))
    sure = is_true(F.col("range_is_complete")) & (F.col("unsupported_action_count") == 0)
    out = p.join(usable, later, "left").groupBy(*keys).agg(factor.alias("__factor"))
    return out.withColumns({"cumulative_adjustment_factor": F.when(sure, F.round("__factor", 10)), "adjusted_annual_dividend_yen": F.when(sure, F.round(F.col("annual_dividend_yen") * F.col("__factor"), 6))}).drop("__factor")


def adjusted_metrics(securities: DataFrame, financials: DataFrame, coverage: DataFrame, actions: DataFrame, source: str | None = None) -> DataFrame:
    """The five-period record after adjustment; without coverage there is no verdict."""
    newest_first = Window.partitionBy("security_code").orderBy(F.desc("fiscal_period_end"), F.desc("annual_financial_id"))
    value, before, rank = "adjusted_annual_dividend_yen", "previous_adjusted_dividend_yen", F.col("recent_period_rank")
    periods = adjusted_periods(recent_periods(financials), coverage, actions, source).withColumn(before, F.lead(value).over(newest_first))
    steps = _steps(value, before)
    m = periods.groupBy("security_code").agg(
        F.max("covered_from").alias("adjustment_covered_from"),
        F.max("covered_to").alias("adjustment_covered_to"),
        F.bool_and("range_is_complete").alias("range_is_complete"),
        F.max("unsupported_action_count").alias("unsupported_action_count"),
        F.count(F.lit(1)).alias("n"),
        F.count("annual_dividend_yen").alias("n_raw"),
        F.count(value).alias("n_adjusted"),
        count_where(F.col(value) <= 0).alias("n_non_positive"),
        *(c.cast("int").alias(f"adjusted_{name}_count_5y") for name, c in steps.items()),
        _regular().alias("regular"),
        pick(value, rank == 1).alias("latest_adjusted_annual_dividend_yen"),
        pick(value, rank == PERIODS).alias("oldest_adjusted_annual_dividend_yen_5y"),
        pick("cumulative_adjustment_factor", rank == 1).alias("latest_cumulative_adjustment_factor"),
        pick("cumulative_adjustment_factor", rank == PERIODS).alias("oldest_cumulative_adjustment_factor_5y"),
        F.array_sort(F.collect_list("fiscal_period_end")).alias("adjusted_fiscal_periods_5y"),
        in_time_order("fiscal_period_end", "cumulative_adjustment_factor").alias("cumulative_adjustment_factors_5y"),
        in_time_order("fiscal_period_end", value).alias("adjusted_annual_dividends_yen_5y"),
    )
    j = securities.select("security_code").join(m, "security_code", "left")
    incomplete, blocked = ~is_true(F.col("range_is_complete")), F.col("unsupported_action_count") > 0
    irregular = ~is_true(F.col("regular"))
    short, missing = F.col("n") < PERIODS, (F.col("n_raw") < PERIODS) | (F.col("n_adjusted") < PERIODS)
    status, verdict = status_and_verdict(short, missing, irregular, F.col("n_non_positive") > 0, F.col("adjusted_cut_count_5y") > 0)
    latest, oldest = F.col("latest_adjusted_annual_dividend_yen"), F.col("oldest_adjusted_annual_dividend_yen_5y")
    sound = ~(incomplete | blocked | short | (F.col("n_adjusted") < PERIODS) | irregular) & (latest > 0) & (oldest > 0)
    return j.withColumns(
        {
            "dividend_adjustment_status": F.when(incomplete, "adjustment_data_incomplete").when(blocked, "unsupported_corporate_action").otherwise("complete"),
            "is_adjustment_coverage_complete": ~incomplete & (F.col("unsupported_action_count") == 0),
            "is_progressive_dividend_5y_adjusted": F.when(incomplete | blocked, F.lit(None).cast("boolean")).otherwise(verdict),
            "progressive_dividend_status_5y_adjusted": F.when(incomplete, "adjustment_data_incomplete").when(blocked, "unsupported_corporate_action").otherwise(status),
            "dividend_cagr_5y_adjusted_percent": F.when(sound, cagr_percent(latest, oldest)),
        }
    ).drop("n", "n_raw", "n_adjusted", "n_non_positive", "regular", "range_is_complete", "unsupported_action_count")


def adjust_dividends(periods: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """Factor and adjusted dividend of single periods as of a day, and whether an action in between forbids it."""
    day = F.lit(as_of).cast("date")
    a = actions.select(F.col("security_code").alias("__code"), "effective_date", "adjustment_factor", "ex_right_type")
    later = (F.col("security_code") == F.col("__code")) & (F.col("effective_date") > F.col("fiscal_period_end")) & (F.col("effective_date") <= day)
    usable = F.col("ex_right_type").isin(*ADJUSTING_TYPES)
    factor = F.coalesce(F.product(F.when(usable, F.col("adjustment_factor").cast("double"))), F.lit(1.0))
    out = periods.join(a, later, "left").groupBy("security_code", "annual_financial_id", "fiscal_period_end", "annual_dividend_yen").agg(factor.alias("factor"), F.coalesce(F.bool_or(unsupported(F.col("ex_right_type"), F.col("adjustment_factor"))), F.lit(False)).alias("is_rejected"))
    return out.withColumn("adjusted_dividend_yen", F.when(~F.col("is_rejected"), F.round(F.col("annual_dividend_yen") * F.col("factor"), 6)))


def unsupported_report(actions: DataFrame, securities: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Actions of active securities that need a person's eye, newest first, with the state of the adjustment."""
    kind = F.when(F.col("ex_right_type") == "3", "rights_issue").when(F.col("ex_right_type").isNull(), "unknown_type").otherwise("other")
    state = F.when(F.col("dividend_adjustment_status") == "unsupported_corporate_action", "not_adjusted").when(F.col("dividend_adjustment_status") == "adjustment_data_incomplete", "range_incomplete").when(F.col("dividend_adjustment_status") == "complete", "adjusted").otherwise("no_data")
    rows = actions.filter(unsupported(F.col("ex_right_type"), F.col("adjustment_factor"))).join(securities.filter("is_active").select("security_code", "company_name"), "security_code")
    rows = rows.join(adjusted.select("security_code", "dividend_adjustment_status"), "security_code", "left")
    return rows.withColumns({"kind": kind, "adjustment_state": state}).select("security_code", "company_name", "effective_date", "adjustment_factor", "kind", "adjustment_state").orderBy(F.desc("effective_date"), "security_code")


def fetch_range(periods: DataFrame, status: DataFrame, securities: DataFrame) -> DataFrame:
    """First day to fetch actions from: after what all active securities have covered, else from the fifth-latest period on."""
    newest = Window.partitionBy("security_code").orderBy(F.desc("fiscal_period_end"))
    fifth = periods.select("security_code", "fiscal_period_end").distinct().withColumn("k", F.row_number().over(newest)).filter(F.col("k") == PERIODS).agg(F.min("fiscal_period_end").alias("oldest"))
    active = securities.filter("is_active").select("security_code").join(status.filter("sync_status = 'complete'").select("security_code", "covered_to"), "security_code", "left")
    done = active.agg(F.min("covered_to").alias("covered_to"), F.count_if(F.col("covered_to").isNull()).alias("open"))
    return fifth.crossJoin(F.broadcast(done)).select(F.when((F.col("open") == 0) & F.col("covered_to").isNotNull(), F.date_add("covered_to", 1)).otherwise(F.col("oldest")).alias("fetch_from"))
