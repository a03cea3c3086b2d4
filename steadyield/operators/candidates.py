"""Candidates: the screen, its ranking, day-to-day changes and the reasons for leaving."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadyield.functions.expr import is_true
from steadyield.operators.dividends import history_text


# Variables that aren't called like their criterion.
ENVIRONMENT = {"max_candidates": "CANDIDATE_MAX_ROWS", "max_evidence_only": "CANDIDATE_MAX_POLICY_TEXT_ROWS"}


def _parsed(name: str, value: str) -> bool | int | float:
    """A criterion's value from text."""
    kind, text = {f.name: f.type for f in fields(Criteria)}[name], value.strip().lower()
    if kind == "bool" and text not in ("true", "false"):
        raise ValueError(f"setting {name} must be true or false")
    return text == "true" if kind == "bool" else int(text) if kind == "int" else float(text)


@dataclass(frozen=True)
class Criteria:
    """Thresholds of the screen; max_candidates and max_evidence_only cap the list, not the search."""

    min_dividend_yield_percent: float = 3.0
    max_payout_ratio_percent: float = 70.0
    max_per_ratio: float = 25.0
    max_pbr_ratio: float = 3.0
    min_roe_percent: float = 8.0
    max_per_discount_years: float = 5.5
    min_investment_efficiency: float = 1.7
    require_positive_free_cash_flow: bool = True
    max_candidates: int = 300
    max_evidence_only: int = 100

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool":
                continue
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{f.name} must be a finite number from 0 on, not {value}")
        if not min(self.max_payout_ratio_percent, self.max_per_ratio, self.max_pbr_ratio) > 0:
            raise ValueError("the largest payout, PER and PBR must be above 0")
        if not 1 <= self.max_candidates <= 5000 or self.max_evidence_only > 5000:
            raise ValueError("the list holds 1 to 5000 candidates")

    @staticmethod
    def from_settings(settings: DataFrame) -> Criteria:
        """From rows (name, value): unknown, repeated or blank names and values are errors, missing ones keep their defaults."""
        known = {f.name: f.type for f in fields(Criteria)}
        given = settings.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
        wrong = given.filter((F.col("n") > 1) | F.coalesce(~F.col("name").isin(*known), F.lit(True))).take(1)
        if wrong:
            raise ValueError(f"setting {wrong[0].name} is given twice" if wrong[0].n > 1 else f"unknown setting {wrong[0].name}")
        values = {}
        for name, _, value in given.collect():  # a row for each known name at most
            if value is None or not value.strip():
                raise ValueError(f"setting {name} is blank")
            values[name] = _parsed(name, value)
        return Criteria(**values)

    @staticmethod
    def from_environment(given: Mapping[str, str]) -> Criteria:
        """From variables like CANDIDATE_MIN_ROE_PERCENT; what is missing or blank keeps its default, other variables are left aside."""
        told = {f.name: given.get(ENVIRONMENT.get(f.name, f"CANDIDATE_{f.name.upper()}"), "") for f in fields(Criteria)}
        return Criteria(**{name: _parsed(name, value) for name, value in told.items() if value.strip()})

    @staticmethod
    def completed(settings: DataFrame) -> DataFrame:
        """The settings and, for names that they lack, rows with the defaults."""
        shown = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:g}"
        defaults = settings.sparkSession.createDataFrame([(f.name, shown(f.default)) for f in fields(Criteria)], "name string, value string")
        return settings.select("name", "value").unionByName(defaults.join(settings.select("name"), "name", "left_anti"))

    def describe(self) -> str:
        """One line for people."""
        cash = ", positive free cash flow" if self.require_positive_free_cash_flow else ""
        return f"yield >= {self.min_dividend_yield_percent:g} %, payout <= {self.max_payout_ratio_percent:g} %, PER <= {self.max_per_ratio:g}, PBR <= {self.max_pbr_ratio:g}, ROE >= {self.min_roe_percent:g} %, {self.max_per_discount_years:g} years of profit at most, efficiency >= {self.min_investment_efficiency:g}{cash}"

    def condition(self) -> Column:
        return is_true(F.col("is_adjustment_coverage_complete")) & is_true(F.col("is_progressive_dividend_5y_adjusted")) & threshold_condition(self)


def threshold_condition(k: Criteria | SearchRequest) -> Column:
    """The thresholds that screen and search share."""
    c = F.col
    met = (c("dividend_yield_percent") >= k.min_dividend_yield_percent) & c("payout_ratio_percent").between(0, k.max_payout_ratio_percent)
    met &= (c("per_ratio") > 0) & (c("per_ratio") <= k.max_per_ratio) & (c("pbr_ratio") > 0) & (c("pbr_ratio") <= k.max_pbr_ratio)
    met &= (c("roe_percent") >= k.min_roe_percent) & (c("per_undervaluation_years") <= k.max_per_discount_years)
    met &= c("investment_efficiency_10y") >= k.min_investment_efficiency
    return met & (c("free_cash_flow_jpy") > 0) if k.require_positive_free_cash_flow else met


def growth() -> Column:
    """Adjusted growth where the adjustment is complete, else raw growth."""
    return F.when(is_true(F.col("is_adjustment_coverage_complete")), F.col("dividend_cagr_5y_adjusted_percent")).otherwise(F.col("dividend_cagr_5y_percent"))


def rank_order() -> list[Column]:
    return [F.desc_nulls_last("dividend_yield_percent"), growth().desc_nulls_last(), F.desc_nulls_last("roe_percent"), F.asc("security_code")]


def candidates(combined: DataFrame, criteria: Criteria) -> DataFrame:
    """The best securities that meet the screen."""
    return combined.filter(criteria.condition()).orderBy(*rank_order()).limit(criteria.max_candidates)


def ranked(listed: DataFrame) -> DataFrame:
    """Rows of a capped list with their rank; the list is at most 5000 rows."""
    from pyspark.sql import Window

    return listed.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def eligible(combined: DataFrame) -> DataFrame:
    """What searches read: judged progressive, with price and filing."""
    return combined.filter(F.col("annual_financial_id").isNotNull() & F.col("close_price").isNotNull() & is_true(F.col("is_adjustment_coverage_complete")) & is_true(F.col("is_progressive_dividend_5y_adjusted")))


@dataclass(frozen=True)
class SearchRequest:
    """A search by a person: the screen's thresholds, sort column and how many rows to show."""

    min_dividend_yield_percent: float = 3.0
    max_payout_ratio_percent: float = 70.0
    max_per_ratio: float = 25.0
    max_pbr_ratio: float = 3.0
    min_roe_percent: float = 8.0
    max_per_discount_years: float = 5.5
    min_investment_efficiency: float = 1.7
    require_positive_free_cash_flow: bool = True
    sort: str = "yield"
    limit: int = 10

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "float" and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
                raise ValueError(f"{f.name} must be a finite number")
        if self.min_dividend_yield_percent < 0:
            raise ValueError("the least yield must not be negative")
        if min(self.max_payout_ratio_percent, self.max_per_ratio, self.max_pbr_ratio) <= 0:
            raise ValueError("the most of payout, PER and PBR must be above 0")
        if not isinstance(self.require_positive_free_cash_flow, bool):
            raise ValueError("require_positive_free_cash_flow must be true or false")
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or not 1 <= self.limit <= 20:
            raise ValueError("1 to 20 rows can be shown")
        if self.sort not in ("yield", "cagr", "roe"):
            raise ValueError("sort by yield, cagr or roe")

    def condition(self) -> Column:
        return threshold_condition(self)


def search(table: DataFrame, request: SearchRequest) -> DataFrame:
    """One row more than asked for: if it comes, there are more. The table holds eligible securities."""
    columns = {"yield": F.col("dividend_yield_percent"), "cagr": F.col("dividend_cagr_5y_adjusted_percent"), "roe": F.col("roe_percent")}
    order = [columns[request.sort], *(c for name, c in columns.items() if name != request.sort)]
    latest = F.when(F.size("adjusted_annual_dividends_yen_5y") > 0, F.element_at("adjusted_annual_dividends_yen_5y", -1))
    return table.filter(request.condition()).withColumn("latest_adjusted_dividend_yen", latest).orderBy(*(c.desc_nulls_last() for c in order), "security_code").limit(request.limit + 1)


MOST_LISTED = 10_000  # the most candidates and evidence-only rows that settings allow


def changes(current: DataFrame, previous: DataFrame, version: str, first_run: bool | None = None) -> DataFrame:
    """Securities that joined or left the list; a first run reports none. The id follows from the previous list's version and both lists.

    Where first_run is not said, an empty previous list counts as one. A list
    of more than MOST_LISTED securities is an error.
    """
    now, before = current.select("security_code").distinct(), previous.select("security_code").distinct()
    moved = now.join(before, "security_code", "left_anti").withColumn("change", F.lit("added")).unionByName(before.join(now, "security_code", "left_anti").withColumn("change", F.lit("removed")))
    told = F.when(F.count(F.lit(1)) > MOST_LISTED, F.raise_error(F.lit("more securities than a list can have")).cast("string")).otherwise(F.array_join(F.array_sort(F.collect_list("security_code")), ","))
    empty = F.count(F.lit(1)) == 0
    after = now.agg(told.alias("codes"))
    first = before.agg(told.alias("old_codes"), (empty if first_run is None else F.coalesce(F.lit(first_run), empty)).alias("is_first"))
    compared = F.concat_ws("\n", F.lit(f"previous_version={version}"), F.concat(F.lit("previous="), "old_codes"), F.concat(F.lit("current="), "codes"))
    stamp = F.substring(F.sha2(compared, 256), 1, 20)
    return moved.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(first)).filter("not is_first").select(F.concat_ws(":", stamp, "change", "security_code").alias("event_id"), "security_code", "change")


def _judged(value: str, name: str, too_far: Column, label: str, unit: str, needs_positive: bool = False) -> Column:
    absent = F.col(value).isNull() | (F.col(value) <= 0) if needs_positive else F.col(value).isNull()
    # rounds what the number is, ties to even, as printf does; format_string rounds its shortest digits, ties up
    shown = F.concat(F.lit(f"{label} ("), F.call_function("format_number", F.col(value).cast("double"), F.lit("0.00")), F.lit(f"{unit})"))
    return F.when(absent, f"{name} unknown").when(too_far, shown)


def exclusion_reasons(combined: DataFrame, criteria: Criteria) -> DataFrame:
    """Why each security is not a candidate, with values; one that meets everything was beyond the list's end."""
    c = F.col
    sure = is_true(c("is_adjustment_coverage_complete"))
    verdict = F.when(sure, c("is_progressive_dividend_5y_adjusted")).otherwise(c("is_progressive_dividend_5y_raw"))
    status = F.coalesce(F.when(sure, c("progressive_dividend_status_5y_adjusted")).otherwise(c("progressive_dividend_status_5y")), F.lit(""))
    # What each status is called.
    names = {"dividend_cut": "dividend cut within five periods", "non_positive_dividend": "no dividend", "missing_dividend": "dividend data missing", "irregular_fiscal_periods": "irregular fiscal periods", "insufficient_history": "history too short", "progressive": "record cannot be judged", "": "record cannot be judged"}
    named = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), status)
    k = criteria
    checks = [
        F.when(c("annual_financial_id").isNull() | c("close_price").isNull(), "price or filing missing"),
        F.when(~sure, "adjustment data incomplete"),
        F.when(~is_true(verdict), F.coalesce(named, F.concat(F.lit("record: "), status))),
        _judged("dividend_yield_percent", "yield", c("dividend_yield_percent") < k.min_dividend_yield_percent, "yield too low", "%"),
        _judged("payout_ratio_percent", "payout", ~c("payout_ratio_percent").between(0, k.max_payout_ratio_percent), "payout out of range", "%"),
        _judged("per_ratio", "PER", c("per_ratio") > k.max_per_ratio, "PER too high", "x", True),
        _judged("pbr_ratio", "PBR", c("pbr_ratio") > k.max_pbr_ratio, "PBR too high", "x", True),
        _judged("roe_percent", "ROE", c("roe_percent") < k.min_roe_percent, "ROE too low", "%"),
        _judged("per_undervaluation_years", "years of profit", c("per_undervaluation_years") > k.max_per_discount_years, "too many years of profit", "y"),
        _judged("investment_efficiency_10y", "efficiency", c("investment_efficiency_10y") < k.min_investment_efficiency, "efficiency too low", ""),
    ]
    if k.require_positive_free_cash_flow:
        checks.append(F.when(c("free_cash_flow_jpy").isNull(), "free cash flow unknown").when(c("free_cash_flow_jpy") <= 0, "free cash flow not positive"))
    reasons = F.array_compact(F.array(*checks))
    return combined.select("security_code", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(f"beyond the first {k.max_candidates}"))).alias("reasons"))


def reason_breakdown(reasons: DataFrame, top: int = 5) -> DataFrame:
    """How many securities each kind of reason holds back: the commonest few, and the rest as one row."""
    from pyspark.sql import Window

    kinds = reasons.select("security_code", F.explode("reasons").alias("r")).select("security_code", F.trim(F.regexp_replace("r", r"\s*\([^()]*\)$", "")).alias("reason")).distinct()
    counted = kinds.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "reason"))  # a row for each kind of reason
    return counted.withColumn("place", F.least(place, F.lit(top + 1))).groupBy("place").agg(F.when(F.col("place") > top, "others").otherwise(F.min("reason")).alias("reason"), F.sum("n").alias("n"))


def with_evidence_only(listed: DataFrame, combined: DataFrame, evidence: DataFrame, criteria: Criteria) -> DataFrame:
    """The ranked list, those on it noted that have text evidence, then screened securities with evidence alone, capped."""
    noted = listed.join(evidence.select("security_code", "evidence_url", "is_confirmed"), "security_code", "left").withColumn("part", F.lit(1))
    more = combined.filter(criteria.condition()).join(evidence.select("security_code", "evidence_url", "is_confirmed", "published_date"), "security_code").join(listed.select("security_code"), "security_code", "left_anti")
    more = more.orderBy(F.desc("is_confirmed"), F.desc("published_date"), "security_code").limit(criteria.max_evidence_only).drop("published_date").withColumn("part", F.lit(2))
    return noted.unionByName(more.select(noted.columns))


def candidate_report(listed: DataFrame) -> DataFrame:
    """The list as shown: rank, the screened metrics and which record was used."""
    used = F.when(is_true(F.col("is_adjustment_coverage_complete")), "adjusted").otherwise("raw")
    shown = ["security_code", "company_name", "trading_date", "close_price", "dividend_yield_percent", "payout_ratio_percent", "per_ratio", "pbr_ratio", "roe_percent", "per_undervaluation_years", "investment_efficiency_10y", "free_cash_flow_jpy"]
    return ranked(listed).select("rank", *shown, growth().alias("growth_percent"), used.alias("record_used"))


def full_report(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows of with_evidence_only with both records, what their policy texts say, a note on the record and why each is there."""
    c = F.col
    adjusted = is_true(c("is_adjustment_coverage_complete"))
    shown = rows.join(policies, "security_code", "left")
    return shown.select(
        "security_code", "company_name", "dividend_yield_percent", "part",
        F.when(adjusted, "restated for splits").otherwise("not restated: check corporate actions").alias("note"),
        F.when(adjusted, "adjusted").otherwise("raw").alias("record_used"),
        "is_progressive_dividend_5y_raw", "progressive_dividend_status_5y", "dividend_adjustment_status", "is_adjustment_coverage_complete",
        "latest_cumulative_adjustment_factor", "oldest_cumulative_adjustment_factor_5y", "dividend_cagr_5y_adjusted_percent", "is_progressive_dividend_5y_adjusted", "progressive_dividend_status_5y_adjusted",
        history_text("adjusted_fiscal_periods_5y", "adjusted_annual_dividends_yen_5y").alias("adjusted_history"),
        F.when(c("part") == 1, "meets the conditions").otherwise("policy text evidence").alias("added_reason"),
        c("evidence_url").isNotNull().alias("has_text_evidence"),
        *[name for name in policies.columns if name != "security_code"],
    )


def reasons_for(requested: DataFrame, reasons: DataFrame) -> DataFrame:
    """The reasons of the asked-for securities; one that the table lacks has no data."""
    asked = requested.select("security_code").distinct()
    return asked.join(reasons, "security_code", "left").withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no data"))))
