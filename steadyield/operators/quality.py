"""Checks of tables: constraints, freshness, differences, conflicting duplicates and missing months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyield.operators.adjust import unsupported
from steadyield.operators.dividends import one_record_per_period

MAX_AGE_DAYS = {"prices": 5, "financials": 400, "filings": 4, "disclosures": 5}


def rule_violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, one pass for all; a rule that gives null is not broken."""
    counts = df.agg(*(F.count_if(~c).alias(name) for name, c in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations").withColumn("table", F.lit(table))


def repeated_keys(df: DataFrame, table: str, *keys: str) -> DataFrame:
    """How many keys occur more than once; one with a null in it is none."""
    again = df.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
    return again.select(F.lit("unique " + ", ".join(keys)).alias("rule"), "violations", F.lit(table).alias("table"))


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many rows name a parent that does not exist."""
    lost = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return lost.select(F.lit(f"{column} exists").alias("rule"), "violations", F.lit(table).alias("table"))


def audit(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("table", "rule", "violations") for p in parts])


def freshness(latest: DataFrame, as_of: str, max_age: dict[str, int] = MAX_AGE_DAYS) -> DataFrame:
    """Rows (name, latest_date) with age and verdict; a missing date warns, a future one has age 0."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in max_age.items() for x in kv)), F.col("name"))
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), "latest_date"), F.lit(0))
    age = F.when(F.col("latest_date").isNotNull(), age)
    return latest.withColumn("age_days", age).withColumn("verdict", F.when(F.col("age_days").isNull() | (F.col("age_days") > limit), "warning").otherwise("ok"))


def health_metrics(securities: DataFrame, prices: DataFrame, cache: DataFrame, financials: DataFrame, filings: DataFrame, results: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: what each table holds and how new it is, open analyses, and actions of active securities that are not adjusted for."""
    n = F.count(F.lit(1))
    active = securities.filter("is_active")
    odd = actions.filter(unsupported(F.col("ex_right_type"), F.col("adjustment_factor"))).join(active.select("security_code"), "security_code")
    parts = (
        active.agg(n.alias("active_securities")),
        prices.agg(F.max("trading_date").alias("latest_trading_date"), n.alias("price_rows")),
        cache.agg(n.alias("cache_rows"), F.max("trading_date").alias("cache_trading_date")),
        financials.agg(n.alias("financial_rows"), F.max("fiscal_period_end").alias("latest_fiscal_period_end")),
        filings.agg(n.alias("filing_rows"), F.max("submitted_at").alias("latest_submitted_at")),
        results.agg(F.count_if(F.col("status") != "completed").alias("open_analyses")),
        odd.agg(n.alias("unsupported_actions")),
    )  # each has one row
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def consistency(metrics: DataFrame) -> DataFrame:
    """One-row metrics as checks: a cache older than the prices and open analyses warn, unsupported actions are only reported."""
    cache = F.when(F.col("latest_trading_date").isNull() | F.col("cache_trading_date").isNull() | (F.col("cache_trading_date") < F.col("latest_trading_date")), "warning").otherwise("ok")
    open_ = F.when(F.col("open_analyses") > 0, "warning").otherwise("ok")
    checks = F.array(F.struct(F.lit("cache").alias("name"), cache.alias("verdict")), F.struct(F.lit("analyses").alias("name"), open_.alias("verdict")), F.struct(F.lit("unsupported_actions").alias("name"), F.lit("ok").alias("verdict")))
    return metrics.select(F.inline(checks))


def compare_tables(left: DataFrame, right: DataFrame, key: str, tolerance: float = 0.01, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Differences as rows (key, column, left, right): numbers within the tolerance and dates are equal by value, text as it is, keys on one side only once."""
    shared = [c for c in left.columns if c in right.columns and c != key and c not in ignore]
    kinds = dict(left.dtypes)
    o = left.select(key, F.struct(*shared).alias("l"))
    n = right.select(key, F.struct(*shared).alias("r"))
    both = o.join(n, key, "full_outer")

    def differs(c: str) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        if kinds[c] in ("double", "float", "int", "bigint", "smallint") or kinds[c].startswith("decimal"):
            near = F.abs(a.cast("double") - b.cast("double")) <= tolerance
            return ~F.coalesce(near, a.isNull() & b.isNull())
        return ~a.eqNullSafe(b)

    def entry(name: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))

    absent = F.when(F.col("r").isNull(), F.array(entry("missing on the right", F.lit(None), F.lit(None)))).when(F.col("l").isNull(), F.array(entry("missing on the left", F.lit(None), F.lit(None))))
    cells = F.array_compact(F.array(*(F.when(differs(c), entry(c, F.col(f"l.{c}"), F.col(f"r.{c}"))) for c in shared)))
    return both.select(key, F.inline(F.coalesce(absent, cells)))


def conflicts(df: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows differ, with how many different rows each has."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*rest)).alias("versions")).filter("versions > 1")


def collapse_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Equal rows once; keys in conflict are left out and must be reported with conflicts()."""
    return df.dropDuplicates().join(conflicts(df, *keys).select(*keys), list(keys), "left_anti")


def month_completeness(found: DataFrame, expected_from: str, expected_to: str, month: str = "month_start") -> DataFrame:
    """Months that are missing from, or not expected in, a list of months; a null month is unexpected."""
    span = found.sparkSession.sql(f"SELECT explode(sequence(DATE '{expected_from}', DATE '{expected_to}', INTERVAL 1 MONTH)) AS {month}").withColumn("expected", F.lit(True))
    have = found.select(month).distinct().withColumn("found", F.lit(True))
    both = span.join(have, month, "full_outer")
    return both.filter("expected is null or found is null").select(month, F.when(F.col("found").isNull(), "missing").otherwise("unexpected").alias("problem"))


def outside_their_month(actions: DataFrame, month: str = "file_month", when: str = "effective_date") -> DataFrame:
    """Rows that do not take effect in their file's month; a row without a day or month is outside too."""
    return actions.filter(~F.trunc(when, "MM").eqNullSafe(F.col(month)) | F.col(when).isNull())


def month_source_problems(listed: DataFrame, parsed: DataFrame, expected_from: str, expected_to: str) -> DataFrame:
    """Rows (month_start, problem) for monthly files: what is listed against what was parsed.

    listed has month_start and source_url, parsed month_start, source_url and
    sha256, one row a file. A month of the range without a listed file is
    missing; two addresses for one are ambiguous; a listed month that was not
    parsed is unparsed, one parsed without being listed in the range is
    unexpected; a file parsed from another address, or one month parsed with
    several checksums, differs. A month that is not the first of a month is
    not_first_day. Equal files listed twice are one.
    """
    at = F.col("month_start")
    first_day = lambda df: df.filter(at.isNotNull() & (at == F.trunc(at, "MM")))
    expected = listed.sparkSession.sql(f"SELECT explode(sequence(trunc(DATE '{expected_from}', 'MM'), trunc(DATE '{expected_to}', 'MM'), INTERVAL 1 MONTH)) AS month_start").withColumn("expected", F.lit(True))
    by_list = first_day(listed).groupBy("month_start").agg(F.count_distinct("source_url").alias("n_listed"), F.min("source_url").alias("listed_url"))
    by_file = first_day(parsed).groupBy("month_start").agg(F.count_distinct("sha256").alias("n_sums"), F.count_distinct("source_url").alias("n_urls"), F.min("source_url").alias("parsed_url"))
    both = expected.join(by_list, "month_start", "left").join(by_file, "month_start", "full_outer")
    here, n, wanted = F.col("parsed_url").isNotNull(), F.col("n_listed"), F.col("expected").isNotNull()
    kinds = {
        "missing": wanted & n.isNull(),
        "ambiguous": wanted & (n > 1),
        "unparsed": wanted & n.isNotNull() & ~here,
        "unexpected": ~wanted & here,
        "differs": wanted & here & ((F.col("n_sums") > 1) | (F.col("n_urls") > 1) | (F.col("parsed_url") != F.col("listed_url"))),
    }
    told = both.select("month_start", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))).alias("problem"))
    odd = listed.select("month_start").unionByName(parsed.select("month_start")).filter(at != F.trunc(at, "MM")).distinct().withColumn("problem", F.lit("not_first_day"))
    return told.unionByName(odd)


def dividend_summary(financials: DataFrame) -> DataFrame:
    """One row: rows, securities, dividends known, zero and negative, and repeated periods with the rows they hold."""
    repeated = financials.groupBy("security_code", "fiscal_period_end").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_periods"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in_repeated_periods"))
    d = F.col("annual_dividend_yen")
    return financials.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("security_code").alias("n_securities"), F.count(d).alias("n_dividends"), F.count_if(d == 0).alias("n_zero"), F.count_if(d < 0).alias("n_negative")).crossJoin(F.broadcast(repeated))


def summary_verdict(summary: DataFrame) -> DataFrame:
    return summary.withColumn("verdict", F.when((F.col("n_negative") > 0) | (F.col("repeated_periods") > 0), "warning").otherwise("ok"))


def history_lengths(financials: DataFrame) -> DataFrame:
    """How many securities have how many periods."""
    return one_record_per_period(financials).groupBy("security_code").agg(F.count(F.lit(1)).alias("periods")).groupBy("periods").agg(F.count(F.lit(1)).alias("securities"))


def non_decreasing(financials: DataFrame, periods: int = 5, limit: int = 50) -> DataFrame:
    """Securities whose latest periods all have dividends, none below the one before: a diagnosis, not the verdict."""
    newest = Window.partitionBy("security_code").orderBy(F.desc("fiscal_period_end"), F.desc("annual_financial_id"))
    rows = one_record_per_period(financials).select("security_code", "annual_dividend_yen", F.row_number().over(newest).alias("k"), F.lead("annual_dividend_yen").over(newest).alias("before")).filter(F.col("k") <= periods)
    steady = F.bool_and(F.when(F.col("k") < periods, F.col("annual_dividend_yen") >= F.col("before")).otherwise(True))
    good = rows.groupBy("security_code").agg(F.count(F.lit(1)).alias("n"), F.count("annual_dividend_yen").alias("m"), steady.alias("steady"))
    return good.filter((F.col("n") == periods) & (F.col("m") == periods) & F.col("steady")).select("security_code").orderBy("security_code").limit(limit)


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows; a repeated key is an error when they are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("a key is repeated")).cast("boolean"))).drop("__n")


def status_totals(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def attribute_counts(securities: DataFrame, prices: DataFrame, filings: DataFrame) -> DataFrame:
    """Rows (attribute, value, n): securities active, inactive and in all, days with and without a close, filings by type. An activity that is null counts in all only."""
    counted = lambda df, attribute, **values: df.agg(*(c.alias(name) for name, c in values.items())).unpivot([], list(values), "value", "n").withColumn("attribute", F.lit(attribute))
    close, n = F.col("close_price"), F.count(F.lit(1))
    parts = [
        counted(securities, "securities", active=F.count_if("is_active"), inactive=F.count_if(~F.col("is_active")), total=n),
        counted(prices, "close", present=F.count(close), missing=F.count_if(close.isNull())),
        status_totals(filings, "type_code").select(F.col("type_code").alias("value"), "n", F.lit("filing type").alias("attribute")),
    ]
    return reduce(DataFrame.unionByName, parts).select("attribute", "value", "n")


def observed_ranges(bars: DataFrame) -> DataFrame:
    """First and last day and number of bars of each security."""
    return bars.groupBy("security_code").agg(F.min("trading_date").alias("observed_from"), F.max("trading_date").alias("observed_to"), F.count(F.lit(1)).alias("n"))
