"""Registered queries of landed rows, filings, reports and health figures, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.functions.text import filing_id, filing_url
from steadyield.operators import adjust, candidates, facts, merge, policy, quality, screener
from steadyield.plans.data_queries import HOLDERS, REPORTS, RESULTS
from steadyield.plans.screener_queries import LOOSE, TIGHT, combined, rounded
from steadyield.plans.screener_sql import _COMBINED, _list, _met, _reasons
from steadyield.plans.standins import Inputs, with_stand_ins
from steadyield.sources import readers, schemas

_NTH = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS BIGINT)"
BARS = """
SELECT concat(CAST(1000 + l_partkey % 9000 AS STRING), '0') AS code, CAST(l_shipdate AS DATE) AS effective_date,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS adjustment_factor,
       CASE l_suppkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '9' ELSE NULL END AS ex_right_type
FROM lineitem
"""
# an order is a table of rights, a line a row of it
RIGHTS = f"""
SELECT source, row_no, CASE row_no WHEN 1 THEN '市場 ' || k WHEN 4 THEN '外国株' END AS section, code, day_text, ratio_a, ratio_b, word FROM (
  SELECT CAST(l_orderkey AS STRING) AS source, {_NTH} AS row_no, CAST(l_orderkey % 5 AS STRING) AS k, CAST(1000 + l_partkey % 9000 AS STRING) AS code,
         concat(CAST(year(l_shipdate) AS STRING), CASE l_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '/' END, CAST(month(l_shipdate) AS STRING), CASE l_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '/' END, CAST(day(l_shipdate) AS STRING)) AS day_text,
         1 + l_suppkey % 4 AS ratio_a, 1 + l_linenumber % 5 AS ratio_b,
         CASE l_partkey % 7 WHEN 0 THEN '株式分割' WHEN 1 THEN '株式併合' WHEN 2 THEN '株主無償割当' WHEN 3 THEN '新株予約権' WHEN 4 THEN '受益権分割' WHEN 5 THEN '株式配当' ELSE 'merger' END AS word
  FROM lineitem) r
"""
# a line announces its order's filing; of several the last stands
LISTING = f"""
SELECT CAST(l_orderkey AS STRING) AS doc_id, {_NTH} AS list_no, CASE WHEN l_orderkey % 8 = 0 THEN '020' ELSE '010' END AS ordinance_code,
       CASE l_orderkey % 5 WHEN 0 THEN '120' WHEN 1 THEN '130' WHEN 2 THEN '160' WHEN 3 THEN '999' ELSE '120' END AS type_code,
       CASE WHEN o_custkey % 13 = 0 THEN '投資信託' ELSE 'company' END AS filer_name, CAST(o_custkey AS STRING) AS filer_code,
       CASE WHEN l_partkey % 3 = 0 THEN ' ' WHEN l_partkey % 3 = 1 THEN NULL ELSE CAST(1000 + l_partkey % 9000 AS STRING) END AS security_code,
       'report' AS title, l_partkey % 11 <> 0 AS has_facts, l_suppkey % 17 = 0 AS is_withdrawn, l_shipdate AS submitted_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
TYPED = """
SELECT CAST(o_orderkey AS STRING) AS doc_id, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS security_code,
       CASE WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('△', CAST(o_custkey AS STRING)) ELSE concat(CAST(o_custkey AS STRING), '株') END AS amount,
       concat(CAST(year(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING)) AS filed
FROM orders
"""
LINKS = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('https://files.example/pdf/S', CAST(1000000 + o_custkey AS STRING), '.pdf') WHEN 1 THEN concat('https://view.example/page?S', CAST(1000000 + o_custkey AS STRING), ',')
       WHEN 2 THEN concat('http://files.example/pdf/S', CAST(1000000 + o_custkey AS STRING), '.pdf') ELSE NULL END AS url FROM orders
"""
FILINGS = "SELECT CAST(o_orderkey AS STRING) AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS submitted_at FROM orders WHERE o_orderkey % 10 <> 7"
SOURCED = "SELECT CAST(l_suppkey * 20 AS STRING) AS security_code, CAST(l_shipdate AS DATE) AS effective_date, CASE WHEN l_linenumber % 2 = 0 THEN 'exchange' ELSE 'vendor' END AS source FROM lineitem"
OLD_FILINGS = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE CAST(o_orderkey AS STRING) END AS doc_id, CAST(o_custkey AS STRING) AS security_code, o_orderdate AS submitted_at FROM orders WHERE o_orderkey % 2 = 0"
NEW_FILINGS = f"SELECT CAST(l_orderkey AS STRING) AS doc_id, CAST(l_partkey AS STRING) AS security_code, l_shipdate AS submitted_at, {_NTH} AS batch_no FROM lineitem"
ALERTS = "SELECT CAST(user_id AS STRING) AS security_code, CAST(ts AS DATE) AS published_date, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(1000 + event_id % 900 AS STRING) END AS published_time, event_type AS category, event_id AS row_no FROM events"
MONTHS = "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS coverage_month FROM lineitem WHERE l_shipdate >= CAST('1998-01-01' AS TIMESTAMP) AND l_shipdate < CAST('1999-01-01' AS TIMESTAMP)"
MONTH_ROWS = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS coverage_month, CAST(l_partkey AS STRING) AS security_code FROM lineitem WHERE l_shipdate >= CAST('1998-01-01' AS TIMESTAMP) AND l_shipdate < CAST('1998-11-01' AS TIMESTAMP)"
# a month's list of files: some months twice, with two addresses, or not on their first day
LISTED_FILES = """
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, concat('file-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING), CASE WHEN month(o_orderdate) = 3 AND o_orderkey % 2 = 0 THEN '-b' ELSE '' END) AS source_url
FROM orders WHERE month(o_orderdate) <> 5
UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'stray' FROM orders WHERE day(o_orderdate) = 7
"""
PARSED_FILES = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start, concat('file-', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING), CASE WHEN month(l_shipdate) = 11 THEN '-old' ELSE '' END) AS source_url,
       CASE WHEN month(l_shipdate) = 8 THEN l_returnflag ELSE 'sum' END AS sha256
FROM lineitem WHERE month(l_shipdate) <> 2
"""
FILED_ACTIONS = "SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', o_orderdate) AS DATE) AS file_month, CASE WHEN l_linenumber % 6 <> 0 THEN CAST(l_shipdate AS DATE) END AS effective_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
STORED_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS coverage_month, CAST(o_custkey AS STRING) AS security_code FROM orders"


def bar_actions(x: Inputs) -> DataFrame:
    return readers.bar_actions(x.sql(BARS))


def rights_table(x: Inputs) -> DataFrame:
    rows = x.sql(RIGHTS).select("source", F.lit(1).alias("page_no"), "row_no", "section", F.array("code", F.lit("name"), "day_text", F.concat_ws(" ", F.concat_ws(":", "ratio_a", "ratio_b"), "word")).alias("cells"))
    return readers.rights_rows(rows).withColumn("adjustment_factor", F.col("adjustment_factor").cast("double"))


def annual_filing_list(x: Inputs) -> DataFrame:
    codes = x.table("customer").select(F.col("c_custkey").cast("string").alias("filer_code"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("string")).alias("security_code"))
    return readers.with_codes(readers.annual_filings(x.sql(LISTING)), codes).select("doc_id", "list_no", "type_code", "filer_code", "security_code", "has_facts", "is_withdrawn", "submitted_at")


def filings_to_extract(x: Inputs) -> DataFrame:
    done = x.sql("SELECT CAST(o_orderkey AS STRING) AS doc_id FROM orders WHERE o_orderstatus = 'F'")
    return readers.to_extract(readers.annual_filings(x.sql(LISTING)), done).select("doc_id", "submitted_at")


def typed_rows(x: Inputs) -> DataFrame:
    good, bad = readers.typed(x.sql(TYPED), {"amount": "long", "filed": "date"}, ("security_code",), millions=("amount",))
    return good.withColumn("is_rejected", F.lit(False)).unionByName(bad.select("doc_id", "security_code", F.lit(None).cast("long").alias("amount"), F.lit(None).cast("date").alias("filed"), F.lit(True).alias("is_rejected")))


def typed_financials(x: Inputs) -> DataFrame:
    rows = schemas.conform(x.financials, "financials")
    return rows.select("annual_financial_id", "doc_id", "security_code", "fiscal_period_start", "fiscal_period_end", *(F.col(c).cast("double").alias(c) for c in ("net_income_jpy", "eps_yen", "annual_dividend_yen", "current_assets_jpy")), "issued_shares", "source")


def filing_links(x: Inputs) -> DataFrame:
    return x.sql(LINKS).select("o_orderkey", filing_id("url").alias("filing_id"), filing_url("url", "https://files.example/pdf").alias("filing_url"))


def submitted_financials(x: Inputs) -> DataFrame:
    return screener.latest_financials(screener.with_submission(x.financials, x.sql(FILINGS))).select("security_code", "annual_financial_id", "fiscal_period_end", "submitted_at")


def latest_annual_filings(x: Inputs) -> DataFrame:
    return policy.latest_filings(screener.with_submission(x.financials, x.sql(FILINGS))).select("security_code", "doc_id", "fiscal_period_end", "submitted_at")


def known_actions(x: Inputs) -> DataFrame:
    kept, lost = adjust.known_actions(adjust.of_source(x.sql(SOURCED), "exchange"), x.securities)
    counted = kept.groupBy("security_code").agg(F.count(F.lit(1)).alias("n_actions")).withColumn("is_known", F.lit(True))
    return counted.unionByName(lost.withColumn("is_known", F.lit(False)))


def merged_filings(x: Inputs) -> DataFrame:
    return merge.merge_filings(x.sql(OLD_FILINGS), x.sql(NEW_FILINGS))


def new_filing_preview(x: Inputs) -> DataFrame:
    return merge.preview(merged_filings(x).filter("is_new").drop("is_new")).select("place", "doc_id", "security_code", "submitted_at", "n_more")


def checked_filings(x: Inputs) -> DataFrame:
    """Corrections by document over rows whose key is guarded."""
    rows = quality.assert_unique(x.financials.select("doc_id", "security_code", "fiscal_period_end", "eps_yen", "issued_shares"), "doc_id")
    fixes = x.financials.filter("annual_financial_id % 6 = 0").select("doc_id", "security_code", "fiscal_period_end", F.when(F.col("annual_financial_id") % 12 == 0, F.col("eps_yen") + 1000).alias("eps_yen"), F.lit(5).alias("issued_shares"))
    return facts.apply_overrides(rows, fixes, ("eps_yen", "issued_shares"))


def watchlist_months(x: Inputs) -> DataFrame:
    return merge.replace_months(x.sql(STORED_MONTHS), x.sql(MONTH_ROWS), x.sql(MONTHS)).groupBy("coverage_month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("security_code").alias("n_securities"))


def disclosure_report(x: Inputs) -> DataFrame:
    listed = x.sql("SELECT event_id AS disclosure_id, event_id % 5 <> 0 AS is_policy_candidate FROM events").unionByName(x.sql("SELECT o_orderkey + 100000000 AS disclosure_id, true AS is_policy_candidate FROM orders"))
    return policy.report_rows(listed, x.sql(RESULTS))


def policy_report(x: Inputs) -> DataFrame:
    """Analysed disclosures, and orders as such without analysis; every fifth is no policy disclosure."""
    found = x.sql(RESULTS).withColumns({"matched_phrase": F.concat(F.lit("phrase "), F.col("disclosure_id") % 7), "page_no": (F.col("disclosure_id") % 9 + 1).cast("int")})
    kept = ("disclosure_id", "security_code", "published_date", "published_time", "title")
    listed = found.select(*kept, (F.col("disclosure_id") % 5 != 0).alias("is_policy_candidate"))
    orders = x.table("orders").select((F.col("o_orderkey") + 100_000_000).alias("disclosure_id"), F.col("o_custkey").cast("string").alias("security_code"), F.col("o_orderdate").cast("date").alias("published_date"), F.lit("1500").alias("published_time"), F.lit("order").alias("title"), (F.col("o_orderkey") % 5 != 0).alias("is_policy_candidate"))
    return policy.policy_report_rows(listed.unionByName(orders), found, "2024-01-01 00:00:00", "machine verdict")


def month_sources(x: Inputs) -> DataFrame:
    return quality.month_source_problems(x.sql(LISTED_FILES), x.sql(PARSED_FILES), "1994-01-01", "1999-12-01")


def misfiled_actions(x: Inputs) -> DataFrame:
    return quality.outside_their_month(x.sql(FILED_ACTIONS))


def alerted_candidates(x: Inputs) -> DataFrame:
    return policy.attach_alerts(x.sql(HOLDERS).select("security_code"), x.sql(RESULTS), x.sql(ALERTS), ("error", "purchase"))


def _with_results(x: Inputs) -> DataFrame:
    newest = policy.latest_results(x.sql(RESULTS)).select("security_code", "classification", F.col("disclosure_id").cast("string").alias("document_id"))
    return policy.attach_filing_results(x.sql(HOLDERS).select("security_code"), x.sql(REPORTS)).withColumn("report_doc_id", F.col("report_doc_id").cast("string")).join(newest, "security_code", "left")


def proven_candidates(x: Inputs) -> DataFrame:
    return policy.overwrite_evidence(_with_results(x), policy.evidence(x.sql(RESULTS), x.sql(REPORTS)))


def evidence_candidates(x: Inputs) -> DataFrame:
    """The first 20 candidates, then those that only their evidence brings in."""
    both = combined(x)
    few = candidates.Criteria(**{**LOOSE.__dict__, "max_candidates": 20, "max_evidence_only": 30})
    proof = policy.evidence(x.sql(RESULTS), x.sql(REPORTS)).withColumnRenamed("url", "evidence_url")
    return candidates.with_evidence_only(candidates.candidates(both, few), both, proof, few).select("security_code", "part", "evidence_url", "is_confirmed")


def candidate_sheet(x: Inputs) -> DataFrame:
    """The candidates and those by evidence alone as the report shows them."""
    both = combined(x)
    few = candidates.Criteria(**{**LOOSE.__dict__, "max_candidates": 20, "max_evidence_only": 30})
    proof = policy.evidence(x.sql(RESULTS), x.sql(REPORTS)).withColumnRenamed("url", "evidence_url")
    rows = candidates.with_evidence_only(candidates.candidates(both, few), both, proof, few)
    return rounded(candidates.full_report(rows, proven_candidates(x)), "dividend_yield_percent").drop("adjusted_history")


def asked_reasons(x: Inputs) -> DataFrame:
    """Suppliers' numbers as the codes that people ask for."""
    asked = x.table("supplier").select((F.col("s_suppkey") * 7).cast("string").alias("security_code"))
    return candidates.reasons_for(asked, candidates.exclusion_reasons(combined(x), TIGHT)).withColumn("reasons", F.array_join("reasons", "; "))


def _health(x: Inputs) -> DataFrame:
    return quality.health_metrics(x.securities, x.prices, candidates.eligible(combined(x)), x.financials, x.sql(FILINGS), x.sql(RESULTS), x.actions)


def health_metrics(x: Inputs) -> DataFrame:
    return _health(x)


def health_checks(x: Inputs) -> DataFrame:
    return quality.consistency(_health(x).withColumn("cache_trading_date", F.date_sub("cache_trading_date", 1)))


def market_counts(x: Inputs) -> DataFrame:
    return quality.status_totals(x.securities, "market")


def attribute_counts(x: Inputs) -> DataFrame:
    return quality.attribute_counts(x.securities, x.prices, x.sql(LISTING))


def analysis_run(x: Inputs) -> DataFrame:
    """What a run of analyses takes and leaves, of disclosures of all states and as many new ones as orders."""
    targets = x.sql(RESULTS).select("disclosure_id", "published_date").unionByName(x.table("orders").select((F.col("o_orderkey") + 10_000_000).alias("disclosure_id"), F.col("o_orderdate").cast("date").alias("published_date")))
    return policy.run_counts(policy.analysis_state(targets, x.sql(RESULTS), "v2"))


FUNCTIONS = (policy_report, month_sources, misfiled_actions, attribute_counts, analysis_run, bar_actions, rights_table, annual_filing_list, filings_to_extract, typed_rows, typed_financials, filing_links, submitted_financials, latest_annual_filings, known_actions, merged_filings, new_filing_preview, checked_filings, watchlist_months, disclosure_report, alerted_candidates, proven_candidates, evidence_candidates, candidate_sheet, asked_reasons, health_metrics, health_checks, market_counts)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for f in FUNCTIONS}


_LAST_LISTED = f"""WITH listing AS ({LISTING}), annual AS (SELECT * FROM listing WHERE ordinance_code = '010' AND type_code IN ('120', '130', '160', '170') AND filer_name <> '投資信託'
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY list_no DESC) = 1)"""
_SUBMITTED = with_stand_ins("financials") + f", filings AS ({FILINGS}), f AS (SELECT financials.* EXCLUDE (submitted_at), filings.submitted_at FROM financials LEFT JOIN filings ON financials.doc_id = filings.doc_id)"
_MERGED = f"""WITH old AS (SELECT * FROM ({OLD_FILINGS}) WHERE trim(doc_id) <> ''), new AS (SELECT * FROM ({NEW_FILINGS}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch_no DESC) = 1),
  merged AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.security_code ELSE n.security_code END AS security_code, CASE WHEN n.doc_id IS NULL THEN o.submitted_at ELSE n.submitted_at END AS submitted_at, o.doc_id IS NULL AS is_new FROM old o FULL JOIN new n ON o.doc_id = n.doc_id)"""
_EVERY = f"""results AS ({RESULTS}), reports AS ({REPORTS}), every AS (
    SELECT security_code, 'disclosure' AS source, CAST(disclosure_id AS STRING) AS document_id, published_date, url, classification FROM results WHERE status = 'completed' AND classification <> 'not_confirmed'
    UNION ALL SELECT security_code, 'report', CAST(doc_id AS STRING), submitted_date, url, classification FROM reports WHERE status = 'completed' AND classification <> 'not_confirmed'),
  proof AS (SELECT *, classification = 'confirmed' AS is_confirmed FROM every QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY classification = 'confirmed' DESC, published_date DESC, document_id DESC) = 1)"""
_NEWEST = """newest AS (SELECT * FROM results WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY published_date DESC, published_time DESC NULLS LAST, disclosure_id DESC) = 1),
  filed AS (SELECT * FROM reports WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY submitted_date DESC, doc_id DESC) = 1)"""
_BY_EVIDENCE = (
    _COMBINED
    + _list("full_list", LOOSE)
    + f""", {_EVERY}, listed AS (SELECT * FROM full_list ORDER BY dividend_yield_percent DESC NULLS LAST, growth_percent DESC NULLS LAST, roe_percent DESC NULLS LAST, security_code LIMIT 20),
      more AS (SELECT c.security_code, p.url, p.is_confirmed FROM combined c JOIN proof p USING (security_code) WHERE {_met(LOOSE)} AND c.security_code NOT IN (SELECT security_code FROM listed) ORDER BY p.is_confirmed DESC, p.published_date DESC, c.security_code LIMIT 30),
      both_parts AS (SELECT l.security_code, 1 AS part, p.url AS evidence_url, p.is_confirmed FROM listed l LEFT JOIN proof p USING (security_code) UNION ALL SELECT security_code, 2, url, is_confirmed FROM more)"""
)
_PROVEN = """proven AS (SELECT CAST(h.c_custkey AS STRING) AS security_code, CASE WHEN e.source = 'disclosure' THEN e.classification ELSE n.classification END AS classification, CASE WHEN e.source = 'disclosure' THEN e.document_id ELSE CAST(n.disclosure_id AS STRING) END AS document_id,
        CASE WHEN e.source = 'report' THEN e.classification ELSE f.classification END AS report_classification, CASE WHEN e.source = 'report' THEN e.document_id ELSE CAST(f.doc_id AS STRING) END AS report_doc_id
      FROM customer h LEFT JOIN proof e ON e.security_code = CAST(h.c_custkey AS STRING) LEFT JOIN newest n ON n.security_code = CAST(h.c_custkey AS STRING) LEFT JOIN filed f ON f.security_code = CAST(h.c_custkey AS STRING))"""
_ELIGIBLE = "annual_financial_id IS NOT NULL AND close_price IS NOT NULL AND is_adjustment_coverage_complete AND is_progressive_dividend_5y_adjusted"
_HEALTH = (
    _COMBINED
    + f""", filings AS ({FILINGS}), results AS ({RESULTS}), cache AS (SELECT * FROM combined WHERE {_ELIGIBLE}), health AS (SELECT
      (SELECT count(*) FROM securities WHERE is_active) AS active_securities, (SELECT max(trading_date) FROM prices) AS latest_trading_date, (SELECT count(*) FROM prices) AS price_rows,
      (SELECT count(*) FROM cache) AS cache_rows, (SELECT max(trading_date) FROM cache) AS cache_trading_date, (SELECT count(*) FROM financials) AS financial_rows, (SELECT max(fiscal_period_end) FROM financials) AS latest_fiscal_period_end,
      (SELECT count(*) FROM filings) AS filing_rows, (SELECT max(submitted_at) FROM filings) AS latest_submitted_at, (SELECT count(*) FROM results WHERE status <> 'completed') AS open_analyses,
      (SELECT count(*) FROM actions JOIN securities USING (security_code) WHERE is_active AND ex_right_type IS DISTINCT FROM '1' AND ex_right_type IS DISTINCT FROM '2' AND adjustment_factor <> 1) AS unsupported_actions)"""
)
_DAY = "make_date(CAST(string_split_regex({c}, '[./-]')[1] AS INT), CAST(string_split_regex({c}, '[./-]')[2] AS INT), CAST(string_split_regex({c}, '[./-]')[3] AS INT))"

SQL = {
    "bar_actions": f"SELECT substr(code, 1, 4) AS security_code, effective_date, adjustment_factor, ex_right_type, coalesce(ex_right_type NOT IN ('1', '2', '3'), false) AS is_quarantined FROM ({BARS}) WHERE NOT (adjustment_factor = 1 AND ex_right_type IS NULL)",
    "rights_table": f"""WITH rights AS ({RIGHTS}), carried AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM rights)
      SELECT source, part AS section, code AS security_code, {_DAY.format(c="day_text")} AS effective_date,
        CASE WHEN word IN ('株式分割', '株式併合') THEN round(CAST(ratio_a AS DOUBLE) / ratio_b, 10) WHEN word = '株主無償割当' THEN round(CAST(ratio_a AS DOUBLE) / (ratio_a + ratio_b), 10) ELSE 1 END AS adjustment_factor,
        CASE word WHEN '株式分割' THEN '1' WHEN '株式併合' THEN '2' WHEN '株主無償割当' THEN '1' ELSE '3' END AS ex_right_type, false AS is_quarantined
      FROM carried WHERE part <> '外国株' AND word IN ('株式分割', '株式併合', '株主無償割当', '新株予約権', '株式配当')""",
    "annual_filing_list": _LAST_LISTED + " SELECT doc_id, list_no, type_code, filer_code, coalesce(nullif(trim(security_code), ''), CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS STRING) END) AS security_code, has_facts, is_withdrawn, submitted_at FROM annual LEFT JOIN customer ON filer_code = CAST(c_custkey AS STRING)",
    "filings_to_extract": _LAST_LISTED + " SELECT doc_id, submitted_at FROM annual WHERE type_code = '120' AND has_facts AND NOT is_withdrawn AND doc_id NOT IN (SELECT CAST(o_orderkey AS STRING) FROM orders WHERE o_orderstatus = 'F') ORDER BY submitted_at, doc_id LIMIT 100",
    "typed_rows": f"""WITH t AS (SELECT *, security_code = '' OR coalesce(amount = 'none', false) AS is_rejected FROM ({TYPED}))
      SELECT doc_id, security_code, CASE WHEN NOT is_rejected THEN CAST(replace(replace(amount, '△', '-'), '株', '') AS BIGINT) * 1000000 END AS amount, CASE WHEN NOT is_rejected THEN {_DAY.format(c="filed")} END AS filed, is_rejected FROM t""",
    "typed_financials": with_stand_ins("financials") + " SELECT annual_financial_id, doc_id, security_code, CAST(NULL AS DATE) AS fiscal_period_start, fiscal_period_end, CAST(net_income_jpy AS DOUBLE) AS net_income_jpy, CAST(eps_yen AS DOUBLE) AS eps_yen, CAST(annual_dividend_yen AS DOUBLE) AS annual_dividend_yen, CAST(current_assets_jpy AS DOUBLE) AS current_assets_jpy, issued_shares, CAST(NULL AS STRING) AS source FROM financials",
    "filing_links": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'S' || CAST(1000000 + o_custkey AS STRING) END AS filing_id, CASE WHEN o_orderkey % 4 < 2 THEN 'https://files.example/pdf/S' || CAST(1000000 + o_custkey AS STRING) || '.pdf' ELSE coalesce(url, '') END AS filing_url FROM ({LINKS}) JOIN orders USING (o_orderkey)",
    "submitted_financials": _SUBMITTED + " SELECT security_code, annual_financial_id, fiscal_period_end, submitted_at FROM f QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY fiscal_period_end DESC, submitted_at DESC NULLS LAST, extracted_at DESC NULLS LAST, annual_financial_id DESC) = 1",
    "latest_annual_filings": _SUBMITTED + " SELECT security_code, doc_id, fiscal_period_end, submitted_at FROM f QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY fiscal_period_end DESC NULLS LAST, submitted_at DESC NULLS FIRST, doc_id DESC) = 1",
    "known_actions": f"WITH a AS ({SOURCED}) SELECT security_code, count(*) AS n_actions, security_code IN (SELECT CAST(c_custkey AS STRING) FROM customer) AS is_known FROM a WHERE source = 'exchange' GROUP BY security_code",
    "merged_filings": _MERGED + " SELECT * FROM merged",
    "new_filing_preview": _MERGED + ", p AS (SELECT *, row_number() OVER (ORDER BY submitted_at DESC NULLS LAST, doc_id) AS place FROM merged WHERE is_new) SELECT place, doc_id, security_code, submitted_at, NULL AS n_more FROM p WHERE place <= 8 UNION ALL SELECT 9, NULL, NULL, NULL, count(*) - 8 FROM p HAVING count(*) > 8",
    "checked_filings": with_stand_ins("financials") + " SELECT doc_id, security_code, fiscal_period_end, CASE WHEN annual_financial_id % 12 = 0 THEN eps_yen + 1000 ELSE eps_yen END AS eps_yen, CASE WHEN annual_financial_id % 6 = 0 THEN 5 ELSE issued_shares END AS issued_shares FROM financials",
    "watchlist_months": f"WITH after AS (SELECT * FROM ({STORED_MONTHS}) WHERE coverage_month NOT IN (SELECT coverage_month FROM ({MONTHS})) UNION ALL SELECT * FROM ({MONTH_ROWS})) SELECT coverage_month, count(*) AS n, count(DISTINCT security_code) AS n_securities FROM after GROUP BY coverage_month",
    "disclosure_report": f"""WITH results AS ({RESULTS}) SELECT disclosure_id, disclosure_id % 5 <> 0 AS is_policy_candidate, CASE WHEN disclosure_id % 5 = 0 THEN 'not_applicable' WHEN status <> 'completed' THEN status ELSE classification END AS analysis,
      CASE WHEN disclosure_id % 5 <> 0 AND status = 'completed' THEN evidence END AS analysis_evidence FROM results UNION ALL SELECT o_orderkey + 100000000, true, 'not_analysed', NULL FROM orders""",
    "policy_report": f"""WITH results AS ({RESULTS}), listed AS (SELECT disclosure_id, security_code, published_date, published_time, title FROM results WHERE disclosure_id % 5 <> 0
        UNION ALL SELECT o_orderkey + 100000000, CAST(o_custkey AS STRING), CAST(o_orderdate AS DATE), '1500', 'order' FROM orders WHERE o_orderkey % 5 <> 0),
      newest AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY published_date DESC, published_time DESC NULLS LAST, CAST(disclosure_id AS STRING) DESC) = 1)
      SELECT n.*, coalesce(r.status, 'not_analysed') AS body_state, CASE WHEN status = 'completed' THEN classification END AS body_classification, CASE WHEN status = 'completed' THEN 'phrase ' || (r.disclosure_id % 7) END AS body_phrase,
        CASE WHEN status = 'completed' THEN evidence END AS body_evidence, CASE WHEN status = 'completed' THEN r.disclosure_id % 9 + 1 END AS body_page, '2024-01-01 00:00:00' AS updated_at, 'machine verdict' AS note
      FROM newest n LEFT JOIN results r ON r.disclosure_id = n.disclosure_id""",
    "month_sources": f"""WITH l AS ({LISTED_FILES}), p AS ({PARSED_FILES}), span AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS DATE) AS month_start),
      by_list AS (SELECT month_start, count(DISTINCT source_url) AS n, min(source_url) AS url FROM l WHERE day(month_start) = 1 GROUP BY 1), by_file AS (SELECT month_start, count(DISTINCT sha256) AS sums, count(DISTINCT source_url) AS urls, min(source_url) AS url FROM p GROUP BY 1)
      SELECT month_start, 'missing' AS problem FROM span WHERE month_start NOT IN (SELECT month_start FROM by_list)
      UNION ALL SELECT month_start, 'ambiguous' FROM span JOIN by_list USING (month_start) WHERE n > 1
      UNION ALL SELECT month_start, 'unparsed' FROM span JOIN by_list USING (month_start) WHERE month_start NOT IN (SELECT month_start FROM by_file)
      UNION ALL SELECT month_start, 'unexpected' FROM by_file WHERE month_start NOT IN (SELECT month_start FROM span)
      UNION ALL SELECT month_start, 'differs' FROM span JOIN by_file f USING (month_start) LEFT JOIN by_list l USING (month_start) WHERE sums > 1 OR urls > 1 OR f.url <> l.url
      UNION ALL SELECT DISTINCT month_start, 'not_first_day' FROM l WHERE day(month_start) <> 1""",
    "misfiled_actions": f"SELECT * FROM ({FILED_ACTIONS}) WHERE effective_date IS NULL OR date_trunc('month', effective_date) <> file_month",
    "alerted_candidates": f"""WITH results AS ({RESULTS}), alerts AS ({ALERTS}), p AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY published_date DESC, published_time DESC NULLS LAST, disclosure_id DESC) = 1),
      a AS (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY published_date DESC, published_time DESC NULLS LAST, row_no) = 1)
      SELECT CAST(c_custkey AS STRING) AS security_code, p.title AS policy_title, a.category AS alert_category, a.published_date AS alert_date, coalesce(a.category IN ('error', 'purchase'), false) AS is_warned
      FROM customer LEFT JOIN p ON p.security_code = CAST(c_custkey AS STRING) LEFT JOIN a ON a.security_code = CAST(c_custkey AS STRING)""",
    "proven_candidates": f"WITH {_EVERY}, {_NEWEST}, {_PROVEN} SELECT * FROM proven",
    "evidence_candidates": _BY_EVIDENCE + " SELECT * FROM both_parts",
    "candidate_sheet": _BY_EVIDENCE + f""", {_NEWEST}, {_PROVEN} SELECT b.security_code, c.company_name, round(CAST(c.dividend_yield_percent AS DOUBLE), 6) AS dividend_yield_percent, b.part, 'restated for splits' AS note, 'adjusted' AS record_used,
      c.is_progressive_dividend_5y_raw, c.progressive_dividend_status_5y, c.dividend_adjustment_status, c.is_adjustment_coverage_complete, c.latest_cumulative_adjustment_factor, c.oldest_cumulative_adjustment_factor_5y, c.dividend_cagr_5y_adjusted_percent,
      c.is_progressive_dividend_5y_adjusted, c.progressive_dividend_status_5y_adjusted, CASE b.part WHEN 1 THEN 'meets the conditions' ELSE 'policy text evidence' END AS added_reason, b.evidence_url IS NOT NULL AS has_text_evidence,
      p.classification, p.document_id, p.report_classification, p.report_doc_id FROM both_parts b JOIN combined c USING (security_code) LEFT JOIN proven p USING (security_code)""",
    "asked_reasons": _COMBINED + _reasons(TIGHT) + " SELECT DISTINCT CAST(s_suppkey * 7 AS STRING) AS security_code, coalesce(array_to_string(r, '; '), 'no data') AS reasons FROM supplier LEFT JOIN reasons ON security_code = CAST(s_suppkey * 7 AS STRING)",
    "health_metrics": _HEALTH + " SELECT * FROM health",
    "health_checks": _HEALTH + " SELECT 'cache' AS name, CASE WHEN latest_trading_date IS NULL OR cache_trading_date IS NULL OR cache_trading_date - 1 < latest_trading_date THEN 'warning' ELSE 'ok' END AS verdict FROM health UNION ALL SELECT 'analyses', CASE WHEN open_analyses > 0 THEN 'warning' ELSE 'ok' END FROM health UNION ALL SELECT 'unsupported_actions', 'ok' FROM health",
    "attribute_counts": with_stand_ins("securities", "prices")
    + f""", listing AS ({LISTING}) SELECT 'securities' AS attribute, 'active' AS value, count(*) AS n FROM securities WHERE is_active UNION ALL SELECT 'securities', 'inactive', count(*) FROM securities WHERE NOT is_active UNION ALL SELECT 'securities', 'total', count(*) FROM securities
      UNION ALL SELECT 'close', 'present', count(*) FROM prices WHERE close_price IS NOT NULL UNION ALL SELECT 'close', 'missing', count(*) FROM prices WHERE close_price IS NULL UNION ALL SELECT 'filing type', type_code, count(*) FROM listing GROUP BY type_code""",
    "analysis_run": f"""WITH results AS ({RESULTS}), states AS (SELECT CASE WHEN analyzer_version <> 'v2' THEN 'open' WHEN status <> 'completed' AND attempts < 3 THEN 'open' WHEN status <> 'completed' THEN 'exhausted' ELSE 'done' END AS state FROM results UNION ALL SELECT 'open' FROM orders),
      n AS (SELECT count(*) FILTER (state = 'open') AS o, count(*) FILTER (state = 'done') AS d, count(*) FILTER (state = 'exhausted') AS e FROM states) SELECT least(o, 100) AS taken, greatest(o - 100, 0) AS deferred, d AS skipped, e AS exhausted FROM n""",
    "market_counts": with_stand_ins("securities") + " SELECT market, count(*) AS n FROM securities GROUP BY market",
}
