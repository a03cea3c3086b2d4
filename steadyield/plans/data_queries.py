"""Registered queries of the policy texts, the checks, the merges and the readers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.operators import facts as fact_ops
from steadyield.operators import merge, policy, quality
from steadyield.plans.standins import AS_OF, Inputs, with_stand_ins
from steadyield.sources import readers

# Words of the stand-in texts that play the parts of the policy terms.
WORDS = policy.TitleWords(
    policy=("hation", "therea", "DOE"), dividend=("with", "that", "from", "and", "plan", "les", "de"), cut=("from",), rise=("with",), forecast=("that",), plan=("thth",), briefing=("inan",),
    names={"policy": "policy", "cut": "cut", "rise": "rise", "forecast": "forecast", "plan": "plan", "briefing": "briefing", "other": "other"},
)
TERMS = policy.PolicyTerms(target=("hation", "thst", "erre"), confirmed=("hation(?:of|and|the)", "thst.*?with", "erre[a-m]"), review=("this", "from", "dans"))

# a disclosure is an event, a report an order
RESULTS = """
SELECT event_id AS disclosure_id, CAST(user_id AS STRING) AS security_code, CAST(ts AS DATE) AS published_date,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(1000 + event_id % 900 AS STRING) END AS published_time,
       CASE event_type WHEN 'error' THEN 'fetch_failed' WHEN 'click' THEN 'pending' ELSE 'completed' END AS status,
       CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'manual_review' ELSE 'not_confirmed' END AS classification,
       concat('title ', CAST(event_id AS STRING)) AS title, concat('u', CAST(event_id % 50 AS STRING)) AS url,
       concat('evidence ', CAST(event_id AS STRING)) AS evidence,
       CASE WHEN event_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS analyzer_version, event_id % 5 AS attempts
FROM events
"""
REPORTS = """
SELECT o_orderkey AS doc_id, CAST(o_custkey AS STRING) AS security_code, CAST(o_orderdate AS DATE) AS submitted_date,
       CASE o_orderkey % 4 WHEN 0 THEN 'failed' ELSE 'completed' END AS status, concat('r', CAST(o_orderkey AS STRING)) AS url,
       CASE o_orderkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'manual_review' ELSE 'not_confirmed' END AS classification, 'seen' AS evidence
FROM orders
"""
HOLDERS = """
SELECT CAST(c_custkey AS STRING) AS security_code, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 50 AS STRING)) END AS url,
       CAST(NULL AS DATE) AS published_date, 'own' AS title
FROM customer
"""

def _one_of(number: str, values: tuple[str, ...]) -> str:
    """SQL that picks by a number's remainder."""
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


# Elements, labels, contexts and values of the stand-in filings, rivals among them.
_ELEMENTS = (
    "jppfs_cor:NetSales", "jpcrp_cor:RevenueIFRSSummaryOfBusinessResults", "jpcrp_cor:RevenuesUSGAAPSummaryOfBusinessResults", "jppfs_cor:OperatingIncome", "jpigp_cor:OperatingProfitLossIFRS", "jppfs_cor:OrdinaryIncome",
    "jppfs_cor:ProfitLoss", "jppfs_cor:ProfitLossAttributableToOwnersOfParent", "jpigp_cor:ProfitLossIFRS", "jpigp_cor:ProfitLossAttributableToOwnersOfParentIFRS", "jpcrp_cor:NetIncomeLossSummaryOfBusinessResults",
    "jppfs_cor:Assets", "jpcrp_cor:TotalAssetsIFRSSummaryOfBusinessResults", "jppfs_cor:NetAssets", "jpigp_cor:EquityIFRS", "jppfs_cor:ShareholdersEquity", "jppfs_cor:NetCashProvidedByUsedInOperatingActivities", "jppfs_cor:NetCashProvidedByUsedInInvestingActivities",
    "jppfs_cor:NetCashProvidedByUsedInFinancingActivities", "jppfs_cor:CashAndCashEquivalents", "jpcrp_cor:BasicEarningsLossPerShareSummaryOfBusinessResults", "jpcrp_cor:NetAssetsPerShareSummaryOfBusinessResults", "jpcrp_cor:DividendPaidPerShareSummaryOfBusinessResults",
    "jpcrp_cor:TotalNumberOfIssuedSharesSummaryOfBusinessResults", "jpcrp_cor:NumberOfIssuedSharesAsOfFiscalYearEndIssuedSharesTotalNumberOfSharesEtc", "jpcrp_cor:TotalNumberOfSharesHeldTreasurySharesEtc", "jpcrp_cor:NumberOfSharesHeldInOwnNameTreasurySharesEtc",
    "jppfs_cor:CurrentAssets", "jppfs_cor:InvestmentSecurities", "jppfs_cor:Liabilities", "jpdei_cor:CurrentFiscalYearStartDateDEI", "jpdei_cor:CurrentPeriodEndDateDEI", "jpdei_cor:AccountingStandardsDEI", "jpdei_cor:WhetherConsolidatedFinancialStatementsArePreparedDEI", "own_cor:Other", "Bare",
)
_LABELS = (
    "売上高", "売上高、経営指標等", "売上収益(IFRS)", "1株当たり当期純利益", "１株当たり 当期純利益", "親会社株主に帰属する当期純利益の内訳", "当期純利益（希薄化後）", "親会社株主に帰属する包括利益", "資本合計（IFRS）", "発行済株式総数（株）", "提出日現在発行済株式総数", "自己株式", "自己株式の平均",
    "流動資産計、連結経営指標等", "会計基準、DEI", "連結決算の有無", "当事業年度終了日", "USGAAP の項目", "other", "", "other", "other", "other",
)
_CONTEXTS = ("CurrentYearDuration", "CurrentYearDuration_NonConsolidatedMember", "Prior1YearDuration", "CurrentYearInstant", "CurrentYearInstant_CommonStockMember", "CurrentYearInstant_PreferredStockMember", "CurrentQuarterInstant", "FilingDateInstant", "CurrentYearDuration_ConsolidatedMember", "InterimDuration_SegmentMember", "")
_NUMBER = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"
LINES_A_PART = 100_000
FILING = "CAST(CAST(floor(l_orderkey / 16) AS BIGINT) AS STRING)"
# sixteen orders make one filing, a line is a fact
FACTS = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS BIGINT) AS row_no, element_id, {_one_of('l_partkey', _LABELS)} AS label,
       {_one_of('l_suppkey + l_linenumber', _CONTEXTS)} AS context_id, {_one_of('l_linenumber + l_partkey', ('当期', '前期', '提出者の当期', ''))} AS relative_year, {_one_of('l_linenumber + l_suppkey', ('連結', '個別', '', '', '非連結'))} AS consolidated,
       {_one_of('l_suppkey + l_partkey', ('JPY', 'JPYPerShares', 'shares', ''))} AS unit_id, {_one_of('l_suppkey', ('円', '株', '円／株', ''))} AS unit,
       CASE WHEN element_id LIKE '%AccountingStandardsDEI' THEN {_one_of('l_orderkey', ('IFRS', '日本基準', 'US GAAP', 'Japan GAAP', '国際 会計基準'))} WHEN element_id LIKE '%WhetherConsolidated%' THEN {_one_of('l_orderkey', ('true', '無', 'FALSE', 'x', '有'))}
         WHEN element_id LIKE '%Date%' THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
         WHEN l_partkey % 13 = 0 THEN {_one_of('l_suppkey', ('－', '', 'n/a', '　'))} WHEN l_partkey % 13 = 1 THEN concat('△', {_NUMBER}) WHEN l_partkey % 13 = 2 THEN concat('(', {_NUMBER}, ')') WHEN l_partkey % 13 = 3 THEN concat(' ', {_NUMBER}, ',000円 ') WHEN l_partkey % 13 = 4 THEN '１２３株' WHEN l_partkey % 13 = 5 THEN concat({_NUMBER}, '000') ELSE {_NUMBER} END AS value
FROM (SELECT *, {FILING} AS doc_id, {_one_of('l_partkey + 7 * l_linenumber', _ELEMENTS)} AS element_id FROM lineitem) lines
"""
# How a quotation table writes numbers.
_AM_OPEN, _CHANGE, _FINAL = "CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE CAST(100 + l_partkey % 50 AS STRING) END", "CASE WHEN l_suppkey % 2 = 0 THEN concat('△', CAST(l_partkey % 9 AS STRING)) ELSE concat('＋', CAST(l_partkey % 9 AS STRING)) END", "CASE l_suppkey % 4 WHEN 0 THEN 'カ1,234' WHEN 1 THEN concat('ウ', CAST(l_partkey AS STRING), '.5') WHEN 2 THEN '/' ELSE '1 020' END"
CELLS = f"""
SELECT l_orderkey AS doc_id, l_linenumber AS row_no, concat(CAST(1000 + l_partkey % 9000 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '' END) AS code, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE '100' END AS unit, concat('name ', CAST(l_partkey AS STRING)) AS name,
       {_AM_OPEN} AS am_open, CAST(150 + l_partkey % 40 AS STRING) AS am_high, CAST(90 + l_partkey % 30 AS STRING) AS am_low,
       CAST(120 + l_partkey % 20 AS STRING) AS am_close, CAST(110 + l_partkey % 60 AS STRING) AS pm_open, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE CAST(160 + l_partkey % 45 AS STRING) END AS pm_high,
       CAST(95 + l_partkey % 35 AS STRING) AS pm_low, CASE WHEN l_linenumber % 5 = 0 THEN '－' ELSE CAST(l_partkey % 25 AS STRING) END AS pm_close,
       {_FINAL} AS final_quote, {_CHANGE} AS change, CAST(l_partkey AS STRING) AS vwap, '1,234' AS volume, '5,678.25' AS turnover
FROM lineitem
"""
_CELL_ORDER = ("code", "unit", "name", "am_open", "am_high", "am_low", "am_close", "pm_open", "pm_high", "pm_low", "pm_close", "final_quote", "change", "vwap", "volume", "turnover")


def lines(x: Inputs) -> DataFrame:
    """Documents as pages: a line of the text is a page."""
    return x.table("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page_no", "text"))


def disclosure_titles(x: Inputs) -> DataFrame:
    titles = lines(x).withColumnRenamed("text", "title")
    return policy.classify_titles(titles, WORDS).select("doc_id", "page_no", "category", "is_policy_candidate", F.array_join("matched_keywords", ",").alias("matched_keywords"))


def policy_pages(x: Inputs) -> DataFrame:
    return policy.classify_pages(lines(x), TERMS).select("doc_id", "classification", "page_no", "matched_phrase", "evidence")


def latest_policy_results(x: Inputs) -> DataFrame:
    return policy.latest_results(x.sql(RESULTS)).select("security_code", "disclosure_id", "published_date", "published_time", "classification")


def enriched_candidates(x: Inputs) -> DataFrame:
    return policy.attach_results(x.sql(HOLDERS), x.sql(RESULTS))


def report_enrichment(x: Inputs) -> DataFrame:
    return policy.attach_filing_results(x.sql(HOLDERS), x.sql(REPORTS)).select("security_code", "report_classification", "report_doc_id")


def text_evidence(x: Inputs) -> DataFrame:
    return policy.evidence(x.sql(RESULTS), x.sql(REPORTS)).select("security_code", "source", "document_id", "published_date", "title", "classification")


def analysis_states(x: Inputs) -> DataFrame:
    targets = x.sql(RESULTS).select("disclosure_id", "published_date").unionByName(x.table("orders").select((F.col("o_orderkey") + 10_000_000).alias("disclosure_id"), F.col("o_orderdate").cast("date").alias("published_date")))
    return policy.analysis_state(targets, x.sql(RESULTS), "v2").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def analysis_counts(x: Inputs) -> DataFrame:
    return policy.status_counts(x.sql(RESULTS))


def constraint_audit(x: Inputs) -> DataFrame:
    c, o = x.financials, x.prices
    return quality.audit(
        quality.rule_violations(c, "financials", {"issued shares positive": F.col("issued_shares") > 0, "dividend not negative": F.col("annual_dividend_yen") >= 0, "status known": F.col("extraction_status").isin("success"), "treasury below issued": F.col("treasury_shares") <= F.col("issued_shares")}),
        quality.rule_violations(o, "prices", {"close present": F.col("close_price").isNotNull(), "close positive": F.col("close_price") > 0}),
        quality.repeated_keys(c, "financials", "security_code", "fiscal_period_end"),
        quality.orphans(o, "prices", "security_code", x.securities.filter("is_active"), "security_code"),
    )


def freshness_report(x: Inputs) -> DataFrame:
    latest = x.prices.agg(F.max("trading_date").alias("latest_date")).withColumn("name", F.lit("prices")).unionByName(x.financials.agg(F.max("fiscal_period_end").alias("latest_date")).withColumn("name", F.lit("financials"))).unionByName(x.financials.agg(F.to_date(F.max("submitted_at")).alias("latest_date")).withColumn("name", F.lit("filings")))
    return quality.freshness(latest, AS_OF)


def table_differences(x: Inputs) -> DataFrame:
    part = x.table("part")
    other = part.filter("p_partkey % 40 <> 0").withColumns({"p_retailprice": F.when(F.col("p_partkey") % 11 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice") + 0.001), "p_name": F.when(F.col("p_partkey") % 13 == 0, F.lit("renamed")).otherwise(F.col("p_name")), "p_size": F.when(F.col("p_partkey") % 17 == 0, None).otherwise(F.col("p_size"))})
    return quality.compare_tables(part, other, "p_partkey")


def conflicting_lines(x: Inputs) -> DataFrame:
    return quality.conflicts(x.table("lineitem"), "l_orderkey", "l_linenumber")


def dividend_diagnosis(x: Inputs) -> DataFrame:
    return quality.summary_verdict(quality.dividend_summary(x.financials))


def history_lengths(x: Inputs) -> DataFrame:
    return quality.history_lengths(x.financials)


def non_decreasing(x: Inputs) -> DataFrame:
    return quality.non_decreasing(x.financials)


def month_gaps(x: Inputs) -> DataFrame:
    months = x.sql("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders WHERE month(o_orderdate) <> 5")
    return quality.month_completeness(months, "1996-01-01", "2000-12-01")


def observed_ranges(x: Inputs) -> DataFrame:
    return quality.observed_ranges(x.prices)


def _snapshot(x: Inputs, late: bool) -> DataFrame:
    """Customers as an old master and as a later batch of some of them with changes."""
    c = x.table("customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("security_code"), F.col("c_name").alias("company_name"), F.when(F.col("c_custkey") % (4 if late else 6) != 0, F.col("c_mktsegment")).alias("industry"), F.when(F.col("c_custkey") % (5 if late else 9) != 0, F.col("c_nationkey").cast("long") + (100 if late else 0)).alias("value"))
    return rows.filter("CAST(security_code AS BIGINT) % 3 <> 0" if late else "CAST(security_code AS BIGINT) % 7 <> 0 OR CAST(security_code AS BIGINT) % 3 = 0")


def master_upsert(x: Inputs) -> DataFrame:
    return merge.upsert_master(_snapshot(x, False).withColumn("is_active", F.lit(True)), _snapshot(x, True))


def coalescing_merge(x: Inputs) -> DataFrame:
    return merge.coalescing_upsert(_snapshot(x, False), _snapshot(x, True).withColumn("batch_no", F.lit(1)), "security_code", overwrite=("company_name", "industry"))


def latest_wins(x: Inputs) -> DataFrame:
    old = x.sql("SELECT o_orderkey AS k, o_custkey AS v FROM orders")
    batch = x.sql("SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 100000000 END AS k, l_partkey AS v, l_linenumber * 1000000 + l_partkey AS batch_no FROM lineitem")
    return merge.upsert(old, batch, "k")


def range_replacement(x: Inputs) -> DataFrame:
    old = x.sql("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS source FROM orders")
    new = x.sql("SELECT l_orderkey + 50000000 AS k, CAST(l_shipdate AS DATE) AS d, 'F' AS source FROM lineitem WHERE l_shipdate >= CAST('1998-01-01' AS TIMESTAMP) AND l_shipdate < CAST('1998-03-01' AS TIMESTAMP)")
    both = merge.replace_range(old, new, "d", F.lit("1998-01-01").cast("date"), F.lit("1998-02-28").cast("date"), F.col("source") == "F")
    return both.groupBy("source", "d").agg(F.count(F.lit(1)).alias("n"))


def status_widening(x: Inputs) -> DataFrame:
    old = x.sql("SELECT CAST(c_custkey AS STRING) AS security_code, DATE '1996-01-01' AS covered_from, DATE '1998-12-31' AS covered_to, DATE '1996-01-05' AS observed_from, DATE '1998-11-30' AS observed_to, 'complete' AS sync_status FROM customer WHERE c_custkey % 4 <> 0")
    seen = x.sql("SELECT CAST(o_custkey AS STRING) AS security_code, min(CAST(o_orderdate AS DATE)) AS covered_from, max(CAST(o_orderdate AS DATE)) AS covered_to, min(CAST(o_orderdate AS DATE)) AS observed_from, max(CAST(o_orderdate AS DATE)) AS observed_to, CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS sync_status FROM orders GROUP BY o_custkey")
    return merge.widen_status(old, seen)


def attempt_counts(x: Inputs) -> DataFrame:
    old = x.sql("SELECT event_id AS disclosure_id, event_type AS status, event_id % 4 AS attempts FROM events WHERE event_id % 3 <> 0 OR event_id % 2 <> 0")
    new = x.sql("SELECT event_id AS disclosure_id, 'completed' AS status FROM events WHERE event_id % 2 = 0")
    return merge.record_attempts(old, new)


def append_only_new(x: Inputs) -> DataFrame:
    old = x.sql("SELECT event_id AS k, event_type AS v FROM events WHERE event_id % 3 = 0")
    return merge.append_new(old, x.sql("SELECT event_id AS k, 'new' AS v FROM events"), "k")


def filing_metrics(x: Inputs) -> DataFrame:
    # as many parts as keep the sorts of each in memory, dealt by filing before lines are numbered
    lines = x.table("lineitem")
    parts = lines.repartition(1 + lines.count() // LINES_A_PART, F.expr(FILING))
    return fact_ops.extract_metrics(x.sql(FACTS, lineitem=parts), listed=x.sql(FACTS))


def page_links(x: Inputs) -> DataFrame:
    return readers.listed_links(x.table("pages"))


def day_quotations(x: Inputs) -> DataFrame:
    cells = x.sql(CELLS)
    rows = cells.select("doc_id", "row_no", F.array(*_CELL_ORDER).alias("cells"))
    return readers.quotations(rows).withColumn("change_percent", F.round("change_percent", 6))


def listed_master(x: Inputs) -> DataFrame:
    rows = x.sql("SELECT CAST(1000 + c_custkey % 9000 AS STRING) AS code5, CAST(NULL AS STRING) AS code, c_name AS name, CASE n_regionkey WHEN 0 THEN 'プライム（内国株式）' WHEN 1 THEN 'スタンダード（内国株式）' WHEN 2 THEN 'グロース（内国株式）' WHEN 3 THEN 'プライム（外国株式）' ELSE 'ETF' END AS market_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    return readers.listed_securities(rows, {"security_code": ("code", "code5"), "company_name": ("name",), "market": ("market_name", "segment")})


FUNCTIONS = (disclosure_titles, policy_pages, latest_policy_results, enriched_candidates, report_enrichment, text_evidence, analysis_states, analysis_counts, constraint_audit, freshness_report, table_differences, conflicting_lines, dividend_diagnosis, history_lengths, non_decreasing, month_gaps, observed_ranges, master_upsert, coalescing_merge, latest_wins, range_replacement, status_widening, attempt_counts, append_only_new, filing_metrics, page_links, day_quotations, listed_master)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for f in FUNCTIONS}


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_LINES = "pages0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS page_no FROM documents)"
_UPPER = tuple(w.upper() for w in WORDS.policy)
_RECORD = "record AS (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY security_code, fiscal_period_end ORDER BY submitted_at DESC NULLS LAST, extracted_at DESC NULLS LAST, annual_financial_id DESC) = 1)"
_COMPLETED = f"WITH results AS ({RESULTS}), latest AS (SELECT * FROM results WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY published_date DESC, published_time DESC NULLS LAST, disclosure_id DESC) = 1)"
_OLD = "SELECT CAST(c_custkey AS STRING) AS security_code, c_name AS company_name, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS value FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0"
_NEW = "SELECT CAST(c_custkey AS STRING) AS security_code, c_name AS company_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey + 100 END AS value FROM customer WHERE c_custkey % 3 <> 0"


def _number(c: str) -> str:
    marked = f"regexp_replace(replace(replace(replace({c}, '△', '-'), ',', ''), ' ', ''), '^(-?)[カウ]', '\\1')"
    return f"TRY_CAST(nullif(regexp_extract({marked}, '[-+]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"


_WIDE = ("０１２３４５６７８９（）／", "0123456789()/")


def _quoted(words: tuple[str, ...], plain: bool = False) -> str:
    return "(" + ", ".join("'" + (w.translate(str.maketrans(*_WIDE)) if plain else w) + "'" for w in words) + ")"


def _has(column: str, words: tuple[str, ...], plain: bool = False) -> str:
    """Does the column contain one of the words?"""
    return "(" + (" OR ".join(f"contains({column}, '{w.translate(str.maketrans(*_WIDE)) if plain else w}')" for w in words) or "false") + ")"


_OWN_UNIT = {
    None: "true",
    "per_share": f"(contains(lower(suffix), 'pershare') OR {_has('unit_text', fact_ops.PER_SHARE_UNITS)})",
    "shares": f"(contains(lower(suffix), 'numberofissuedshares') OR {_has('unit_text', fact_ops.SHARE_UNITS)})",
}


def _offer(m: fact_ops.Metric) -> str:
    """A fact's offer to one metric: does it match, may it be used, can it be read, what is it worth?"""
    exact = f"suffix IN {_quoted(m.elements)}"
    ended = tuple(a + b for a in m.labels for b in fact_ops.LABEL_ENDINGS)
    loose = _has("plain", m.required, True) if m.required else f"plain IN {_quoted(ended, True)}"
    matches = f"({exact} OR plain IN {_quoted(m.labels, True)} OR (NOT {_has('plain', m.excluded, True)} AND {loose}))"
    standard = "(standard IS NULL OR scope = 'neutral' OR (standard IN ('IFRS', 'Japan GAAP', 'US GAAP') AND scope = standard))" if m.of_scope else "true"
    scope = "(is_consolidated IS NULL OR side <> CASE WHEN is_consolidated THEN 'alone' ELSE 'group' END)" if m.of_scope else "true"
    needs = _OWN_UNIT[m.unit] if m.needs_unit else "true"
    amount = f"CASE WHEN value IN {_quoted(fact_ops.DASHES)} THEN 0 ELSE amount END" if m.dash_is_zero else "amount"
    sane = {None: "true", "per_share": f"abs({amount}) <= 10000000", "shares": f"{amount} >= 0"}[m.unit]
    read = "value <> ''" if m.kind == "text" else f"{amount} IS NOT NULL AND {sane}"
    parts = [
        f"CASE WHEN {exact} THEN 200 ELSE 0 END", f"CASE WHEN label IN {_quoted(m.labels)} THEN 140 WHEN {_has('label', m.labels)} THEN 80 ELSE 0 END", "common", f"CASE WHEN {exact} THEN 500 ELSE 0 END",
        "CASE WHEN standard IN ('IFRS', 'Japan GAAP') AND scope = standard THEN 250 ELSE 0 END", f"CASE WHEN {_OWN_UNIT[m.unit]} THEN 20 ELSE 0 END",
        "CASE consolidated WHEN '連結' THEN 45 WHEN '個別' THEN -20 ELSE 0 END + CASE WHEN contains(context_id, 'ConsolidatedMember') THEN 20 ELSE 0 END - CASE WHEN contains(context_id, 'NonConsolidatedMember') THEN 15 ELSE 0 END" if m.of_scope else "CASE consolidated WHEN '個別' THEN 15 ELSE 0 END",
    ]
    if m.name == "net_income":
        parts += ["CASE WHEN suffix LIKE 'ProfitLossAttributableToOwnersOfParent%' THEN 500 WHEN suffix LIKE 'ProfitLoss%' THEN -100 ELSE 0 END", "CASE WHEN context_id = 'CurrentYearDuration' THEN 100 WHEN starts_with(context_id, 'CurrentYearDuration_') THEN -200 ELSE 0 END"]
    if m.unit == "shares":
        parts += ["CASE WHEN contains(context_id, 'CommonStockMember') THEN 200 ELSE 0 END", "CASE WHEN contains(context_id, 'PreferredStockMember') THEN -400 ELSE 0 END", "CASE suffix WHEN 'NumberOfIssuedSharesAsOfFiscalYearEndIssuedSharesTotalNumberOfSharesEtc' THEN 150 WHEN 'TotalNumberOfIssuedSharesSummaryOfBusinessResults' THEN 100 WHEN 'TotalNumberOfSharesHeldTreasurySharesEtc' THEN 150 WHEN 'NumberOfSharesHeldInOwnNameTreasurySharesEtc' THEN -150 ELSE 0 END"]
    return f"""SELECT doc_id, row_no, '{m.name}' AS metric, CASE WHEN {str(m.kind == 'number').lower()} THEN {amount} END AS amount, value, element_id, {' + '.join(parts)} AS score
    FROM known WHERE {matches} AND {standard} AND {scope} AND {needs} AND {read}"""


_METRIC_SQL = f"""WITH facts AS ({FACTS}),
  clean AS (SELECT * REPLACE (trim(value, ' ' || '　') AS value), split_part(element_id, ':', -1) AS suffix, translate(replace(label, ' ', ''), '{_WIDE[0]}', '{_WIDE[1]}') AS plain, lower(translate(replace(unit_id || ' ' || unit, ' ', ''), '{_WIDE[0]}', '{_WIDE[1]}')) AS unit_text FROM facts),
  number AS (SELECT *, TRY_CAST(nullif(regexp_extract(translate(replace(replace(replace(value, ',', ''), '円', ''), '株', ''), '０１２３４５６７８９△', '0123456789-'), '[-+]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS found FROM clean),
  parted AS (SELECT *, CASE WHEN starts_with(value, '(') AND ends_with(value, ')') THEN -abs(found) ELSE found END AS amount FROM number),
  told AS (SELECT doc_id, row_no, CASE suffix WHEN 'AccountingStandardsDEI' THEN 200 ELSE 0 END + CASE context_id WHEN 'FilingDateInstant' THEN 50 ELSE 0 END AS score,
      CASE WHEN contains(lower(v), 'ifrs') OR contains(v, '国際会計基準') THEN 'IFRS' WHEN contains(lower(v), 'japangaap') OR contains(v, '日本基準') THEN 'Japan GAAP' WHEN contains(lower(v), 'usgaap') THEN 'US GAAP' ELSE value END AS standard
    FROM (SELECT *, replace(value, ' ', '') AS v FROM parted) WHERE (suffix = 'AccountingStandardsDEI' OR plain IN ('会計基準、DEI', '会計基準')) AND value <> ''),
  standards AS (SELECT doc_id, standard FROM told QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_no) = 1),
  flags AS (SELECT doc_id, lower(value) IN ('true', '1', 'yes', '有', 'あり') AS is_consolidated FROM parted WHERE (suffix = 'WhetherConsolidatedFinancialStatementsArePreparedDEI' OR plain IN ('連結決算の有無、DEI', '連結決算の有無')) AND lower(value) IN ('true', '1', 'yes', '有', 'あり', 'false', '0', 'no', '無', 'なし') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_no) = 1),
  known AS (SELECT p.*, standard, is_consolidated,
      CASE WHEN contains(upper(replace(element_id || label, ' ', '')), 'USGAAP') THEN 'US GAAP' WHEN contains(lower(element_id), 'ifrs') OR starts_with(element_id, 'jpigp') THEN 'IFRS' WHEN starts_with(element_id, 'jppfs') OR contains(suffix, 'SummaryOfBusinessResults') THEN 'Japan GAAP' ELSE 'neutral' END AS scope,
      CASE WHEN contains(context_id, 'NonConsolidatedMember') OR consolidated IN ('個別', '非連結') THEN 'alone' WHEN contains(context_id, 'ConsolidatedMember') OR consolidated = '連結' THEN 'group' ELSE 'unknown' END AS side,
      CASE WHEN contains(relative_year, '当期') OR contains(relative_year, '提出者') THEN 60 ELSE 0 END - CASE WHEN contains(relative_year, '前期') THEN 200 ELSE 0 END
      + CASE WHEN contains(context_id, 'CurrentYear') THEN 50 ELSE 0 END + CASE WHEN contains(context_id, 'Current') THEN 15 ELSE 0 END - CASE WHEN contains(context_id, 'Prior') THEN 200 ELSE 0 END - CASE WHEN contains(context_id, 'Segment') THEN 80 ELSE 0 END
      + CASE WHEN contains(context_id, 'CurrentYearDuration') THEN 80 ELSE 0 END + CASE WHEN contains(context_id, 'CurrentYearInstant') THEN 80 ELSE 0 END + CASE WHEN contains(suffix, 'SummaryOfBusinessResults') THEN 70 ELSE 0 END - CASE WHEN contains(context_id, 'Quarter') THEN 300 ELSE 0 END - CASE WHEN contains(context_id, 'Interim') THEN 300 ELSE 0 END AS common
    FROM parted p LEFT JOIN standards USING (doc_id) LEFT JOIN flags USING (doc_id)),
  offers AS ({' UNION ALL '.join(_offer(m) for m in fact_ops.METRICS)}),
  best AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY doc_id, metric ORDER BY score DESC, row_no) = 1)
  SELECT d.doc_id, {', '.join(f"max({'amount' if m.kind == 'number' else 'value'}) FILTER (metric = '{m.name}') AS {m.name}, max(element_id) FILTER (metric = '{m.name}') AS {m.name}_element" for m in fact_ops.METRICS)}, any_value(s.standard) AS standard, any_value(f.is_consolidated) AS is_consolidated, count(metric) AS n_found
  FROM (SELECT DISTINCT doc_id FROM facts) d LEFT JOIN best b USING (doc_id) LEFT JOIN standards s USING (doc_id) LEFT JOIN flags f USING (doc_id) GROUP BY d.doc_id"""

SQL = {
    "filing_metrics": _METRIC_SQL,
    "disclosure_titles": f"""WITH {_LINES}
      SELECT doc_id, page_no, CASE WHEN {_like('upper(text)', _UPPER)} THEN 'policy' WHEN {_like('text', WORDS.cut)} THEN 'cut' WHEN {_like('text', WORDS.rise)} THEN 'rise' WHEN {_like('text', WORDS.forecast)} THEN 'forecast' WHEN {_like('text', WORDS.plan)} THEN 'plan' WHEN {_like('text', WORDS.briefing)} THEN 'briefing' ELSE 'other' END AS category,
        {_like('upper(text)', _UPPER)} OR {_like('text', WORDS.plan)} OR {_like('text', WORDS.briefing)} AS is_policy_candidate,
        array_to_string(list_filter([{', '.join(f"CASE WHEN contains(upper(text), '{w.upper()}') THEN '{w}' END" for w in WORDS.policy + WORDS.dividend)}], lambda w: w IS NOT NULL), ',') AS matched_keywords
      FROM pages0 WHERE {_like('upper(text)', tuple(w.upper() for w in WORDS.policy + WORDS.dividend))}""",
    "policy_pages": f"""WITH {_LINES},
      cut AS (SELECT doc_id, page_no, unnest(regexp_extract_all(text, '[^。！？!?\\r\\n]*[。！？!?]|[^。！？!?\\r\\n]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[^。！？!?\\r\\n]*[。！？!?]|[^。！？!?\\r\\n]+'), 1) AS k FROM pages0),
      told AS (SELECT *, trim(regexp_replace(raw, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS sentence, regexp_replace(raw, '[ \\t\\n\\x0b\\f\\r]+', '', 'g') AS plain FROM cut),
      found AS (SELECT *, coalesce({', '.join(f"nullif(regexp_extract(plain, '{p}'), '')" for p in TERMS.confirmed)}) AS stated, CASE {' '.join(f"WHEN contains(plain, '{t}') THEN '{t}'" for t in TERMS.target)} END AS term FROM told WHERE {_like('plain', TERMS.target)}),
      best AS (SELECT *, stated IS NOT NULL AND NOT {_like('plain', TERMS.review)} AS sure FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sure DESC, page_no, k) = 1)
      SELECT d.doc_id, CASE WHEN b.doc_id IS NULL THEN 'not_confirmed' WHEN sure THEN 'confirmed' ELSE 'manual_review' END AS classification, page_no, coalesce(stated, term) AS matched_phrase, sentence AS evidence
      FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best b ON b.doc_id = d.doc_id""",
    "latest_policy_results": _COMPLETED + " SELECT security_code, disclosure_id, published_date, published_time, classification FROM latest",
    "enriched_candidates": _COMPLETED + f""", holders AS ({HOLDERS}), fit AS (SELECT h.*, l.published_date AS r_date, l.title AS r_title, l.url AS r_url, l.classification, l.evidence, h.url IS NULL OR trim(h.url) = '' AS is_open, l.url IS NOT NULL AND (h.url IS NULL OR trim(h.url) = '' OR h.url = l.url) AS fits FROM holders h LEFT JOIN latest l USING (security_code))
      SELECT security_code, CASE WHEN is_open AND fits THEN r_date ELSE published_date END AS published_date, CASE WHEN is_open AND fits THEN r_title ELSE title END AS title, CASE WHEN is_open AND fits THEN r_url ELSE url END AS url, CASE WHEN fits THEN classification END AS classification, CASE WHEN fits THEN evidence END AS evidence FROM fit""",
    "report_enrichment": f"WITH reports AS ({REPORTS}), newest AS (SELECT * FROM reports WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY submitted_date DESC, doc_id DESC) = 1) SELECT CAST(c_custkey AS STRING) AS security_code, classification AS report_classification, doc_id AS report_doc_id FROM customer LEFT JOIN newest ON security_code = CAST(c_custkey AS STRING)",
    "text_evidence": f"""WITH results AS ({RESULTS}), reports AS ({REPORTS}), every AS (SELECT security_code, 'disclosure' AS source, CAST(disclosure_id AS STRING) AS document_id, published_date, title, classification FROM results WHERE status = 'completed' AND classification <> 'not_confirmed'
        UNION ALL SELECT security_code, 'report', CAST(doc_id AS STRING), submitted_date, NULL, classification FROM reports WHERE status = 'completed' AND classification <> 'not_confirmed')
      SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY classification = 'confirmed' DESC, published_date DESC, document_id DESC) = 1""",
    "analysis_states": f"WITH results AS ({RESULTS}) SELECT CASE WHEN analyzer_version <> 'v2' THEN 'version_changed' WHEN status <> 'completed' AND attempts < 3 THEN 'retry' WHEN status <> 'completed' THEN 'exhausted' ELSE 'done' END AS state, count(*) AS n FROM results GROUP BY 1 UNION ALL SELECT 'new', count(*) FROM orders",
    "analysis_counts": f"WITH results AS ({RESULTS}) SELECT status, count(*) FILTER (classification = 'confirmed') AS confirmed, count(*) FILTER (classification = 'manual_review') AS manual_review, count(*) FILTER (classification = 'not_confirmed') AS not_confirmed FROM results GROUP BY status",
    "constraint_audit": with_stand_ins("securities", "financials", "prices")
    + """ SELECT 'financials' AS "table", 'issued shares positive' AS rule, count(*) FILTER (NOT issued_shares > 0) AS violations FROM financials UNION ALL SELECT 'financials', 'dividend not negative', count(*) FILTER (NOT annual_dividend_yen >= 0) FROM financials
      UNION ALL SELECT 'financials', 'status known', count(*) FILTER (extraction_status <> 'success') FROM financials UNION ALL SELECT 'financials', 'treasury below issued', count(*) FILTER (NOT treasury_shares <= issued_shares) FROM financials
      UNION ALL SELECT 'prices', 'close present', count(*) FILTER (close_price IS NULL) FROM prices UNION ALL SELECT 'prices', 'close positive', count(*) FILTER (NOT close_price > 0) FROM prices
      UNION ALL SELECT 'financials', 'unique security_code, fiscal_period_end', count(*) FROM (SELECT 1 FROM financials GROUP BY security_code, fiscal_period_end HAVING count(*) > 1)
      UNION ALL SELECT 'prices', 'security_code exists', count(*) FROM prices WHERE security_code NOT IN (SELECT security_code FROM securities WHERE is_active)""",
    "freshness_report": with_stand_ins("financials", "prices")
    + f""", latest AS (SELECT 'prices' AS name, max(trading_date) AS latest_date, 5 AS most FROM prices UNION ALL SELECT 'financials', max(fiscal_period_end), 400 FROM financials UNION ALL SELECT 'filings', CAST(max(submitted_at) AS DATE), 4 FROM financials)
      SELECT name, latest_date, greatest(DATE '{AS_OF}' - latest_date, 0) AS age_days, CASE WHEN latest_date IS NULL OR DATE '{AS_OF}' - latest_date > most THEN 'warning' ELSE 'ok' END AS verdict FROM latest""",
    "table_differences": """WITH other AS (SELECT * REPLACE (p_retailprice + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0.001::DOUBLE END AS p_retailprice, CASE WHEN p_partkey % 13 = 0 THEN 'renamed' ELSE p_name END AS p_name, CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS p_size) FROM part WHERE p_partkey % 40 <> 0),
      cells AS (SELECT coalesce(l.p_partkey, r.p_partkey) AS p_partkey, r.p_partkey IS NULL AS lost, l.p_partkey IS NULL AS extra, unnest(["""
    + ", ".join(f"{{'c': '{c}', 'a': CAST(l.{c} AS VARCHAR), 'b': CAST(r.{c} AS VARCHAR), 'numeric': {str(n).lower()}}}" for c, n in (("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)))
    + """], recursive := true) FROM part l FULL JOIN other r ON l.p_partkey = r.p_partkey)
      SELECT DISTINCT p_partkey, 'missing on the right' AS "column", NULL AS left_value, NULL AS right_value FROM cells WHERE lost UNION ALL SELECT DISTINCT p_partkey, 'missing on the left', NULL, NULL FROM cells WHERE extra
      UNION ALL SELECT p_partkey, c, a, b FROM cells WHERE NOT lost AND NOT extra AND (a IS NULL) <> (b IS NULL) OR NOT lost AND NOT extra AND CASE WHEN "numeric" THEN abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) > 0.01 ELSE a <> b END""",
    "conflicting_lines": "SELECT l_orderkey, l_linenumber, count(*) AS versions FROM (SELECT DISTINCT * FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1",
    "dividend_diagnosis": with_stand_ins("financials")
    + """, again AS (SELECT count(*) AS n FROM financials GROUP BY security_code, fiscal_period_end HAVING count(*) > 1), s AS (SELECT count(*) AS n_rows, count(DISTINCT security_code) AS n_securities, count(annual_dividend_yen) AS n_dividends, count(*) FILTER (annual_dividend_yen = 0) AS n_zero, count(*) FILTER (annual_dividend_yen < 0) AS n_negative,
        (SELECT count(*) FROM again) AS repeated_periods, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM again) AS rows_in_repeated_periods FROM financials) SELECT *, CASE WHEN n_negative > 0 OR repeated_periods > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM s""",
    "history_lengths": with_stand_ins("financials") + ", " + _RECORD + ", h AS (SELECT count(*) AS periods FROM record GROUP BY security_code) SELECT periods, count(*) AS securities FROM h GROUP BY periods",
    "non_decreasing": with_stand_ins("financials") + ", " + _RECORD
    + """, ranked AS (SELECT security_code, annual_dividend_yen AS d, row_number() OVER w AS k, lead(annual_dividend_yen) OVER w AS b FROM record WINDOW w AS (PARTITION BY security_code ORDER BY fiscal_period_end DESC, annual_financial_id DESC) QUALIFY k <= 5)
      SELECT security_code FROM ranked GROUP BY security_code HAVING count(*) = 5 AND count(d) = 5 AND bool_and(CASE WHEN k < 5 THEN d >= b ELSE true END) ORDER BY security_code LIMIT 50""",
    "month_gaps": """WITH have AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders WHERE month(o_orderdate) <> 5), span AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS m)
      SELECT coalesce(span.m, have.m) AS month_start, CASE WHEN have.m IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM span FULL JOIN have ON span.m = have.m WHERE span.m IS NULL OR have.m IS NULL""",
    "observed_ranges": with_stand_ins("prices") + " SELECT security_code, min(trading_date) AS observed_from, max(trading_date) AS observed_to, count(*) AS n FROM prices GROUP BY security_code",
    "master_upsert": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT security_code, CASE WHEN n.security_code IS NOT NULL THEN n.company_name ELSE o.company_name END AS company_name, CASE WHEN n.security_code IS NOT NULL THEN n.industry ELSE o.industry END AS industry, CASE WHEN n.security_code IS NOT NULL THEN n.value ELSE o.value END AS value, n.security_code IS NOT NULL AS is_active FROM o FULL JOIN n USING (security_code)",
    "coalescing_merge": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT security_code, CASE WHEN n.security_code IS NOT NULL THEN n.company_name ELSE o.company_name END AS company_name, CASE WHEN n.security_code IS NOT NULL THEN n.industry ELSE o.industry END AS industry, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (security_code)",
    "latest_wins": """WITH n AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 100000000 END AS k, l_partkey AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey DESC) = 1)
      SELECT * FROM n UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM n)""",
    "range_replacement": """SELECT source, d, count(*) AS n FROM (SELECT o_orderstatus AS source, CAST(o_orderdate AS DATE) AS d FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-02-28', false)
      UNION ALL SELECT 'F', CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-03-01') GROUP BY source, d""",
    "status_widening": """WITH o AS (SELECT CAST(c_custkey AS STRING) AS security_code, DATE '1996-01-01' AS a, DATE '1998-12-31' AS z, DATE '1996-01-05' AS oa, DATE '1998-11-30' AS oz, 'complete' AS s FROM customer WHERE c_custkey % 4 <> 0),
      n AS (SELECT CAST(o_custkey AS STRING) AS security_code, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z, CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS s FROM orders GROUP BY o_custkey)
      SELECT security_code, CASE WHEN n.s = 'complete' THEN least(o.a, n.a) ELSE o.a END AS covered_from, CASE WHEN n.s = 'complete' THEN greatest(o.z, n.z) ELSE o.z END AS covered_to, least(o.oa, n.a) AS observed_from, greatest(o.oz, n.z) AS observed_to, coalesce(n.s, o.s) AS sync_status FROM o FULL JOIN n USING (security_code)""",
    "attempt_counts": """WITH o AS (SELECT event_id, event_type, event_id % 4 AS a FROM events WHERE event_id % 3 <> 0 OR event_id % 2 <> 0), n AS (SELECT event_id FROM events WHERE event_id % 2 = 0)
      SELECT coalesce(n.event_id, o.event_id) AS disclosure_id, CASE WHEN n.event_id IS NOT NULL THEN 'completed' ELSE event_type END AS status, CASE WHEN n.event_id IS NOT NULL THEN coalesce(a, 0) + 1 ELSE a END AS attempts FROM o FULL JOIN n ON o.event_id = n.event_id""",
    "append_only_new": "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'new' END AS v FROM events",
    "day_quotations": f"""WITH cells AS ({CELLS}), n AS (SELECT doc_id, row_no, substr(code, 1, 4) AS security_code, name AS quoted_name, {', '.join(f"{_number(c)} AS {c}" for c in _CELL_ORDER if c not in ('code', 'name'))} FROM cells WHERE unit <> ''),
      p AS (SELECT doc_id, row_no, security_code, quoted_name, unit AS trading_unit, coalesce(am_open, pm_open) AS open_price, greatest(am_high, pm_high) AS high_price, least(am_low, pm_low) AS low_price, coalesce(pm_close, am_close) AS close_price, final_quote, change, coalesce(pm_close, am_close) - change AS previous_close, vwap, volume, turnover FROM n)
      SELECT *, CASE WHEN previous_close <> 0 THEN round(change / previous_close * 100, 6) + 0 END AS change_percent FROM p""",
    "listed_master": "SELECT CAST(1000 + c_custkey % 9000 AS STRING) AS security_code, c_name AS company_name, CASE n_regionkey WHEN 0 THEN 'prime' WHEN 1 THEN 'standard' ELSE 'growth' END AS market FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1, 2)",
}
