"""Registered queries of landed files and published versions, each with its SQL.

The files are written from the star-schema tables into the shared folder first
and then read back, so the work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.operators import merge, publish
from steadyield.plans.data_queries import _ELEMENTS, _LABELS, WORDS, _like, _one_of
from steadyield.plans.standins import Inputs
from steadyield.sources import files
from steadyield.streaming import feed

_NTH = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS BIGINT)"
# many orders make one filing, a line is a fact
FILED = f"""
SELECT doc_id, {_NTH} AS nth, {_one_of('l_partkey', _ELEMENTS)} AS element_id, {_one_of('l_partkey', _LABELS)} AS label, concat('context "', CAST(l_suppkey AS STRING), '"') AS context_id, {_one_of('l_linenumber', ('当期', '前期', '', '提出者'))} AS relative_year,
       {_one_of('l_suppkey', ('連結', '個別', ''))} AS consolidated, '期間' AS period_type, 'JPY' AS unit_id, '円' AS unit, concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ',000') AS value
FROM (SELECT *, CAST(floor(l_orderkey / 512) AS BIGINT) AS doc_id FROM lineitem) lines
"""
# Headers of fact files in their usual order.
_HEADERS = {"element_id": "要素ID", "label": "項目名", "context_id": "コンテキストID", "relative_year": "相対年度", "consolidated": "連結・個別", "period_type": "期間・時点", "unit_id": "ユニットID", "unit": "単位", "value": "値"}
_SHUFFLED = {"value": "Value", "element_id": "Element ID", "context_id": "context_id", "note": "備考", "unit": "ＵＮＩＴ", "unit_id": "UnitID", "label": "Label", "relative_year": "Relative Year", "period_type": "period_type", "consolidated": "連結個別"}
_PARTLY_NAMED = {**_HEADERS, "value": "x9", "label": "y"}


def _written(rows: DataFrame, folder: str, headers: dict[str, str], encoding: str) -> None:
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "nth").select("doc_id", *(F.col(c).alias(h) for c, h in headers.items()))
    ordered.write.partitionBy("doc_id").option("sep", "\t").option("header", True).option("escape", '"').option("encoding", encoding).csv(folder)


def landed_facts(x: Inputs) -> DataFrame:
    """Fact files in three encodings and orders of columns, beside files without rows."""
    folder, rows = files.shared_path(x.spark, "facts"), x.sql(FILED).withColumn("note", F.lit("further"))
    for k, (headers, encoding) in enumerate(((_HEADERS, "UTF-16"), (_SHUFFLED, "UTF-8"), (_PARTLY_NAMED, "UTF-16LE"))):
        _written(rows.filter(F.col("doc_id") % 3 == k), f"{folder}/{k}", headers, encoding)
    x.table("region").select((-F.col("r_regionkey") - 1).alias("doc_id"), "r_name").write.partitionBy("doc_id").csv(f"{folder}/bare")
    rows, sound = files.fact_rows(x.spark, folder, r"doc_id=([^/]+)/"), F.col("problem").isNull()
    return rows.select("doc_id", F.when(sound, F.col("row_no")).otherwise(F.col("line")).alias("row_no"), *files.FACT_HEADERS, "problem")


# a line is a right to come in its month; a code has one ratio
PENDING = """
SELECT concat('Company "', CAST(l_partkey AS STRING), '", Ltd') AS company_name, concat(CAST(1000 + l_partkey % 9000 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '' END) AS code, '100' AS unit, concat('1:', CAST(2 + l_partkey % 9000 % 3 AS STRING)) AS ratio, '2' AS quantity, CASE WHEN l_suppkey % 2 = 0 THEN 'a, b' END AS text,
       last_day(CAST(l_shipdate AS DATE)) AS allocation_date
FROM lineitem
"""
LINES_A_FILE = 100_000
_RIGHTS = "coverage_month date, allocation_date date, security_code string, adjustment_factor decimal(20,10), source_file string"


def _pending(x: Inputs) -> DataFrame:
    folder, rows = files.shared_path(x.spark, "rights"), x.sql(PENDING).withColumn("on", F.date_format("allocation_date", "yyyyMMdd")).drop("allocation_date")
    dates = rows.groupBy("on").count()
    # a date has as many files as it needs, each with all lines of its codes
    n_files = 1 + (dates.agg(F.max("count")).first()[0] or 0) // LINES_A_FILE
    filed = rows.withColumn("file", F.pmod(F.hash(F.substring("code", 1, 4)), F.lit(n_files))).unionByName(dates.select("on", F.lit(0).alias("file")), allowMissingColumns=True)
    filed.repartition("on", "file").write.partitionBy("on", "file").option("escape", '"').csv(folder)
    return files.rights_files(x.spark, folder, r"on=(\d{8})/")


def pending_right_files(x: Inputs) -> DataFrame:
    return _pending(x).drop("source_file").withColumn("adjustment_factor", F.col("adjustment_factor").cast("double"))


def published_months(x: Inputs) -> DataFrame:
    """Months of pending rights, of which a second run replaces some with fewer rows and empties others."""
    folder, landed = files.shared_path(x.spark, "rights-months"), files.shared_path(x.spark, "rights-read")
    _pending(x).write.parquet(landed)  # the files are read once
    rights = x.spark.read.schema(_RIGHTS).parquet(landed)
    checks = {"month of the date": F.col("coverage_month") == F.trunc("allocation_date", "MM"), "factor": F.col("adjustment_factor") > 0}
    months = rights.select("coverage_month").distinct()
    publish.publish_months(rights, months, folder, checks)
    again = months.filter(F.year("coverage_month") == 1998)
    fewer = rights.filter((F.year("coverage_month") == 1998) & (F.month("coverage_month") > 3) & (F.col("security_code") % 2 == 0))
    publish.publish_months(fewer, again, folder, checks)
    rows, held = publish.current_months(x.spark, folder, _RIGHTS)
    counted = rows.groupBy("coverage_month").agg(F.count(F.lit(1)).alias("n_stored"), F.count_distinct("security_code").alias("n_securities"))
    return held.select("coverage_month", "n_rows").join(counted, "coverage_month", "left").select("coverage_month", "n_rows", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_securities", F.lit(0)).alias("n_securities"))


def audited_upsert(x: Inputs) -> DataFrame:
    """A table and an upsert into it are published; a batch with a broken row and one with repeated keys are refused."""
    folder = files.shared_path(x.spark, "audited")
    old = x.sql("SELECT o_orderkey AS k, o_custkey AS v FROM orders")
    batch = x.sql("SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 100000000 END AS k, l_partkey AS v, l_linenumber * 1000000 + l_partkey AS batch_no FROM lineitem")
    checks = {"key": F.col("k") >= 0, "value": F.col("v") >= 0}
    publish.publish(old, folder, checks, ("k",))
    publish.publish(merge.upsert(publish.current(x.spark, folder), batch, "k"), folder, checks, ("k",))
    refused = 0
    for bad in (old.withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v"))), old.unionByName(old)):
        try:
            publish.publish(bad, folder, checks, ("k",))
        except publish.AuditError:
            refused += 1
    return publish.current(x.spark, folder).withColumn("refused", F.lit(refused))


# an event is a row of a day's list, hundred rows are a page
LISTED = f"""
SELECT event_id, CAST(floor(event_id / 100) AS BIGINT) AS page, concat(CAST(10 + event_id % 12 AS STRING), ':', CAST(10 + event_id % 50 AS STRING)) AS published_time, CAST(1000 + user_id % 300 AS STRING) AS code, concat('Company ', CAST(user_id AS STRING)) AS company_name,
       concat({_one_of('event_id', ('Notice of DOE', 'hation of', 'no word', 'this therea', 'plan with', 'thth', 'from'))}, ' ', event_type) AS title, concat(CAST(event_id AS STRING), {_one_of('event_id', ('.pdf', '.PDF?x=1', '.html'))}) AS file, event_id % 13 <> 0 AS is_whole, event_id % 4 = 0 AS is_wide
FROM events
"""
ACTIVE = "SELECT CAST(1000 + c_custkey AS STRING) AS security_code FROM customer WHERE c_custkey % 3 <> 0"


def daily_disclosures(x: Inputs) -> DataFrame:
    rows = x.sql(LISTED)
    narrow, wide = "".join(chr(c) for c in range(0x21, 0x7F)), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    shown = lambda c: F.when(F.col("is_wide"), F.translate(c, narrow + " ", wide + "　")).otherwise(F.col(c))
    cell = lambda name, body: F.concat(F.lit(f'<td class="x {name}">'), body, F.lit("</td>"))
    link = F.concat(F.lit('<a href="'), F.col("file"), F.lit('">'), shown("title"), F.lit(" <b> </b></a> PDF"))
    row = F.concat(F.lit("<tr>"), cell("kjTime", F.col("published_time")), F.when(F.col("is_whole"), cell("kjCode", F.concat(shown("code"), F.lit("0")))).otherwise(F.lit("<td>")), cell("kjName", shown("company_name")), cell("kjTitle", link), cell("kjPlace", F.lit("東")), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("html")))), lambda r: r["html"]), "\n")
    pages = rows.groupBy("page").agg(F.concat(F.lit('<table><tr><td class="kjTime">menu</table><table id="main-list-table">'), body, F.lit("</table>")).alias("html"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page") % 300).cast("int")), "yyyyMMdd")
    pages = pages.withColumn("url", F.concat(F.lit("https://lists.example/inbs/I_list_"), F.lpad((F.col("page") % 1000).cast("string"), 3, "0"), F.lit("_"), day, F.lit(".html")))
    found = files.listed_disclosures(pages, x.sql(ACTIVE), WORDS)
    return found.withColumn("matched_keywords", F.array_join("matched_keywords", ",")).drop("url", "row_no")


# an order is an answer, its lines are bars; some answers and bars are broken
_BAR_KIND = _one_of("l_orderkey + l_linenumber", ("plain", "split", "kind 9", "no code", "no factor", "bad date", "zero", "join", "null factor"))
BAR_LINES = f"""
SELECT l_orderkey, {_BAR_KIND} AS kind, CAST(1000 + l_partkey % 9000 AS STRING) AS code, CAST(CAST(l_shipdate AS DATE) AS STRING) AS on_day, l_orderkey % 23 = 0 AS no_list, l_orderkey % 29 = 0 AS cut_off
FROM lineitem
"""


def bar_answers(x: Inputs) -> DataFrame:
    lines, kind = x.sql(BAR_LINES), F.col("kind")
    code, date = F.when(kind == "no code", F.lit("")).otherwise(F.concat("code", F.lit("0"))), F.when(kind == "bad date", F.lit("soon")).otherwise(F.col("on_day"))
    text = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    factor = F.when(kind.isin("split", "kind 9"), '"AdjFactor":0.5').when(kind == "join", '"AdjFactor":"5"').when(kind == "zero", '"AdjFactor":0').when(kind == "null factor", '"AdjFactor":null').when(kind == "plain", '"AdjFactor":1.0')
    right = F.when(kind == "split", '"ExRT":"1"').when(kind == "join", '"ExRT":2').when(kind == "kind 9", '"ExRT":"9"').when(kind == "no factor", '"ExRT":null')
    bar = F.concat(F.lit("{"), F.concat_ws(",", text("Code", code), text("Date", date), factor, right), F.lit("}"))
    answers = lines.groupBy("l_orderkey", "no_list", "cut_off").agg(F.array_join(F.collect_list(bar), ",").alias("bars"))
    answer = F.when(F.col("cut_off"), F.concat(F.lit('{"data": ['), "bars")).when(F.col("no_list"), F.concat(F.lit('{"rows": ['), "bars", F.lit("]}"))).otherwise(F.concat(F.lit('{"data": ['), "bars", F.lit('], "pagination_key": "p"}')))
    folder = files.shared_path(x.spark, "bars")
    answers.select(answer.alias("value")).write.text(folder)
    rows, sound = files.bar_records(x.spark, folder), F.col("problem").isNull()
    told = [F.when(sound, F.col(c)).alias(c) for c in ("code", "effective_date", "adjustment_factor", "ex_right_type")]
    return rows.groupBy(*told, "problem").agg(F.count(F.lit(1)).alias("n"))


def replayed_feed(x: Inputs) -> DataFrame:
    """Two overlapping landings and a replay of both go through the feed; the store keeps each disclosure once, by day."""
    folder, columns = files.shared_path(x.spark, "feed"), "disclosure_id long, security_code string, published_date date, title string"
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page") % 300).cast("int"))
    rows = x.sql(LISTED).select(F.col("event_id").alias("disclosure_id"), F.col("code").alias("security_code"), F.when(F.col("event_id") % 17 != 0, day).alias("published_date"), "title")
    for k, kept in enumerate(("disclosure_id % 3 <> 0", "disclosure_id % 3 <> 1", "true")):
        rows.filter(kept).write.parquet(f"{folder}/landed/{k}")
        feed.disclosure_feed(x.spark, f"{folder}/landed/*", rows.schema, f"{folder}/store", f"{folder}/checkpoint", WORDS, x.sql(ACTIVE), "published_date").awaitTermination()
    return x.spark.read.schema(columns + ", category string").parquet(f"{folder}/store")


FUNCTIONS = (landed_facts, pending_right_files, published_months, audited_upsert, daily_disclosures, bar_answers, replayed_feed)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for f in FUNCTIONS}


_MONTHLY = f"WITH pending AS ({PENDING}), rights AS (SELECT DISTINCT CAST(date_trunc('month', allocation_date) AS DATE) AS coverage_month, allocation_date, substr(code, 1, 4) AS security_code, round(1.0 / CAST(substr(ratio, 3) AS DOUBLE), 10) AS adjustment_factor FROM pending)"
_UPPER = tuple(w.upper() for w in WORDS.policy)

SQL = {
    "landed_facts": f"""WITH filed AS ({FILED}) SELECT CAST(doc_id AS VARCHAR) AS doc_id, (1::BIGINT << 40) + nth AS row_no, element_id,
        -- a blank cell takes what stands in its column's usual place
        CASE WHEN label = '' AND doc_id % 3 = 1 THEN element_id ELSE label END AS label, context_id, CASE WHEN relative_year = '' AND doc_id % 3 = 1 THEN 'further' ELSE relative_year END AS relative_year, CASE WHEN consolidated = '' AND doc_id % 3 = 1 THEN unit ELSE consolidated END AS consolidated, period_type, unit_id, unit, value, NULL AS problem FROM filed
      UNION ALL SELECT CAST(-r_regionkey - 1 AS VARCHAR), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no rows' FROM region""",
    "pending_right_files": _MONTHLY + " SELECT * FROM rights",
    "published_months": _MONTHLY
    + """, held AS (SELECT * FROM rights WHERE year(coverage_month) <> 1998 OR (month(coverage_month) > 3 AND CAST(security_code AS INT) % 2 = 0))
      SELECT m.coverage_month, count(h.security_code) AS n_rows, count(h.security_code) AS n_stored, count(DISTINCT h.security_code) AS n_securities FROM (SELECT DISTINCT coverage_month FROM rights) m LEFT JOIN held h USING (coverage_month) GROUP BY m.coverage_month""",
    "audited_upsert": """WITH n AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE l_orderkey + 100000000 END AS k, l_partkey AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey DESC) = 1)
      SELECT *, 2 AS refused FROM n UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_orderkey NOT IN (SELECT k FROM n)""",
    "daily_disclosures": f"""WITH listed AS ({LISTED}), active AS ({ACTIVE})
      SELECT CASE WHEN file LIKE '%.html' THEN file ELSE CAST(event_id AS VARCHAR) END AS disclosure_id, DATE '2024-01-01' + CAST(page % 300 AS INTEGER) AS published_date, published_time, code AS security_code, company_name, title,
        CASE WHEN {_like('upper(title)', _UPPER)} THEN 'policy' WHEN {_like('title', WORDS.cut)} THEN 'cut' WHEN {_like('title', WORDS.rise)} THEN 'rise' WHEN {_like('title', WORDS.forecast)} THEN 'forecast' WHEN {_like('title', WORDS.plan)} THEN 'plan' WHEN {_like('title', WORDS.briefing)} THEN 'briefing' ELSE 'other' END AS category,
        {_like('upper(title)', _UPPER)} OR {_like('title', WORDS.plan)} OR {_like('title', WORDS.briefing)} AS is_policy_candidate,
        array_to_string(list_filter([{', '.join(f"CASE WHEN contains(upper(title), '{w.upper()}') THEN '{w}' END" for w in WORDS.policy + WORDS.dividend)}], lambda w: w IS NOT NULL), ',') AS matched_keywords,
        'https://lists.example/inbs/' || file AS pdf_url, '東' AS exchange
      FROM listed WHERE is_whole AND code IN (SELECT security_code FROM active) AND {_like('upper(title)', tuple(w.upper() for w in WORDS.policy + WORDS.dividend))}""",
    "replayed_feed": f"""WITH listed AS ({LISTED}), active AS ({ACTIVE})
      SELECT event_id AS disclosure_id, code AS security_code, CASE WHEN event_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(page % 300 AS INTEGER) END AS published_date, title,
        CASE WHEN {_like('upper(title)', _UPPER)} THEN 'policy' WHEN {_like('title', WORDS.cut)} THEN 'cut' WHEN {_like('title', WORDS.rise)} THEN 'rise' WHEN {_like('title', WORDS.forecast)} THEN 'forecast' WHEN {_like('title', WORDS.plan)} THEN 'plan' WHEN {_like('title', WORDS.briefing)} THEN 'briefing' ELSE 'other' END AS category
      FROM listed WHERE code IN (SELECT security_code FROM active) AND {_like('upper(title)', tuple(w.upper() for w in WORDS.policy + WORDS.dividend))}""",
    "bar_answers": f"""WITH bars AS ({BAR_LINES}), sound AS (SELECT * FROM bars WHERE NOT no_list AND NOT cut_off)
      SELECT code, CAST(on_day AS DATE) AS effective_date, CASE kind WHEN 'split' THEN 0.5 ELSE 5.0 END AS adjustment_factor, CASE kind WHEN 'split' THEN '1' ELSE '2' END AS ex_right_type, NULL AS problem, count(*) AS n FROM sound WHERE kind IN ('split', 'join') GROUP BY ALL
      UNION ALL SELECT NULL, NULL, NULL, NULL, CASE kind WHEN 'no code' THEN 'no code' WHEN 'bad date' THEN 'no date' WHEN 'kind 9' THEN 'unknown kind' ELSE 'no positive factor' END AS problem, count(*) FROM sound WHERE kind IN ('no code', 'bad date', 'kind 9', 'zero', 'null factor') GROUP BY problem
      UNION ALL SELECT NULL, NULL, NULL, NULL, 'no list of data', count(DISTINCT l_orderkey) FROM bars WHERE no_list OR cut_off""",
}
