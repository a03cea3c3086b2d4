"""Readers of landed files of uneven form: facts of filings, lists of disclosures, pending rights and daily bars.

A file is one row of Spark's binary reader until it is cut into records within
a task; checks of the records are columns. What cannot be read is kept with
its problem where a run shall go on, and an error where it must not.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadyield.functions.text import RATIO, day, let, ratio_factor, security_code
from steadyield.operators.policy import TitleWords, classify_titles

BATCH_ROWS = 5000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; only a local session may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def binary_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path and content of every file below a folder whose name fits a pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def records(files: DataFrame, schema: str, parse: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The records that a function finds in each row of files, as batches of rows under a schema of text and whole numbers."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for k in range(batch.num_rows):
                for row in parse(*(c[k].as_py() for c in batch.columns)):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield as_batch()
                        rows.clear()
        if rows:
            yield as_batch()

    return files.mapInArrow(read, schema)


# The columns of fact files in their usual order, and the names that each goes by, without blanks and in small letters.
FACT_HEADERS = {
    "element_id": ("要素id", "elementid", "element_id"),
    "label": ("項目名", "ラベル", "label", "itemname", "item_name"),
    "context_id": ("コンテキストid", "contextid", "context_id"),
    "relative_year": ("相対年度", "relativeyear", "relative_year"),
    "consolidated": ("連結・個別", "連結個別", "consolidatedornonconsolidated", "consolidated_or_nonconsolidated"),
    "period_type": ("期間・時点", "期間時点", "periodtype", "period_type"),
    "unit_id": ("ユニットid", "unitid", "unit_id"),
    "unit": ("単位", "unit"),
    "value": ("値", "value"),
}
_COLUMN_OF = {name: column for column, names in FACT_HEADERS.items() for name in names}
_MARKS = ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))
HEAD_CHARS = 2000  # where a header must stand for an encoding to be believed


def _clean(text: str) -> str:
    return text.replace("﻿", "").replace("　", " ").strip()


def header_column(name: str) -> str | None:
    """The column that a header names, if any."""
    return _COLUMN_OF.get(re.sub(r"[ \t]", "", unicodedata.normalize("NFKC", _clean(name))).lower())


def decoded(content: bytes) -> str | None:
    """A fact file's text: by its mark of byte order or else by trying, the first encoding under which a known header stands in front; one that merely decodes is second best."""
    marked = [encoding for mark, encoding in _MARKS if content.startswith(mark)]
    second = None
    for encoding in [*marked, "utf-16-le", "utf-8-sig"]:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        head = text[:HEAD_CHARS].split("\n", 1)[0]
        if "\t" in head and any(header_column(h.strip('"\r')) for h in head.split("\t")):
            return text
        second = text if second is None else second
    return second


def _facts_of(path: str, content: bytes) -> Iterator[tuple]:
    nothing = (None,) * len(FACT_HEADERS)
    text = decoded(content)
    if text is None:
        yield (path, 0, *nothing, "no known encoding")
        return
    lines = csv.reader(io.StringIO(text, newline=""), delimiter="\t")
    places: dict[str, int] = {}
    for k, header in enumerate(next(lines, [])):
        if (column := header_column(header)) is not None:
            places[column] = k  # of columns with one name the last counts
    n, width = 0, max([len(FACT_HEADERS) - 1, *places.values()]) + 1
    # a column that no header names, or that is blank in the named place, stands in its usual place
    order = [(places.get(c, k), k) for k, c in enumerate(FACT_HEADERS)]
    plain = str.strip if "\ufeff" not in text and "\u3000" not in text else _clean
    try:
        for n, cells in enumerate((line for line in lines if line), 1):
            told = [*map(plain, cells), *[""] * (width - len(cells))]
            yield (path, n, *[told[a] or told[k] for a, k in order], None)
    except csv.Error as error:
        yield (path, n + 1, *nothing, str(error))
    if n == 0:
        yield (path, 0, *nothing, "no rows")


DOC_PATTERN = r"([^/]+?)(?:_[^/]*)?\.csv$"


def fact_rows(spark: SparkSession, folder: str, doc_pattern: str = DOC_PATTERN) -> DataFrame:
    """Facts of the tab-separated files below a folder, and in rows with a problem, which facts have none, the files and lines that cannot be read.

    Each file has its own encoding and order of columns: columns go by the
    names in its header, and by position where a name is missing; further
    columns are left aside. Audit files (jpaud in the name) are skipped. The
    document is the first group of doc_pattern in the path. row_no follows the
    files of a document by name and the lines within them. Files of no
    bytes have no rows; a document's repeated lines stay.
    """
    files = binary_files(spark, folder, "*.csv").filter(~F.lower(F.element_at(F.split("path", "/"), -1)).contains("jpaud"))
    rows = records(files, "path string, line long, " + ", ".join(f"{c} string" for c in FACT_HEADERS) + ", problem string", _facts_of)
    doc = F.regexp_extract("path", doc_pattern, 1)
    # contents are not read for the order of the files, whose names the driver holds already as it lists them
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    order = files.select("path", doc.alias("doc_id")).withColumn("nth", nth)
    return rows.join(F.broadcast(order), "path").select("doc_id", (F.col("nth").cast("long") * (1 << 40) + F.col("line")).alias("row_no"), *FACT_HEADERS, F.col("path").alias("source_file"), "line", "problem")


def fact_files(spark: SparkSession, folder: str, doc_pattern: str = DOC_PATTERN) -> tuple[DataFrame, DataFrame]:
    """The facts of fact_rows, and the files and lines that cannot be read with their problem; who wants both reads fact_rows, which cuts each file once."""
    rows = fact_rows(spark, folder, doc_pattern)
    return rows.filter("problem is null").drop("line", "problem"), rows.filter("problem is not null").select("source_file", "line", "problem")


def folded(text: str | None) -> str:
    """Compatibility form with single blanks; text of ASCII alone is its own."""
    text = text or ""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


# The table and the cells of a day's list.
LIST_TABLE = "main-list-table"
LIST_CELLS = {"kjTime": "published_time", "kjCode": "code", "kjName": "company_name", "kjTitle": "title", "kjPlace": "exchange"}
LIST_PAGE = r"I_list_\d{3}_(\d{8})\.html$"


class _ListRows(HTMLParser):
    """Cells of a list's rows by class; the title and its address come from the first link in its cell."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, str]] = []
        self.tables: list[bool] = []
        self.row: dict[str, list[str]] | None = None
        self.cell: str | None = None
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        has = dict(attrs)
        if tag == "table":
            self.tables.append(has.get("id") == LIST_TABLE)
        elif tag == "tr" and any(self.tables):
            self.close_row()
            self.row = {}
        elif tag == "td" and self.row is not None:
            self.cell = next((LIST_CELLS[c] for c in (has.get("class") or "").split() if c in LIST_CELLS), None)
            if self.cell and self.cell in self.row:
                self.cell = None
            elif self.cell:
                self.row[self.cell] = []
        elif tag == "a" and self.cell == "title" and has.get("href") is not None and "href" not in self.row:
            self.row["href"], self.in_link = [has["href"]], True

    def handle_data(self, data):
        if self.cell and (self.cell != "title" or self.in_link) and data.strip():
            self.row[self.cell].append(data.strip())

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        elif tag == "td":
            self.cell = None
        elif tag == "tr":
            self.close_row()
        elif tag == "table" and self.tables:
            self.close_row()
            self.tables.pop()

    def close_row(self):
        if self.row and {"published_time", "code", "company_name", "href"} <= set(self.row):
            self.found.append({k: " ".join(v) for k, v in self.row.items()})
        self.row, self.cell, self.in_link = None, None, False


_PLAIN_TAGS = "a|b|br|div|em|i|p|small|span|strong|table|tbody|td|th|thead|tr"
_TOKEN = re.compile(rf'([^<]+)|<(?:/({_PLAIN_TAGS})|({_PLAIN_TAGS})((?: [a-z]+="[^"<>&]*")*)) *>')
_ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')
_FILE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*(?:\?[A-Za-z0-9=._-]+)?")


def _plain_rows(html: str) -> _ListRows | None:
    """The rows of a page of plain tags, quoted attributes and text alone, which one pattern cuts as the parser does; of any other none."""
    page, at = _ListRows(), 0
    for token in _TOKEN.finditer(html):
        if token.start() != at:
            return None
        at = token.end()
        text, closed, opened, attributes = token.groups()
        if text:
            # the parser takes character references for text in the same way
            page.handle_data(unescape(text) if "&" in text else text)
        elif closed:
            page.handle_endtag(closed)
        else:
            page.handle_starttag(opened, _ATTRIBUTE.findall(attributes))
    return page if at == len(html) else None


def _listed(url: str | None, html: str | None) -> Iterator[tuple]:
    if (page := _plain_rows(html or "")) is None:
        page = _ListRows()
        page.feed(html or "")
        page.close()
    page.close_row()
    beside = urljoin(url or "", "x")[:-1]  # names of files stand behind this, whatever they are
    for k, row in enumerate(page.found):
        href = row["href"].strip()
        yield (url, k, *(folded(row.get(c)) for c in LIST_CELLS.values()), beside + href if _FILE_NAME.fullmatch(href) else urljoin(url or "", href))


def listed_disclosures(pages: DataFrame, active: DataFrame, words: TitleWords = TitleWords()) -> DataFrame:
    """Disclosures in daily lists (url, html) that concern dividends of active securities, with category and keywords.

    A page's date stands in its address; a page without one is an error. A row
    needs time, code, name and a linked title; of cells with one class the
    first counts. Texts are folded to their compatibility form before codes and
    words are looked for. Repeated rows stay; a null page has none.
    """
    dated = F.regexp_extract("url", LIST_PAGE, 1)
    known = F.when(F.coalesce(dated, F.lit("")) == "", F.raise_error(F.lit("a list's address has no date")).cast("date")).otherwise(F.to_date(dated, "yyyyMMdd"))
    rows = records(pages.select("url", "html"), "url string, row_no long, " + ", ".join(f"{c} string" for c in LIST_CELLS.values()) + ", pdf_url string", _listed)
    told = rows.withColumns({"published_date": known, "security_code": security_code("code"), "disclosure_id": F.regexp_replace(F.element_at(F.split("pdf_url", "/"), -1), r"(?i)\.pdf(?:\?.*)?$", "")})
    concerned = told.filter("disclosure_id <> ''").join(active.select("security_code").distinct(), "security_code", "left_semi")
    return classify_titles(concerned, words, as_given=True).select("disclosure_id", "published_date", "published_time", "security_code", "company_name", "title", "category", "is_policy_candidate", "matched_keywords", "pdf_url", "exchange", "url", "row_no")


RIGHTS_CELLS = ("company_name", "code", "unit", "ratio", "quantity", "text")


def _rights_of(path: str, content: bytes) -> Iterator[tuple]:
    # decoded as it is read: a whole file's text would take four times its bytes
    for n, cells in enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(content), "cp932", newline="")), 1):
        cells = [folded(c) for c in cells]
        if any(cells):
            yield (path, n, len(cells), *(cells + [""] * 6)[:6])


def _must(value: Column, what: str, kind: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{what}: line "), F.col("line"), F.lit(" of "), F.col("path"))).cast(kind)).otherwise(value)


def rights_files(spark: SparkSession, folder: str, date_pattern: str = r"(\d{8})[^/]*\.csv$") -> DataFrame:
    """Pending rights from six-column quoted files in code page 932, one for each date of allocation, which stands in the file's name.

    Rows coverage_month, allocation_date, security_code, adjustment_factor and
    source_file. Blank lines are skipped. Another width, an unreadable code,
    ratio or date, and a code with two ratios in one file are errors; a code
    that repeats itself counts once. An empty folder gives no rows.
    """
    lines = records(binary_files(spark, folder, "*.csv"), "path string, line long, width long, " + ", ".join(f"{c} string" for c in RIGHTS_CELLS), _rights_of)
    six = lines.withColumn("code", _must(F.when(F.col("width") == 6, F.col("code")), "a line has not six columns", "string"))
    date = F.to_date(F.nullif(F.regexp_extract("path", date_pattern, 1), F.lit("")), "yyyyMMdd")
    read = six.select("path", "line", _must(date, "no date of allocation", "date").alias("allocation_date"), _must(security_code("code"), "no security code", "string").alias("security_code"), _must(F.when(F.col("ratio").rlike(f"^{RATIO}$"), ratio_factor(F.col("ratio"))), "no ratio", "decimal(20,10)").alias("factor"))
    one = F.when(F.max("factor") == F.min("factor"), F.max("factor")).otherwise(F.raise_error(F.concat(F.lit("a code has two ratios in "), F.col("path"))).cast("decimal(20,10)"))
    made = read.groupBy("path", "security_code", "allocation_date").agg(one.alias("adjustment_factor"))
    return made.select(F.trunc("allocation_date", "MM").alias("coverage_month"), "allocation_date", "security_code", "adjustment_factor", F.col("path").alias("source_file"))


# Kinds of rights that a bar may name.
EX_RIGHT_TYPES = ("1", "2", "3")


def bar_records(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars that are corporate actions, without a problem, and what is kept back with its problem: (source_file, record, code, effective_date, adjustment_factor, ex_right_type, problem).

    A line of a file is one answer, an object whose data is a list of objects.
    A bar needs a code, a date and a positive factor (1 where it names none);
    its kind is one of three or none. Bars with factor 1 and no kind are no
    actions. Repeated bars stay. An empty folder gives no rows.
    """
    raw = spark.read.schema("data string, pagination_key string, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(folder).withColumn("source_file", F.input_file_name())
    items = F.from_json(F.when(F.col("broken").isNull() & F.col("data").startswith("["), F.col("data")), "array<string>")
    whole = F.array(F.struct(F.coalesce("broken", "data").alias("record"), F.lit(True).alias("is_answer")))
    parts = F.coalesce(F.transform(items, lambda r: F.struct(r.alias("record"), F.lit(False).alias("is_answer"))), whole)
    bars = raw.select("source_file", F.explode_outer(parts).alias("x")).filter("x is not null")
    # made rows, for a filter of columns would be pushed in front and have them worked out twice
    return bars.select("source_file", F.explode_outer(F.array(let(F.col("x"), _bar))).alias("x")).filter("x is not null").select("source_file", "x.*")


def _bar(x: Column) -> Column:
    """A record read and judged; none if it is no action."""
    bar = F.from_json(F.when(~x["is_answer"], x["record"]), "Code string, Date string, AdjFactor string, ExRT string")
    read = F.struct(bar.alias("b"), F.array_contains(F.json_object_keys(x["record"]), "AdjFactor").alias("has_factor"), (x["record"].startswith("{")).alias("is_object"))

    def cells(r: Column) -> Column:
        factor = F.when(F.coalesce(r["has_factor"], F.lit(False)), F.trim(r["b"]["AdjFactor"]).try_cast("double")).otherwise(1.0)
        return F.struct(r["is_object"].alias("is_object"), F.nullif(F.trim(r["b"]["Code"]), F.lit("")).alias("given"), security_code(r["b"]["Code"]).alias("code"), day(r["b"]["Date"]).alias("effective_date"), factor.alias("adjustment_factor"), F.nullif(F.trim(r["b"]["ExRT"]), F.lit("")).alias("ex_right_type"))

    def judged(r: Column) -> Column:
        factor, kind = r["adjustment_factor"], r["ex_right_type"]
        problem = (
            F.when(x["is_answer"], "no list of data").when(~F.coalesce(r["is_object"], F.lit(False)), "not an object").when(r["given"].isNull() | r["code"].isNull(), "no code").when(r["effective_date"].isNull(), "no date")
            .when(factor.isNull() | ~(factor > 0) | factor.isin(float("inf"), float("nan")), "no positive factor").when(~kind.isin(*EX_RIGHT_TYPES), "unknown kind")
        )
        made = F.struct(x["record"].alias("record"), r["code"].alias("code"), r["effective_date"].alias("effective_date"), factor.alias("adjustment_factor"), kind.alias("ex_right_type"), problem.alias("problem"))
        return let(made, lambda m: F.when(m["problem"].isNotNull() | (factor != 1) | kind.isNotNull(), m))

    return let(let(read, cells), judged)


def bar_payloads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The actions of bar_records (source_file, code, effective_date, adjustment_factor, ex_right_type) and what is kept back (source_file, record, problem); who wants both reads bar_records, which reads each answer once."""
    rows = bar_records(spark, folder)
    return rows.filter("problem is null").drop("record", "problem"), rows.filter("problem is not null").select("source_file", "record", "problem")
