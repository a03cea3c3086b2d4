"""Readers of the landed files and pages, down to typed rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyield.functions.text import action, day, found_number, let, number, security_code

class _Links(HTMLParser):
    """Collects rows of link address and text."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


def listed_links(pages: DataFrame) -> DataFrame:
    """Every link of rows (page_id, url, html): resolved address, title and the stem of its file name."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html in batch.itertuples(index=False):
                parser = _Links()
                parser.feed(html or "")
                out += [(page_id, k, urljoin(url or "", href), title) for k, (href, title) in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=["page_id", "link_no", "link_url", "title"])

    links = pages.select("page_id", "url", "html").mapInPandas(read, "page_id long, link_no long, link_url string, title string")
    return links.withColumn("link_id", F.regexp_extract("link_url", r"([^/?#]*?)(?:\.[^./?#]*)?(?:[?#].*)?$", 1))


DOMESTIC = "内国株式"
MARKETS = (("プライム", "prime"), ("スタンダード", "standard"), ("グロース", "growth"))


def listed_securities(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """The master list: columns by any of their names, domestic shares on the three markets, ordered by market and code. Foreign shares on these markets aren't listed."""
    found = {name: F.coalesce(*(F.col(f"`{c}`") for c in names if c in rows.columns)) for name, names in aliases.items()}
    named = rows.select(*(c.alias(n) for n, c in found.items()))
    market, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (word, short) in reversed(list(enumerate(MARKETS))):
        market = F.when(F.col("market").contains(word), short).otherwise(market)
        rank = F.when(F.col("market").contains(word), k).otherwise(rank)
    kept = named.filter(F.col("market").contains(DOMESTIC)).withColumn("__rank", rank).withColumns({"market": market, "security_code": security_code("security_code")}).filter("__rank is not null and security_code is not null")
    return kept.orderBy("__rank", "security_code").drop("__rank")


QUOTED = ("trading_unit", "am_open", "am_high", "am_low", "am_close", "pm_open", "pm_high", "pm_low", "pm_close", "final_quote", "change", "vwap", "volume", "turnover")


def quotations(rows: DataFrame) -> DataFrame:
    """Day's prices from rows of 16 cells: code, trading unit, name, morning and afternoon open, high, low and close, final quote, change, average, volume and turnover.

    A row of another width, without a code or without a trading unit is none.
    """
    kept = [c for c in rows.columns if c != "cells"]
    # numbers are read once, into an array: spelled out for each cell, the code would be too long to be compiled
    numbers = F.transform(F.concat(F.slice("cells", 2, 1), F.slice("cells", 4, 13)), lambda c: found_number(c, quoted=True))
    # a text without a digit holds no number
    is_row = (F.size("cells") == 16) & F.get("cells", F.lit(1)).rlike("[0-9０-９]") & security_code(F.get("cells", F.lit(0))).isNotNull()
    read = rows.filter(is_row).select(*kept, security_code(F.get("cells", F.lit(0))).alias("security_code"), F.trim(F.translate(F.get("cells", F.lit(2)), "\n\r", " ")).alias("quoted_name"), numbers.alias("__n"))
    read = read.select(*kept, "security_code", "quoted_name", *(F.get("__n", F.lit(k)).alias(n) for k, n in enumerate(QUOTED)))
    prices = read.select(
        *kept, "security_code", "quoted_name", "trading_unit",
        F.coalesce("am_open", "pm_open").alias("open_price"), F.greatest("am_high", "pm_high").alias("high_price"), F.least("am_low", "pm_low").alias("low_price"), F.coalesce("pm_close", "am_close").alias("close_price"),
        "final_quote", "change", (F.coalesce("pm_close", "am_close") - F.col("change")).alias("previous_close"), "vwap", "volume", "turnover",
    )
    return prices.withColumn("change_percent", F.when(F.col("previous_close") != 0, F.col("change") / F.col("previous_close") * 100))


def bar_actions(bars: DataFrame) -> DataFrame:
    """Corporate actions in daily bars: those with a factor or a type; an unknown type is flagged."""
    found = bars.filter(~((F.col("adjustment_factor") == 1) & F.col("ex_right_type").isNull()))
    return found.select(security_code("code").alias("security_code"), "effective_date", "adjustment_factor", "ex_right_type", (F.col("ex_right_type").isNotNull() & ~F.col("ex_right_type").isin("1", "2", "3")).alias("is_quarantined"))


def carried(rows: DataFrame, column: str, by: Column | str, order: str) -> DataFrame:
    """Fills a label down the rows of a table."""
    down = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(down))


def rights_rows(rows: DataFrame, excluded_sections: tuple[str, ...] = ("外国", "出資証券")) -> DataFrame:
    """Corporate actions from table rows (source, page_no, row_no, section, cells): the section carries forward, the first date counts."""
    filled = carried(rows.withColumn("__at", F.struct("page_no", "row_no")), "section", "source", "__at").drop("__at")
    for word in excluded_sections:
        filled = filled.filter(~F.coalesce(F.col("section").contains(word), F.lit(False)))
    dates = F.filter(F.transform("cells", lambda c: day(c)), lambda d: d.isNotNull())
    codes = F.filter(F.transform("cells", lambda c: security_code(c)), lambda c: c.isNotNull() & c.rlike("^[0-9]"))
    told = F.struct(F.get(codes, F.lit(0)).alias("security_code"), F.get(dates, F.lit(0)).alias("effective_date"), action(F.concat_ws(" ", "cells")).alias("made"))
    whole = lambda t: F.when(t["made"]["kind"].isNotNull() & t["security_code"].isNotNull() & t["effective_date"].isNotNull(), t)
    # made rows, for a filter of columns would be pushed in front and have them worked out twice
    found = filled.select("source", "section", F.explode_outer(F.array(let(told, whole))).alias("told")).filter("told is not null")
    return found.select("source", "section", "told.security_code", "told.effective_date", F.col("told.made.factor").alias("adjustment_factor"), F.col("told.made.kind").alias("ex_right_type"), F.col("told.made.unreadable").alias("is_quarantined"))


ANNUAL_TYPES = ("120", "130", "160", "170")


def annual_filings(listing: DataFrame) -> DataFrame:
    """Annual filings of companies from a document list: by ordinance and type, without trusts; of repeated ids the last."""
    kept = listing.filter((F.col("ordinance_code") == "010") & F.col("type_code").isin(*ANNUAL_TYPES) & ~F.coalesce(F.col("filer_name").rlike("投資信託|受益証券|信託銀行"), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("list_no")))
    # shuffled before they are sorted: else a task that has sorted its listing would sort it by document as well, both in memory
    return kept.repartition("doc_id").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def with_codes(filings: DataFrame, code_map: DataFrame) -> DataFrame:
    """Security codes: the filing's own, else that of its filer."""
    mapped = code_map.select("filer_code", F.col("security_code").alias("__mapped"))
    return filings.join(mapped, "filer_code", "left").withColumn("security_code", F.coalesce(F.nullif(F.trim("security_code"), F.lit("")), "__mapped")).drop("__mapped")


def to_extract(filings: DataFrame, processed: DataFrame, forced: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Filings whose facts are still to be read, oldest first; a list of ids overrides the choice."""
    if forced is not None:
        return filings.join(forced.select("doc_id"), "doc_id", "left_semi").orderBy("submitted_at", "doc_id")
    annual = (F.col("type_code") == "120") | (F.col("title").contains("有価証券報告書") & ~F.col("title").contains("訂正"))
    open_ = filings.filter(annual & F.col("has_facts") & ~F.col("is_withdrawn")).join(processed.select("doc_id"), "doc_id", "left_anti")
    return open_.orderBy("submitted_at", "doc_id").limit(limit)


def typed(rows: DataFrame, casts: dict[str, str], required: tuple[str, ...], millions: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their columns cast, and those that cannot be: a required value missing or any value unreadable."""
    cast = {c: (number(c) if t in ("double", "long", "int") else day(c) if t == "date" else F.col(c)) for c, t in casts.items()}
    cast = {c: (v * 1_000_000 if c in millions else v).cast(casts[c]) for c, v in cast.items()}
    broken = reduce_or([F.col(c).isNotNull() & (F.trim(c) != "") & v.isNull() for c, v in cast.items()] + [F.col(c).isNull() | (F.trim(c) == "") for c in required])
    return rows.filter(~broken).withColumns(cast), rows.filter(broken)


def reduce_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def at_least(df: DataFrame, n: int) -> DataFrame:
    """The rows; fewer than n are an error at once."""
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df
