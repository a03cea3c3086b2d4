"""From long filing facts to one wide row a filing: the best-scored fact of each metric.

Facts have doc_id, row_no, element_id, label, context_id, relative_year,
consolidated, unit, value and perhaps unit_id and source_file, all text. A
fact counts for a metric if its element or its label says so, if it is of the
filing's accounting standard and scope, and if its value can be read. Of those
the highest score wins, the first in the file among equals.

What an element and a label mean to each metric is worked out once for each
distinct pair of them, written to the shared folder and joined to the facts, so
that its size is known when the join is planned and facts needn't be shuffled by
pairs where these are few. The standard and the scope of a
filing stand in its facts as well, so the facts are read once more only: the
best of each metric is kept for every standard and scope, and a filing's own
chooses among these few.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyield.functions.text import compact, found_number
from steadyield.llm.lineage import cut


@dataclass(frozen=True)
class Metric:
    """elements and labels name it; required and excluded words widen and narrow the labels; kind is number or text; unit is none, per_share or shares."""

    name: str
    elements: tuple[str, ...]
    labels: tuple[str, ...]
    kind: str = "number"
    unit: str | None = None
    needs_unit: bool = False
    of_scope: bool = True
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    dash_is_zero: bool = False
    element_points: tuple[tuple[str, int], ...] = ()
    undivided_context: bool = False


# What some elements add to the score of every count of shares, whichever it is.
SHARE_POINTS = (("NumberOfIssuedSharesAsOfFiscalYearEndIssuedSharesTotalNumberOfSharesEtc", 150), ("TotalNumberOfIssuedSharesSummaryOfBusinessResults", 100), ("TotalNumberOfSharesHeldTreasurySharesEtc", 150), ("NumberOfSharesHeldInOwnNameTreasurySharesEtc", -150), ("NumberOfSharesHeldInOthersNamesTreasurySharesEtc", -150))

# The elements and labels that name each metric in filings, and what some elements add to the score.
METRICS = (
    Metric("accounting_standard", ("AccountingStandardsDEI",), ("会計基準、DEI", "会計基準"), kind="text", of_scope=False),
    Metric("period_start", ("CurrentFiscalYearStartDateDEI", "CurrentPeriodStartDateDEI"), ("当会計期間開始日、DEI", "当事業年度開始日、DEI", "当会計期間開始日", "当事業年度開始日"), kind="text", of_scope=False),
    Metric("period_end", ("CurrentFiscalYearEndDateDEI", "CurrentPeriodEndDateDEI"), ("当会計期間終了日、DEI", "当事業年度終了日、DEI", "当会計期間終了日", "当事業年度終了日"), kind="text", of_scope=False),
    Metric("revenue", ("NetSales", "Revenue", "RevenueIFRS", "NetSalesIFRS", "OperatingRevenue1", "OperatingRevenue2", "OperatingRevenue", "RevenueIFRSSummaryOfBusinessResults", "OperatingRevenueIFRS", "OperatingRevenueIFRSSummaryOfBusinessResults", "RevenuesUSGAAPSummaryOfBusinessResults"), ("売上高", "売上収益", "営業収益", "営業収入", "完成工事高", "売上収益（IFRS）", "営業収益（IFRS）")),
    Metric("operating_income", ("OperatingIncome", "OperatingIncomeLoss", "OperatingIncomeLossSummaryOfBusinessResults", "OperatingProfitLoss", "OperatingProfitLossIFRS", "OperatingProfitLossIFRSSummaryOfBusinessResults"), ("営業利益", "営業損失", "営業利益又は営業損失", "営業利益又は営業損失（△）", "営業利益（△損失）", "営業利益（△損失）（IFRS）", "営業利益（IFRS）", "営業損失（IFRS）")),
    Metric("ordinary_income", ("OrdinaryIncome", "OrdinaryIncomeLoss", "OrdinaryIncomeLossSummaryOfBusinessResults", "ProfitLossBeforeTaxUSGAAPSummaryOfBusinessResults"), ("経常利益", "経常損失", "経常利益又は経常損失", "経常利益又は経常損失（△）")),
    Metric(
        "net_income",
        ("ProfitLoss", "ProfitLossSummaryOfBusinessResults", "ProfitLossIFRS", "ProfitLossIFRSSummaryOfBusinessResults", "ProfitLossAttributableToOwnersOfParent", "ProfitLossAttributableToOwnersOfParentSummaryOfBusinessResults", "ProfitLossAttributableToOwnersOfParentIFRS", "ProfitLossAttributableToOwnersOfParentIFRSSummaryOfBusinessResults", "NetIncome", "NetIncomeLoss", "NetIncomeLossSummaryOfBusinessResults", "NetIncomeLossAttributableToOwnersOfParentUSGAAPSummaryOfBusinessResults"),
        ("当期純利益", "当期純損失", "当期純利益又は当期純損失", "当期純利益又は当期純損失（△）", "親会社株主に帰属する当期純利益", "親会社株主に帰属する当期純損失", "親会社株主に帰属する当期純利益又は親会社株主に帰属する当期純損失", "親会社株主に帰属する当期純利益又は親会社株主に帰属する当期純損失（△）", "親会社の所有者に帰属する当期利益", "親会社の所有者に帰属する当期損失", "親会社の所有者に帰属する当期利益（△損失）", "親会社の所有者に帰属する当期利益（IFRS）", "親会社の所有者に帰属する当期損失（IFRS）", "親会社の所有者に帰属する当期利益（△損失）（IFRS）"),
        required=("当期純利益", "当期純損失", "親会社株主に帰属する当期純利益", "親会社株主に帰属する当期純損失", "親会社の所有者に帰属する当期利益", "親会社の所有者に帰属する当期損失"),
        excluded=("1株当たり", "１株当たり", "潜在株式調整後", "希薄化後", "包括利益", "四半期", "中間期", "セグメント"),
        element_points=(("ProfitLossAttributableToOwnersOfParent", 500), ("ProfitLossAttributableToOwnersOfParentSummaryOfBusinessResults", 500), ("ProfitLossAttributableToOwnersOfParentIFRS", 500), ("ProfitLossAttributableToOwnersOfParentIFRSSummaryOfBusinessResults", 500), ("ProfitLoss", -100), ("ProfitLossSummaryOfBusinessResults", -100), ("ProfitLossIFRS", -100), ("ProfitLossIFRSSummaryOfBusinessResults", -100)),
        undivided_context=True,
    ),
    Metric("total_assets", ("Assets", "AssetsIFRS", "TotalAssetsSummaryOfBusinessResults", "TotalAssetsIFRSSummaryOfBusinessResults", "AssetsIFRSSummaryOfBusinessResults", "TotalAssetsIFRS", "TotalAssetsUSGAAPSummaryOfBusinessResults"), ("資産合計", "総資産額", "総資産", "資産合計（IFRS）", "総資産額（IFRS）")),
    Metric("net_assets", ("NetAssets", "NetAssetsSummaryOfBusinessResults", "EquityIFRS", "EquityIFRSSummaryOfBusinessResults", "TotalEquityIFRS", "TotalEquityIFRSSummaryOfBusinessResults", "EquityIncludingPortionAttributableToNonControllingInterestUSGAAPSummaryOfBusinessResults"), ("純資産合計", "純資産額", "純資産", "資本合計", "資本合計（IFRS）")),
    Metric("equity", ("Equity", "EquityIFRS", "ShareholdersEquity", "EquityAttributableToOwnersOfParentIFRS", "EquityAttributableToOwnersOfParentIFRSSummaryOfBusinessResults", "EquityAttributableToOwnersOfParentUSGAAPSummaryOfBusinessResults"), ("自己資本", "株主資本", "親会社の所有者に帰属する持分", "親会社の所有者に帰属する持分（IFRS）", "親会社所有者帰属持分")),
    Metric("operating_cf", ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivitiesIFRS", "CashFlowsFromUsedInOperatingActivitiesUSGAAPSummaryOfBusinessResults"), ("営業活動によるキャッシュ・フロー", "営業活動によるキャッシュ・フロー（IFRS）")),
    Metric("investing_cf", ("NetCashProvidedByUsedInInvestingActivities", "CashFlowsFromUsedInInvestingActivitiesIFRS", "CashFlowsFromUsedInInvestingActivitiesUSGAAPSummaryOfBusinessResults"), ("投資活動によるキャッシュ・フロー", "投資活動によるキャッシュ・フロー（IFRS）")),
    Metric("financing_cf", ("NetCashProvidedByUsedInFinancingActivities", "CashFlowsFromUsedInFinancingActivitiesIFRS", "CashFlowsFromUsedInFinancingActivitiesUSGAAPSummaryOfBusinessResults"), ("財務活動によるキャッシュ・フロー", "財務活動によるキャッシュ・フロー（IFRS）")),
    Metric("cash", ("CashAndCashEquivalents", "CashAndCashEquivalentsIFRS", "CashAndCashEquivalentsUSGAAPSummaryOfBusinessResults"), ("現金及び現金同等物の期末残高", "現金及び現金同等物")),
    Metric(
        "eps",
        ("BasicEarningsLossPerShare", "BasicEarningsPerShare", "BasicEarningsLossPerShareIFRS", "BasicEarningsPerShareIFRS", "BasicEarningsLossPerShareSummaryOfBusinessResults", "BasicEarningsPerShareSummaryOfBusinessResults", "BasicEarningsLossPerShareIFRSSummaryOfBusinessResults", "BasicEarningsPerShareIFRSSummaryOfBusinessResults", "BasicEarningsLossPerShareUSGAAPSummaryOfBusinessResults"),
        ("1株当たり当期純利益", "１株当たり当期純利益", "1株当たり当期純損失", "１株当たり当期純損失", "1株当たり当期純利益又は1株当たり当期純損失", "１株当たり当期純利益又は１株当たり当期純損失", "1株当たり当期純利益又は1株当たり当期純損失（△）", "１株当たり当期純利益又は１株当たり当期純損失（△）", "基本的1株当たり当期利益", "基本的１株当たり当期利益", "基本的1株当たり当期利益（△損失）", "基本的１株当たり当期利益（△損失）", "基本的1株当たり当期利益（IFRS）", "基本的１株当たり当期利益（IFRS）", "基本的1株当たり当期利益（△損失）（IFRS）", "基本的１株当たり当期利益（△損失）（IFRS）"),
        unit="per_share",
        required=("1株当たり当期純利益", "１株当たり当期純利益", "1株当たり当期純損失", "１株当たり当期純損失", "基本的1株当たり当期利益", "基本的１株当たり当期利益"),
        excluded=("潜在株式調整後", "希薄化後", "四半期", "中間期"),
    ),
    Metric("bps", ("NetAssetsPerShare", "NetAssetsPerShareSummaryOfBusinessResults", "EquityAttributableToOwnersOfParentPerShareIFRS", "EquityAttributableToOwnersOfParentPerShareIFRSSummaryOfBusinessResults", "EquityPerShareAttributableToOwnersOfParentIFRS", "EquityPerShareAttributableToOwnersOfParentIFRSSummaryOfBusinessResults", "EquityAttributableToOwnersOfParentPerShareUSGAAPSummaryOfBusinessResults"), ("1株当たり純資産額", "１株当たり純資産額", "1株当たり親会社所有者帰属持分", "１株当たり親会社所有者帰属持分", "1株当たり親会社所有者帰属持分（IFRS）", "１株当たり親会社所有者帰属持分（IFRS）"), unit="per_share"),
    Metric("dividend_per_share", ("DividendPaidPerShareSummaryOfBusinessResults", "AnnualDividendPerShare", "DividendsPerShare"), ("1株当たり配当額", "１株当たり配当額", "年間配当金", "年間配当額"), unit="per_share", of_scope=False, dash_is_zero=True),
    Metric(
        "shares_issued",
        ("NumberOfIssuedSharesAsOfFiscalYearEndIssuedSharesTotalNumberOfSharesEtc", "TotalNumberOfIssuedSharesSummaryOfBusinessResults", "TotalNumberOfIssuedShares", "NumberOfIssuedShares"),
        ("発行済株式総数", "期末発行済株式数", "事業年度末現在発行数", "発行済株式数"),
        unit="shares", of_scope=False,
        required=("発行済株式総数", "期末発行済株式数", "事業年度末現在発行数"),
        excluded=("提出日現在", "潜在株式", "自己株式", "新株予約権"),
        element_points=SHARE_POINTS,
    ),
    Metric("current_assets", ("CurrentAssets", "CurrentAssetsIFRS"), ("流動資産", "流動資産合計", "流動資産計"), excluded=("純流動資産",)),
    Metric("investment_securities", ("InvestmentSecurities", "InvestmentSecuritiesIFRS"), ("投資有価証券",), excluded=("売買目的", "純資産")),
    Metric("liabilities", ("Liabilities", "LiabilitiesIFRS"), ("負債合計", "負債の合計")),
    Metric(
        "treasury_shares",
        ("TotalNumberOfSharesHeldTreasurySharesEtc", "NumberOfSharesHeldInOwnNameTreasurySharesEtc", "NumberOfSharesHeldInOthersNamesTreasurySharesEtc", "NumberOfTreasuryStockAsOfFiscalYearEnd", "NumberOfTreasuryStockAtTheEndOfFiscalYear", "TreasuryStockNumberOfSharesAtTheEndOfFiscalYear"),
        ("所有株式数の合計（株）、自己株式等", "自己株式", "自己株式数"),
        unit="shares", needs_unit=True, of_scope=False,
        excluded=("潜在株式", "新株予約権", "提出日現在", "平均", "議決権"),
        element_points=SHARE_POINTS,
    ),
)

# Words of years, contexts, units and labels, and what each circumstance adds to a fact's score.
CURRENT_YEAR = ("当期", "当年", "当連結会計年度", "当事業年度", "提出者")
PAST_YEAR = ("前期", "前連結会計年度", "前事業年度", "過年度")
DASHES = ("-", "－", "―", "—", "–")
OTHER_SHARES = ("PreferredStockMember", "ClassA", "ClassB", "StockAcquisitionRights")
PER_SHARE_UNITS = ("jpyper", "jpypershare", "jpypershares", "jpy_per_share", "jpy_per_shares", "円/株", "円・銭", "円銭")
SHARE_UNITS = ("shares", "share", "株")
LABEL_ENDINGS = ("、経営指標等", "、主要な経営指標等の推移", "、連結経営指標等", "、提出会社の経営指標等")
CONSOLIDATED = Metric("is_consolidated", ("WhetherConsolidatedFinancialStatementsArePreparedDEI",), ("連結決算の有無、DEI", "連結決算の有無"), kind="flag", of_scope=False)
STANDARD = Metric("standard", ("AccountingStandardsDEI",), ("会計基準、DEI", "会計基準"), kind="standard", of_scope=False)
YES, NO = ("true", "1", "yes", "有", "あり"), ("false", "0", "no", "無", "なし")
MOST_PER_SHARE = 10_000_000


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def points(*scored: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(condition, n).otherwise(0) for condition, n in scored])


def cell(c: str) -> Column:
    """A cell's text without marks of byte order and white space around it; none is blank."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\v\f\u3000\ufeff"))


def plain_label(text: Column) -> Column:
    """A label for comparison: without blanks, with narrow digits, brackets and slashes."""
    return F.translate(text, "０１２３４５６７８９（）／ \t\u3000", "0123456789()/")


def standard_of(value: Column) -> Column:
    """The accounting standard that a text names."""
    text = F.lower(plain_label(value))
    return F.when(any_of(text, ("ifrs", "国際財務報告基準", "国際会計基準")), "IFRS").when(any_of(text, ("japanesegaap", "japangaap", "日本基準", "企業会計基準")), "Japan GAAP").when(any_of(text, ("usgaap", "米国基準")), "US GAAP").when(text != "", value)


def scope_of(element: Column, label: Column, source: Column) -> Column:
    """The standard that a fact belongs to, or neutral; a business summary that names none is of Japan's."""
    low, space = F.lower(element), F.when(element.contains(":"), F.lower(F.split_part(element, F.lit(":"), F.lit(1)))).otherwise("")
    marked = F.upper(compact(F.concat(element, label)))
    return F.when(marked.contains("USGAAP"), "US GAAP").when(low.contains("ifrs") | space.contains("jpigp") | source.contains("jpigp"), "IFRS").when(space.contains("jppfs") | source.contains("jppfs") | low.contains("summaryofbusinessresults"), "Japan GAAP").otherwise("neutral")


def definitions(metrics: tuple[Metric, ...]) -> Column:
    """The metrics as an array of structs."""
    words = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    plain = lambda ws: tuple(w.translate(str.maketrans("０１２３４５６７８９（）／", "0123456789()/")) for w in ws)
    return F.array(*(
        F.struct(
            F.lit(m.name).alias("metric"), F.lit(m.kind).alias("kind"), F.lit(m.unit or "").alias("unit_kind"), F.lit(m.needs_unit).alias("needs_unit"), F.lit(m.of_scope).alias("of_scope"), F.lit(m.dash_is_zero).alias("dash_is_zero"), F.lit(m.undivided_context).alias("undivided"),
            words(m.elements).alias("elements"), words(m.labels).alias("labels"), words(plain(m.labels)).alias("plain_labels"), words(plain(m.required)).alias("required"), words(plain(m.excluded)).alias("excluded"),
            words(plain(tuple(a + b for a in m.labels for b in LABEL_ENDINGS)) if not m.required else ()).alias("ended_labels"),
            F.create_map(*(F.lit(x) for pair in (*m.element_points, ("", 0)) for x in pair)).alias("element_points"),
        )
        for m in metrics
    ))


def meanings(facts: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """What each distinct pair of element and label offers to which metrics: (suffix, label, offers)."""
    label, plain = F.col("label"), F.col("plain")

    def offer(m: Column) -> Column:
        among = lambda words, text: F.exists(words, lambda w: text.contains(w))
        exact, exact_label = F.array_contains(m.elements, F.col("suffix")), F.array_contains(m.labels, label)
        named = exact | F.array_contains(m.plain_labels, plain) | (~among(m.excluded, plain) & (among(m.required, plain) | F.array_contains(m.ended_labels, plain)))
        score = points((exact, 200 + 500), (exact_label, 140), (~exact_label & among(m.labels, label), 80)) + F.coalesce(F.element_at(m.element_points, F.col("suffix")), F.lit(0))
        return F.when(named, F.struct(*(m[c].alias(c) for c in ("metric", "kind", "unit_kind", "needs_unit", "of_scope", "dash_is_zero", "undivided")), score.alias("name_score")))

    pairs = facts.select("suffix", "label").distinct()
    # no filter of pairs without offers: it would be moved in front of the distinct, to every fact
    return pairs.withColumn("plain", plain_label(label)).select("suffix", "label", F.array_compact(F.transform(definitions(metrics), offer)).alias("offers"))


def cleaned(facts: DataFrame) -> DataFrame:
    """Facts with clean cells, the name of their file, their place and the last part of their element."""
    texts = {c: cell(c) for c in ("element_id", "label", "context_id", "relative_year", "consolidated", "unit", "value")}
    file = F.lower(F.element_at(F.split("source_file", "/"), -1)) if "source_file" in facts.columns else F.lit("")
    read = facts.withColumns(texts | {"unit_id": cell("unit_id") if "unit_id" in facts.columns else F.lit(""), "file": file, "at": F.col("row_no").cast("long")})
    return read.withColumn("suffix", F.element_at(F.split("element_id", ":"), -1))


def offered(facts: DataFrame, metrics: tuple[Metric, ...], listed: DataFrame | None = None) -> DataFrame:
    """Every fact with each metric that it may be the value of, its score, scope and side; a fact of no metric once, with its filing alone."""
    pairs = cut(meanings(cleaned(facts if listed is None else listed), metrics), "fact-meanings")
    known = cleaned(facts).join(pairs, ["suffix", "label"], "left")
    # worked out within a lambda, for matching facts alone; spelled out as columns the code would be too long to be compiled
    return known.select("doc_id", F.explode_outer(F.array_compact(F.transform("offers", _worth))).alias("o")).select("doc_id", "o.*")


def _worth(m: Column) -> Column:
    """What a fact with these columns is worth to a metric: its value, score, standard and side; without a metric if it can't be used."""
    element, context, year, side_text, suffix, value = (F.col(c) for c in ("element_id", "context_id", "relative_year", "consolidated", "suffix", "value"))
    unit, small = F.lower(plain_label(F.concat_ws(" ", "unit_id", "unit"))), F.lower(suffix)
    is_shares, is_per_share, scoped = m.unit_kind == "shares", m.unit_kind == "per_share", m.of_scope
    unit_fits = F.when(is_per_share, small.contains("pershare") | any_of(unit, PER_SHARE_UNITS)).when(is_shares, small.contains("numberofissuedshares") | any_of(unit, SHARE_UNITS)).otherwise(True)
    undivided = F.when(m.undivided, F.when(context == "CurrentYearDuration", 100).when(context.startswith("CurrentYearDuration_"), -200).otherwise(0)).otherwise(0)
    score = m.name_score + undivided + points(
        (any_of(year, CURRENT_YEAR), 60), (any_of(year, PAST_YEAR), -200),
        (context.contains("CurrentYear"), 50), (context.contains("Current"), 15), (context.contains("Prior") | context.contains("Previous"), -200), (context.contains("Segment"), -80),
        (context.contains("CurrentYearDuration"), 80), (context.contains("CurrentYearInstant"), 80), (suffix.contains("SummaryOfBusinessResults"), 70), (context.contains("Quarter"), -300), (context.contains("Interim"), -300),
        (unit_fits, 20), (is_shares & context.contains("CommonStockMember"), 200), (is_shares & any_of(context, OTHER_SHARES), -400),
        (scoped & (side_text == "連結"), 45), (scoped & (side_text == "個別"), -20), (scoped & context.contains("ConsolidatedMember"), 20), (scoped & context.contains("NonConsolidatedMember"), -15), (~scoped & (side_text == "個別"), 15),
    )
    # a filing's traits have scores of their own
    score = F.when(m.kind == "flag", 0).when(m.kind == "standard", points((suffix == STANDARD.elements[0], 200), (context.contains("FilingDateInstant"), 50))).otherwise(score)
    amount = F.when(m.kind == "number", F.coalesce(found_number(value), F.when(m.dash_is_zero & value.isin(*DASHES), 0.0)))
    flag = F.lower(value)
    text = F.when(m.kind == "text", F.nullif(value, F.lit(""))).when(m.kind == "standard", standard_of(value)).when(m.kind == "flag", F.when(flag.isin(*YES), "true").when(flag.isin(*NO), "false"))
    side = F.when(context.contains("NonConsolidatedMember") | plain_label(side_text).isin("個別", "非連結"), "alone").when(context.contains("ConsolidatedMember") | (plain_label(side_text) == "連結"), "group").otherwise("")
    made = F.struct(m.metric.alias("metric"), m.of_scope.alias("of_scope"), F.when(m.kind.isin("number", "text"), scope_of(element, F.col("label"), F.col("file"))).alias("scope"), F.when(scoped, side).alias("side"), score.alias("score"), amount.alias("amount"), text.alias("text"), element.alias("element_id"), F.col("at").alias("at"))
    sane = F.when(m.kind != "number", True).when(is_per_share, F.abs(made["amount"]) <= MOST_PER_SHARE).when(is_shares, made["amount"] >= 0).otherwise(True)
    counts = F.coalesce((made["amount"].isNotNull() | made["text"].isNotNull()) & sane & (~m.needs_unit | unit_fits), F.lit(False))
    return F.when(counts, made)


def extract_metrics(facts: DataFrame, metrics: tuple[Metric, ...] = METRICS, listed: DataFrame | None = None) -> DataFrame:
    """One row for each filing: every metric, the element it came from, how many were found, and the filing's standard and whether it is consolidated.

    listed: the same facts, where these cost less to read for their elements and
    labels alone. Facts dealt by filing already are not shuffled again.
    """
    offers = offered(facts, (*metrics, STANDARD, CONSOLIDATED), listed)
    best = lambda value: F.max_by(value, F.struct("score", -F.col("at")))
    # few rows a filing: metrics by scope and side
    few = offers.groupBy("doc_id", "metric", "scope", "side", "of_scope").agg(*(best(c).alias(c) for c in ("amount", "text", "element_id", "score", "at")))
    of_filing = Window.partitionBy("doc_id")
    trait = lambda m: F.max(F.when(F.col("metric") == m.name, F.col("text"))).over(of_filing)
    few = few.withColumns({"standard": trait(STANDARD), "is_consolidated": trait(CONSOLIDATED) == "true"})
    standard, scope = F.col("standard"), F.col("scope")
    fits = standard.isNull() | (scope == "neutral") | (standard.isin("IFRS", "Japan GAAP", "US GAAP") & (scope == standard))
    fits &= F.coalesce(F.when(F.col("is_consolidated"), F.col("side") != "alone").otherwise(F.col("side") != "group"), F.lit(True)) | F.col("is_consolidated").isNull()
    # scores of the filing's own standard are higher, whether or not the metric depends on it
    own = few.filter(F.col("metric").isNull() | ~F.col("of_scope") | fits).withColumn("score", F.col("score") + F.when(standard.isin("IFRS", "Japan GAAP") & (scope == standard), 250).otherwise(0))
    final = own.groupBy("doc_id", "metric").agg(F.max("standard").alias("standard"), F.max("is_consolidated").alias("is_consolidated"), *(best(c).alias(c) for c in ("amount", "text", "element_id")))
    of = lambda m, c: F.max(F.when(F.col("metric") == m.name, F.col(c)))
    values = [of(m, "amount" if m.kind == "number" else "text").alias(m.name) for m in metrics]
    return final.groupBy("doc_id").agg(*values, *(of(m, "element_id").alias(f"{m.name}_element") for m in metrics), F.max("standard").alias("standard"), F.max("is_consolidated").alias("is_consolidated"), F.count_if(F.col("metric").isin(*(m.name for m in metrics))).alias("n_found"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Checked corrections by document; one whose security or period differs from the row's is an error."""
    o = overrides.select("doc_id", F.struct("security_code", "fiscal_period_end", *columns).alias("__o"))
    joined = rows.join(o, "doc_id", "left")
    wrong = F.col("__o").isNotNull() & ~(F.col("security_code").eqNullSafe(F.col("__o.security_code")) & F.col("fiscal_period_end").eqNullSafe(F.col("__o.fiscal_period_end")))
    fixed = {c: F.when(wrong, F.raise_error(F.lit("an override does not fit its document")).cast(dict(rows.dtypes)[c])).otherwise(F.coalesce(F.col(f"__o.{c}"), F.col(c))) for c in columns}
    return joined.withColumns(fixed).drop("__o")
