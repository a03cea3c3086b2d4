"""The declared columns of the stored tables, and tables brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STAMPS = ", source_url string, fetched_at timestamp, created_at timestamp, updated_at timestamp"
_ANALYSIS = (
    "content_sha256 string, content_type string, content_length_bytes long, http_status_code int, page_count int, extracted_text_length int, status string, classification string, "
    "matched_phrase string, evidence string, evidence_page_number int, analyzer_version string, attempts int, analyzed_at timestamp, last_error string" + _STAMPS
)
_MONEY = ("revenue", "operating_profit", "ordinary_profit", "net_income", "total_assets", "net_assets", "equity", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "cash_and_equivalents", "current_assets", "investment_securities", "liabilities")
_SHARE = ("eps", "bps", "annual_dividend")
_COUNTS = ("issued_shares", "treasury_shares")

# Names and types of the stored columns. A time of day is text, as Spark has no plain type for it.
SCHEMAS: dict[str, str] = {
    "securities": "security_code string, company_name string, market string, market_category string, industry_33_code string, industry_33_name string, industry_17_code string, industry_17_name string, scale_code string, scale_name string, reference_date date, is_active boolean, source string, source_updated_at timestamp" + _STAMPS,
    "prices": "daily_price_id long, security_code string, trading_date date, trading_unit decimal(20,6), open_price decimal(20,6), high_price decimal(20,6), low_price decimal(20,6), close_price decimal(20,6), previous_close decimal(20,6), price_change decimal(20,6), change_rate_percent decimal(20,6), final_quote decimal(20,6), vwap decimal(20,6), volume decimal(28,6), turnover_thousand_yen decimal(28,6), adjustment_factor decimal(20,10), adjusted_close_price decimal(20,6), price_status string, source string, source_updated_at timestamp" + _STAMPS,
    "filings": "doc_id string, security_code string, filer_code string, filer_name string, type_code string, type_name string, submitted_at timestamp, period_start date, period_end date, accounting_standard string, is_consolidated boolean, processing_status string, processed_at timestamp, error_message string, source string" + _STAMPS,
    "financials": "annual_financial_id long, security_code string, doc_id string, fiscal_period_start date, fiscal_period_end date, accounting_standard string, is_consolidated boolean, "
    + ", ".join([f"{c}_jpy decimal(28,6)" for c in _MONEY] + [f"{c}_yen decimal(20,6)" for c in _SHARE] + [f"{c} long" for c in _COUNTS] + [f"{c}_element_id string" for c in _MONEY + _SHARE + _COUNTS])
    + ", extracted_item_count int, extraction_status string, extraction_error string, source string, source_file string, extracted_at timestamp" + _STAMPS,
    "actions": "corporate_action_id long, security_code string, effective_date date, adjustment_factor decimal(20,10), ex_right_type string, source string" + _STAMPS,
    "sync_status": "security_code string, requested_from date, requested_to date, covered_from date, covered_to date, observed_from date, observed_to date, sync_status string, api_record_count int, action_record_count int, last_error string" + _STAMPS,
    "sources": "source_file_id long, source_kind string, coverage_start date, coverage_end date, publication_date date, content_sha256 string, sync_status string, record_count int, last_error string" + _STAMPS,
    "snapshots": "coverage_month date, content_sha256 string, source_count int, record_count int" + _STAMPS,
    "watchlist": "coverage_month date, security_code string, allocation_date date, adjustment_factor decimal(20,10)" + _STAMPS,
    "results": "disclosure_id string, security_code string, published_date date, published_time string, company_name string, title string, url string, " + _ANALYSIS,
    "report_results": "doc_id string, security_code string, submitted_date date, fiscal_period_end date, company_name string, url string, " + _ANALYSIS,
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table under its declared columns; those that older files lack are null."""
    return spark.read.schema(schema(name)).parquet(f"{folder}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in their order and types: what a column lacks is null, what cannot be cast is an error, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
