"""Titles, pages, latest results and evidence."""

from datetime import date

import pytest

from steadyield.operators import policy


@pytest.mark.parametrize(
    ("title", "category", "candidate"),
    [
        ("中期経営計画の策定に関するお知らせ", "中期経営計画", True),
        ("中期経営計画および配当予想の修正", "配当予想", True),
        ("株主還元方針の変更に関するお知らせ", "配当・株主還元方針", True),
        ("剰余金の配当（増配）に関するお知らせ", "増配・復配", False),
        ("減配のお知らせ", "減配・無配", False),
        ("決算説明会資料", "決算説明会", True),
        ("剰余金の配当に関するお知らせ", "配当・株主還元", False),
        ("doe の導入", "配当・株主還元方針", True),
        ("人事異動のお知らせ", None, None),
    ],
)
def test_titles(spark, title, category, candidate):
    got = policy.classify_titles(spark.createDataFrame([(1, title)], "id int, title string")).collect()
    assert [(r.category, r.is_policy_candidate) for r in got] == ([(category, candidate)] if category else [])


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["当社は累進配当を導入しております。"], ("confirmed", 0, "累進配当を導入")),
        (["配当方針として累進配当を行います。"], ("confirmed", 0, "配当方針として累進配当")),
        (["原則として減配は行わない方針です。"], ("confirmed", 0, "原則として減配は行わない")),
        (["累進配当の導入を検討しております。"], ("manual_review", 0, "累進配当の導入")),
        (["累進配当を目指します。", "連続増配の実績があります。"], ("confirmed", 1, "連続増配")),
        (["売上が増えました。"], ("not_confirmed", None, None)),
        (["累 進 配 当\tを 継 続 します"], ("confirmed", 0, "累進配当を継続")),
        ([None], ("not_confirmed", None, None)),
    ],
)
def test_pages(spark, pages, want):
    rows = spark.createDataFrame([("d", k, p) for k, p in enumerate(pages)], "doc_id string, page_no int, text string")
    got = policy.classify_pages(rows).first()
    assert (got.classification, got.page_no, got.matched_phrase) == want


def test_evidence_is_cut_around_the_phrase(spark):
    from pyspark.sql import functions as F

    long = "あ" * 900 + "累進配当" + "い" * 900
    got = spark.createDataFrame([(long, "累進配当"), ("short", "x")], "s string, p string").select(policy.evidence_text(F.col("s"), F.col("p")).alias("e")).collect()
    assert len(got[0].e) == 500 and "累進配当" in got[0].e and got[0].e[0] == got[0].e[-1] == "…" and got[1].e == "short"


def test_states(spark):
    targets = spark.createDataFrame([(k, date(2024, 1, k)) for k in range(1, 7)], "disclosure_id long, published_date date")
    results = spark.createDataFrame([(2, "completed", "v1", 1), (3, "pending", "v2", 2), (4, "fetch_failed", "v2", 3), (5, "completed", "v2", 1), (6, "pending", "v1", 9)], "disclosure_id long, status string, analyzer_version string, attempts long")
    state = lambda **k: {r.disclosure_id: r.state for r in policy.analysis_state(targets, results, "v2", **k).collect()}
    assert state() == {1: "new", 2: "version_changed", 3: "retry", 4: "exhausted", 5: "done", 6: "version_changed"}
    assert state(retried=("fetch_failed",))[3] == "done"
    batch = policy.analysis_batch(policy.analysis_state(targets, results, "v2"), limit=2).collect()
    assert [r.disclosure_id for r in batch] == [6, 3]


def test_latest_orders(spark):
    filings = spark.createDataFrame([("1", date(2024, 3, 31), None, "a"), ("1", date(2024, 3, 31), date(2024, 6, 1), "b"), ("1", None, date(2025, 6, 1), "c")], "security_code string, fiscal_period_end date, submitted_at date, doc_id string")
    assert policy.latest_filings(filings).first().doc_id == "a"
    alerts = spark.createDataFrame([("1", date(2024, 1, 1), "10:00", 2, "x"), ("1", date(2024, 1, 1), "10:00", 1, "y")], "security_code string, published_date date, published_time string, row_no int, category string")
    assert policy.latest_alerts(alerts).first().category == "y"


def test_overwriting_by_kind(spark):
    own = spark.createDataFrame([("1", "a", "d1", "b", "r1"), ("2", "a", "d2", "b", "r2")], "security_code string, classification string, document_id string, report_classification string, report_doc_id string")
    proof = spark.createDataFrame([("1", "report", "new", "r9")], "security_code string, source string, classification string, document_id string")
    got = sorted(policy.overwrite_evidence(own, proof).collect())
    assert tuple(got[0]) == ("1", "a", "d1", "new", "r9") and tuple(got[1]) == ("2", "a", "d2", "b", "r2")
