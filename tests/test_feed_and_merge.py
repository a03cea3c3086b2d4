"""The disclosure feed, analyses of a batch, merges and checks."""

from datetime import date

import pytest

from steadyield.operators import merge, policy, quality
from steadyield.streaming import feed

DISCLOSURE = "disclosure_id long, security_code string, published_date date, title string"


def test_feed_appends_each_disclosure_once(spark, tmp_path):
    schema = spark.createDataFrame([], DISCLOSURE).schema
    land = lambda k, rows: spark.createDataFrame(rows, DISCLOSURE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    active = spark.createDataFrame([("1",)], "security_code string")
    run = lambda: feed.disclosure_feed(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/cp", active=active).awaitTermination()
    d = date(2024, 1, 1)
    land(1, [(1, "1", d, "増配のお知らせ"), (2, "9", d, "増配のお知らせ"), (3, "1", d, "人事")])
    run()
    land(2, [(1, "1", d, "増配のお知らせ"), (4, "1", d, "配当予想の修正"), (4, "1", d, "配当予想の修正")])
    run()
    run()
    got = sorted((r.disclosure_id, r.category) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "増配・復配"), (4, "配当予想")]


def test_a_store_by_day_reads_its_days_only(spark, tmp_path):
    schema = "k long, d date, v string"
    write = feed.append_batch(f"{tmp_path}/s", "k", "d")
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    for rows in ([(1, one, "a"), (1, one, "a"), (2, None, "b")], [(1, one, "a"), (3, two, "c"), (2, None, "b")], []):
        write(spark.createDataFrame(rows, schema), 0)
    got = spark.read.schema(schema).parquet(f"{tmp_path}/s")
    assert sorted((r.k, r.d) for r in got.collect()) == [(1, one), (2, None), (3, two)]
    assert "PartitionFilters: [isnotnull(d" in got.filter(got.d == one)._jdf.queryExecution().toString()


def test_analyses_of_a_batch(spark):
    targets = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "disclosure_id long, published_date date")
    none = spark.createDataFrame([], "disclosure_id long, status string, analyzer_version string, attempts long")
    pages = spark.createDataFrame([(1, 0, "累進配当を導入しています。")], "doc_id long, page_no int, text string")
    got = {r.disclosure_id: (r.status, r.classification) for r in feed.analyse(targets, none, pages, "v1").collect()}
    assert got == {1: ("completed", "confirmed"), 2: ("text_extraction_failed", None)}


def test_counts_of_a_run(spark):
    states = spark.createDataFrame([(s,) for s in ["new"] * 3 + ["retry", "version_changed", "done", "exhausted", "exhausted"]], "state string")
    assert tuple(policy.run_counts(states, 4).first()) == (4, 1, 1, 2)
    assert tuple(policy.run_counts(states, 9).first()) == (5, 0, 1, 2)
    assert tuple(policy.run_counts(states.limit(0)).first()) == (0, 0, 0, 0)


def test_months_are_replaced_even_if_empty(spark):
    s = "coverage_month string, security_code string"
    old = spark.createDataFrame([("2024-01", "1"), ("2024-02", "2")], s)
    months = spark.createDataFrame([("2024-01",), ("2024-02",)], "coverage_month string")
    got = merge.replace_months(old, spark.createDataFrame([("2024-02", "3")], s), months).collect()
    assert [tuple(r) for r in got] == [("2024-02", "3")]


def test_widening(spark):
    s = "security_code string, covered_from int, covered_to int, observed_from int, observed_to int, sync_status string"
    old = spark.createDataFrame([("1", 5, 9, 6, 8, "complete"), ("2", 5, 9, 6, 8, "complete")], s)
    new = spark.createDataFrame([("1", 3, 7, 4, 7, "complete"), ("2", 3, 12, 4, 11, "failed"), ("3", 1, 2, None, None, "partial")], s)
    got = {r.security_code: tuple(r)[1:] for r in merge.widen_status(old, new).collect()}
    assert got == {"1": (3, 9, 4, 8, "complete"), "2": (5, 9, 4, 11, "failed"), "3": (None, None, None, None, "partial")}


def test_swap_refuses_an_empty_table(spark, tmp_path):
    with pytest.raises(ValueError):
        merge.swap_if_filled(spark.range(0), str(tmp_path), "t")
    assert spark.read.parquet(merge.swap_if_filled(spark.range(3), str(tmp_path), "u")).count() == 3


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert [(r.k, r.versions) for r in quality.conflicts(rows, "k").collect()] == [(1, 2)]
    assert [tuple(r) for r in quality.collapse_duplicates(rows, "k").collect()] == [(2, "c")]
    with pytest.raises(Exception, match="repeated"):
        quality.assert_unique(rows, "k").collect()
    latest = spark.createDataFrame([("prices", date(2024, 1, 1)), ("filings", None), ("financials", date(2025, 1, 1))], "name string, latest_date date")
    assert {r.name: (r.age_days, r.verdict) for r in quality.freshness(latest, "2024-01-07").collect()} == {"prices": (6, "warning"), "filings": (None, "warning"), "financials": (0, "ok")}
    metrics = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 1), 0)], "latest_trading_date date, cache_trading_date date, open_analyses int")
    assert {r.name: r.verdict for r in quality.consistency(metrics).collect()} == {"cache": "warning", "analyses": "ok", "unsupported_actions": "ok"}


def test_master_of_one_source_leaves_the_others_active(spark):
    old = spark.createDataFrame([("1", "a", True), ("2", "a", True), ("3", "b", True), ("4", "b", False)], "security_code string, origin string, is_active boolean")
    listed = spark.createDataFrame([("1", "a"), ("9", "a")], "security_code string, origin string")
    got = {r.security_code: r.is_active for r in merge.upsert_master(old, listed, source="origin").collect()}
    assert got == {"1": True, "9": True, "2": False, "3": True, "4": False}


def test_filings_and_their_preview(spark):
    columns = "doc_id string, title string, submitted_at string"
    old = spark.createDataFrame([("a", "old", "1"), (" ", "none", "9"), (None, "none", "9")], columns)
    fetched = spark.createDataFrame([("a", "new", "5", 1), ("b", "x", "2", 1), ("b", "y", "3", 2), ("", "z", "9", 1)], columns + ", batch_no int")
    got = sorted(tuple(r) for r in merge.merge_filings(old, fetched).collect())
    assert got == [("a", "new", "5", False), ("b", "y", "3", True)]
    many = spark.createDataFrame([(f"d{k:02}", "t", str(k // 4)) for k in range(11)] + [("n", "t", None)], columns)
    shown = [(r.place, r.doc_id, r.n_more) for r in merge.preview(many).orderBy("place").collect()]
    assert [d for _, d, _ in shown] == ["d08", "d09", "d10", "d04", "d05", "d06", "d07", "d00", None] and shown[-1] == (9, None, 4)
    assert merge.preview(many.limit(8)).count() == 8 and merge.preview(many.limit(0)).count() == 0


def test_equal_numbers_of_a_batch_are_decided_by_the_other_columns(spark):
    old = spark.createDataFrame([(1, "old", None), (9, "old", None)], "k int, v string, w int")
    tied = [(1, "a", 7, 5), (1, "b", 1, 5), (1, "b", 2, 5), (1, "z", 9, 4), (2, None, 3, 5), (2, "c", None, 5)]
    for rows in (tied, tied[::-1]):
        batch = spark.createDataFrame(rows, "k int, v string, w int, batch_no int").coalesce(1)
        assert sorted(tuple(r) for r in merge.upsert(old, batch, "k").collect()) == [(1, "b", 2), (2, "c", None), (9, "old", None)]
        assert sorted(tuple(r) for r in merge.coalescing_upsert(old, batch, "k").collect()) == [(1, "b", 2), (2, "c", None), (9, "old", None)]


def test_unknown_codes_are_told(spark):
    from steadyield.operators import adjust

    actions = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "x"), ("3", "y"), ("1", None)], "security_code string, source string")
    kept, lost = adjust.known_actions(adjust.of_source(actions, "x"), spark.createDataFrame([("1",), ("1",)], "security_code string"))
    assert [r.security_code for r in kept.collect()] == ["1"] and [tuple(r) for r in lost.collect()] == [("2", 2)]


def test_health_of_empty_tables(spark):
    from steadyield.operators import quality

    of = lambda ddl: spark.createDataFrame([], ddl)
    row = quality.health_metrics(
        of("security_code string, is_active boolean"), of("trading_date date"), of("trading_date date"), of("fiscal_period_end date"), of("submitted_at timestamp"), of("status string"),
        of("security_code string, ex_right_type string, adjustment_factor double"),
    )
    got = row.first().asDict()
    assert got["latest_trading_date"] is None and got["price_rows"] == got["open_analyses"] == got["unsupported_actions"] == 0
    assert {r.name: r.verdict for r in quality.consistency(row).collect()} == {"cache": "warning", "analyses": "ok", "unsupported_actions": "ok"}
