"""Steps that are to do their work once, in memory that doesn't grow with a file's text."""

import tracemalloc

from pyspark.sql import functions as F
from test_registry import QUERIES

from steadyield.operators import publish
from steadyield.sources import files


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_lines_of_rights_are_decoded_as_they_are_read():
    content = b'"Company ""1"", Ltd","1301","100","1:2","2","a, b"\r\n' * 200_000
    tracemalloc.start()
    n = sum(1 for _ in files._rights_of("f", content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < len(content) / 2


def test_lines_of_rights_may_hold_line_ends_and_wide_letters():
    content = '"会社\r\n一","1301","100","1：2","2",""\r\n\r\n"b","1302","100","1:3","2","x"\n'.encode("cp932")
    assert [(r[1], r[3], r[4], r[6]) for r in files._rights_of("f", content)] == [(1, "会社 一", "1301", "1:2"), (3, "b", "1302", "1:3")]


def test_files_of_a_date_have_a_bounded_number_of_lines(spark, sf, monkeypatch):
    from steadyield.plans import file_queries

    before = QUERIES["pending_right_files"](spark, sf)
    wanted = sorted(map(tuple, before.collect()))
    monkeypatch.setattr(file_queries, "LINES_A_FILE", 20)
    paths = []
    monkeypatch.setattr(file_queries.files, "rights_files", lambda s, folder, p, read=files.rights_files: paths.append(folder) or read(s, folder, p))
    assert sorted(map(tuple, QUERIES["pending_right_files"](spark, sf).collect())) == wanted
    n_lines = spark.read.text(paths[0]).groupBy(F.input_file_name()).count().agg(F.max("count"), F.count(F.lit(1))).first()
    n_dates = spark.read.text(paths[0]).select("on").distinct().count()
    assert n_lines[1] > 2 * n_dates and n_lines[0] < 60


def test_rows_of_published_months_are_worked_out_once(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = spark.sql("SELECT make_date(2024, CAST(1 + id % 5 AS INT), 1) AS coverage_month, id FROM range(100)").mapInArrow(count, "coverage_month date, id long")
    months = spark.sql("SELECT make_date(2024, CAST(1 + id AS INT), 1) AS coverage_month FROM range(6)")
    publish.publish_months(rows, months, str(tmp_path))
    stored, held = publish.current_months(spark, str(tmp_path), "coverage_month date, id long")
    assert worked.value == 100 and stored.count() == 100
    assert sorted(r.n_rows for r in held.collect()) == [0, 20, 20, 20, 20, 20]


def test_landed_files_are_read_once(spark, sf):
    assert plan(QUERIES["bar_answers"](spark, sf)).count("FileScan json") == 1
    landed = plan(QUERIES["landed_facts"](spark, sf))
    assert landed.count("MapInArrow") == 1 and "SortMergeJoin" not in landed


def test_a_right_is_read_once(spark, sf):
    assert plan(QUERIES["rights_table"](spark, sf), "optimizedPlan").count("regexp_extract(") == 2


def test_a_sentence_is_read_once(spark, sf):
    assert plan(QUERIES["policy_pages"](spark, sf), "optimizedPlan").count("regexp_replace(") == 2


def test_filings_are_sorted_by_document_once(spark, sf):
    for name in ("annual_filing_list", "filings_to_extract"):
        assert plan(QUERIES[name](spark, sf)).count("Sort [doc_id") == 1


def test_facts_are_dealt_by_filing_once_in_parts_by_their_number(spark, sf, monkeypatch):
    """Whatever the session's number of partitions; pairs of elements and labels are read from where they were written, so that facts stay where they are."""
    from steadyield.plans import data_queries

    wanted = sorted(map(str, QUERIES["filing_metrics"](spark, sf).collect()))
    monkeypatch.setattr(data_queries, "LINES_A_PART", 500)
    dealt = QUERIES["filing_metrics"](spark, sf)
    assert sorted(map(str, dealt.collect())) == wanted
    shown, n_lines = plan(dealt), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    # the final plan stands above the first one
    final = shown.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and f", {1 + n_lines // 500}), REPARTITION_BY_NUM" in final
    assert "SortMergeJoin" not in final and final.count("FileScan parquet") == 2
