"""Landed files of uneven form, and versions of tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from steadyield.functions import text
from steadyield.operators import policy, publish
from steadyield.sources import files

HEAD = "要素ID\t項目名\tコンテキストID\t相対年度\t連結・個別\t期間・時点\tユニットID\t単位\t値"
LINE = '"jppfs_cor:NetSales"\t"売上高"\t"CurrentYearDuration"\t"当期"\t"連結"\t"期間"\t"JPY"\t"円"\t"1,000"'


def facts_of(spark, folder, **contents):
    folder.mkdir()
    for name, content in contents.items():
        (folder / f"{name}.csv").write_bytes(content)
    good, bad = files.fact_files(spark, f"file://{folder}")
    return good.orderBy("doc_id", "row_no").collect(), sorted((r.source_file.rsplit("/", 1)[1], r.line, r.problem) for r in bad.collect())


def test_encodings_and_headers(spark, tmp_path):
    shuffled = "Value\tＥｌｅｍｅｎｔ ID\tcontext_id\tnote\tLabel\n7\tx:Assets\tc\tn\t総資産\n"
    partly = HEAD.replace("項目名", "?").replace("値", "") + "\n" + LINE + "\n"
    quoted = HEAD + '\nx:A\t"two\nlines ""q"""\tc\t\t\t\t\t\t"1\t2"\n\nx:B\n'
    got, bad = facts_of(
        spark, tmp_path / "f", S1_a=(HEAD + "\r\n" + LINE + "\r\n").encode("utf-16"), S1_b=partly.encode("utf-16-le"), S2=shuffled.encode(), S3=b"\xef\xbb\xbf" + quoted.encode(),
        S4=(HEAD + "\n" + LINE).encode("utf-16-be"), jpaud_S5=b"x", S6=b"", S7=HEAD.encode(), S8=b"\xff\xfe\x00\xd8\x00",
    )
    found = [(r.doc_id, r.element_id, r.label, r.context_id, r.value) for r in got]
    assert found == [
        ("S1", "jppfs_cor:NetSales", "売上高", "CurrentYearDuration", "1,000"), ("S1", "jppfs_cor:NetSales", "売上高", "CurrentYearDuration", "1,000"),
        ("S2", "x:Assets", "総資産", "c", "7"), ("S3", "x:A", 'two\nlines "q"', "c", "1\t2"), ("S3", "x:B", "", "", ""),
    ]
    assert got[0].row_no < got[1].row_no and got[0].source_file.endswith("S1_a.csv")
    assert [b[0] for b in bad] == ["S4.csv", "S7.csv", "S8.csv"]  # a file of no bytes isn't listed at all
    assert {b[2] for b in bad} == {"no rows", "no known encoding"}


def test_a_mark_of_big_endian_and_no_files(spark, tmp_path):
    got, bad = facts_of(spark, tmp_path / "f", S4=b"\xfe\xff" + (HEAD + "\n" + LINE).encode("utf-16-be"))
    assert [(r.doc_id, r.value) for r in got] == [("S4", "1,000")] and not bad
    got, bad = facts_of(spark, tmp_path / "g", jpaud_x=b"y")
    assert not got and not bad


def rights_of(spark, folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content.encode("cp932"))
    return files.rights_files(spark, f"file://{folder}").orderBy("security_code").collect()


def test_pending_rights(spark, tmp_path):
    got = rights_of(spark, tmp_path / "a", "r_20240930.csv", '佐藤食品工業（株）,2814,100,1:2,2,2分の1\r\n,,,,,\r\n"Co, ""Ltd""",１３０１０,100,1：3,"2,0","a\nb"\r\na,2814,1,1:2,x,x\n')
    assert [(r.coverage_month, r.allocation_date, r.security_code, float(r.adjustment_factor)) for r in got] == [(date(2024, 9, 1), date(2024, 9, 30), "1301", 0.3333333333), (date(2024, 9, 1), date(2024, 9, 30), "2814", 0.5)]
    for k, (name, content, problem) in enumerate((
        ("r_20240930.csv", "x,2814,1\n", "six columns"), ("r_20240930.csv", "a,28,1,1:2,x,x\n", "no security code"), ("r_20240930.csv", "a,2814,1,,x,x\n", "no ratio"), ("r_20240930.csv", "a,2814,1,1:2 x,x,x\n", "no ratio"),
        ("r_20240930.csv", "a,2814,1,1:2,x,x\na,2814,1,1:3,x,x\n", "two ratios"), ("r.csv", "a,2814,1,1:2,x,x\n", "no date"), ("r_20241399.csv", "a,2814,1,1:2,x,x\n", "date|parse"),
    )):
        with pytest.raises(Exception, match=problem):
            rights_of(spark, tmp_path / str(k), name, content)


PAGE = """<table><tr><td class=kjTime>9:00</td><td class=kjCode>72030</td><td class=kjName>x</td><td class=kjTitle><a href=no.pdf>増配</a></td></tr></table>
<table id="main-list-table"><tr><th>x</th></tr>
<tr><td class="oddnew-L kjTime">15:00</td><td class="kjCode">７２０３０</td><td class="kjName">トヨタ <b>自動車</b></td><td class="kjTitle"><a href="140120.PDF?v=1">ＤＯＥ　の <i>導入</i></a> PDF <a href="z.pdf">増配</a></td><td class="kjPlace">東</td></tr>
<tr><td class="kjTime">15:01<td class="kjCode">72030<td class="kjName">b<td class="kjTitle"><a href="/abs/2.pdf">減配のお知らせ</a>
<tr><td class="kjTime">15:02</td><td class="kjCode">99990</td><td class="kjName">c</td><td class="kjTitle"><a href="3.pdf">増配</a></td></tr>
<tr><td class="kjTime">15:03</td><td class="kjCode">72030</td><td class="kjName">d</td><td class="kjTitle">増配</td></tr>
<tr><td class="kjTime">15:04</td><td class="kjCode">72030</td><td class="kjName">e</td><td class="kjTitle"><a href="5.pdf">人事</a></td></tr></table>"""


def test_lists_of_disclosures(spark):
    active = spark.createDataFrame([("7203",), ("7203",)], "security_code string")
    pages = spark.createDataFrame([("https://a.example/inbs/I_list_001_20240105.html", PAGE), ("https://a.example/inbs/I_list_002_20240105.html", None)], "url string, html string")
    got = [tuple(r)[:10] for r in files.listed_disclosures(pages, active).orderBy("published_time").collect()]
    day = date(2024, 1, 5)
    assert got == [
        ("140120", day, "15:00", "7203", "トヨタ 自動車", "DOE の 導入", "配当・株主還元方針", True, ["DOE"], "https://a.example/inbs/140120.PDF?v=1"),
        ("2", day, "15:01", "7203", "b", "減配のお知らせ", "減配・無配", False, ["減配"], "https://a.example/abs/2.pdf"),
    ]
    with pytest.raises(Exception, match="no date"):
        files.listed_disclosures(pages.withColumn("url", F.lit("https://a.example/x.html")), active).collect()
    assert files.listed_disclosures(pages.limit(0), active).count() == 0


def test_wide_letters_in_titles_and_pages(spark):
    titles = spark.createDataFrame([("ＤＯＥ　採用",), ("増　配",), ("", ), (None,), ("ﾍﾟｰｼﾞ 配当",)], "title string")
    assert sorted((r.title, r.category) for r in policy.classify_titles(titles).collect()) == [("DOE 採用", "配当・株主還元方針"), ("ページ 配当", "配当・株主還元")]
    pages = spark.createDataFrame([("d", 1, "始め？ 累進配当を　基本方針とする！次"), ("e", 1, None)], "doc_id string, page_no int, text string")
    got = {r.doc_id: (r.classification, r.evidence) for r in policy.classify_pages(pages).collect()}
    assert got == {"d": ("confirmed", "累進配当を 基本方針とする!"), "e": ("not_confirmed", None)}
    assert [r[0] for r in titles.select(text.folded("title")).collect()] == ["DOE 採用", "増 配", "", None, "ページ 配当"]


def test_bar_answers(spark, tmp_path):
    lines = [
        '{"data": [{"Code": "13320", "Date": "2024-01-01"}, {"Code": "13320", "Date": "2024-01-02", "AdjFactor": 0.5, "ExRT": "1"}, {"Code": 1333, "Date": "2024-01-03", "AdjFactor": "2", "ExRT": 2}], "pagination_key": null}',
        '{"data": [7, {"Code": " ", "Date": "2024-01-01"}, {"Code": "1", "Date": "2024-01-01"}, {"Code": "1332", "Date": "x"}, {"Code": "1332", "Date": "2024-01-01", "AdjFactor": -1}, {"Code": "1332", "Date": "2024-01-01", "AdjFactor": null}, {"Code": "1332", "Date": "2024-01-01", "ExRT": "9"}]}',
        '{"data": {"Code": "1332"}}', '{"message": "limit"}', "[1]", "oops", '{"data": []}',
    ]
    (tmp_path / "b.json").write_text("\n".join(lines))
    actions, kept_back = files.bar_payloads(spark, f"file://{tmp_path}")
    assert sorted((r.code, r.effective_date, r.adjustment_factor, r.ex_right_type) for r in actions.collect()) == [("1332", date(2024, 1, 2), 0.5, "1"), ("1333", date(2024, 1, 3), 2.0, "2")]
    assert sorted(r.problem for r in kept_back.collect()) == ["no code"] * 2 + ["no date"] + ["no list of data"] * 4 + ["no positive factor"] * 2 + ["not an object", "unknown kind"]


def test_only_sound_versions_become_current(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/t", spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    with pytest.raises(ValueError, match="nothing"):
        publish.current(spark, folder)
    checks = {"v": F.col("v") > 0}
    publish.publish(rows, folder, checks, ("k",))
    for bad, problem in ((rows.withColumn("v", F.lit(None).cast("int")), "v: 2"), (rows.union(rows), "repeated")):
        with pytest.raises(publish.AuditError, match=problem):
            publish.publish(bad, folder, checks, ("k",))
        assert sorted(map(tuple, publish.current(spark, folder).collect())) == [(1, 5), (2, 6)]
    publish.publish(publish.current(spark, folder).filter("k = 2"), folder, checks, ("k",))
    assert publish.current(spark, folder).collect() == [(2, 6)]
    publish.publish(rows.limit(0), folder, checks, ("k",))
    assert publish.current(spark, folder).count() == 0
    assert publish.manifest(spark, folder).count() == 3


def test_months_are_replaced_whole(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/m", "coverage_month date, code string"
    one, two = date(2024, 1, 1), date(2024, 2, 1)
    rows = spark.createDataFrame([(one, "a"), (one, "b"), (two, "c")], schema)
    publish.publish_months(rows, rows, folder)
    publish.publish_months(rows.limit(0), spark.createDataFrame([(one,), (date(2024, 3, 1),)], "coverage_month date"), folder)
    stored, held = publish.current_months(spark, folder, schema)
    assert [tuple(r) for r in stored.select("coverage_month", "code").collect()] == [(two, "c")]
    assert sorted((r.coverage_month, r.n_rows) for r in held.collect()) == [(one, 0), (two, 1), (date(2024, 3, 1), 0)]
    with pytest.raises(publish.AuditError, match="not replaced"):
        publish.publish_months(rows, rows.filter("code = 'c'"), folder)
    with pytest.raises(publish.AuditError, match="code"):
        publish.publish_months(rows, rows, folder, {"code": F.col("code") == "c"})
    assert publish.current_months(spark, folder, schema)[0].count() == 1
