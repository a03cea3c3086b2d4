import hashlib
import random

import pytest

from steadyield.llm import warc

PAGES = "page_id long, url string, html string, archive string"


def archive(spark, tmp_path, data, **options):
    pages = spark.createDataFrame([(*r, "x") for r in data], PAGES)
    folder = f"file://{tmp_path}/a"
    index = warc.write_archives(warc.with_record_types(pages), folder, **options)
    return index, warc.read_archives(spark, folder).collect()


def test_round_trip(spark, sf, tmp_path):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    data += [(1000 + k, "http://copy.example/\r\nX: y", data[0][2]) for k in range(4)] + [(2000, None, "short"), (2001, None, "short"), (2002, "u", None)]
    index, got = archive(spark, tmp_path, data, archive_size=40_000)
    want = {p: (h or "").encode() for p, _, h in data}
    assert index.count() == len(data) == len(got) and index.select("archive").distinct().count() > 2
    for r in got:
        body = want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.record_type == ("revisit" if r.refers_to is not None else "response")
        assert r.payload == (body if r.record_type == "response" else b"")
    types = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert types[data[0][0]] == ("revisit", 1003) and types[1003] == ("response", None)
    assert types[2000] == types[2001] == types[2002] == ("response", None)


def test_archive_form(tmp_path):
    records = [warc.record(k, "http://a.example/", b"<p>text %d</p>" % k * 90, 1350, hashlib.sha1(b"%d" % k).hexdigest(), None) for k in range(50)]
    content = warc.archive_bytes(records)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [f["WARC-Record-ID"] for f, _ in warc.read_archive(content)] == [f"<urn:page:{k}>" for k in range(50)]
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\x00" * 20))


def test_strays_long_payloads_and_payloads_that_many_hold(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join(str(rng.random()) for _ in range(40_000))
    data = [(k, "u", long if k == 0 else "<p>" + "many pages " * 100) for k in range(200)]
    index, got = archive(spark, tmp_path, data, archive_size=100_000)
    assert len(got) == 200 and {r.refers_to for r in got if r.record_type == "revisit"} == {199}
    assert next(r for r in got if r.page_id == 0).payload == long.encode()
    name = index.first().archive
    (tmp_path / "a" / "part-000000-9999.warc.zst").write_bytes((tmp_path / "a" / name).read_bytes())
    assert warc.read_archives(spark, f"file://{tmp_path}/a").count() == 200


def test_repeated_rows_and_empty_table(spark, tmp_path):
    same = (7, "http://a.example/", "<p>" + "long text " * 200)
    _, got = archive(spark, tmp_path / "r", [same, same, (3, None, same[2]), (None, None, same[2])])
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("3", "revisit", 7), ("7", "response", None), ("7", "response", None), ("None", "revisit", 7)]
    pages = spark.createDataFrame([], PAGES)
    assert warc.write_archives(warc.with_record_types(pages), f"file://{tmp_path}/e").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_ids_of_other_types(spark, tmp_path, kind):
    texts = {"string": ["a b", "", ">\r\nX: é%", None], "date": ["2024-01-31", "2023-12-01", "2024-02-01", None]}.get(kind, ["5", "-7", "30", None])
    pages = spark.createDataFrame([(t, "u", "<p>" + "long text " * 200) for t in texts], "page_id string, url string, html string").selectExpr(f"cast(page_id as {kind}) as page_id", "url", "html")
    folder = f"file://{tmp_path}/t"
    index = warc.write_archives(warc.with_record_types(pages), folder)
    got = warc.read_archives(spark, folder, id_type=kind)
    assert index.schema["page_id"].dataType == got.schema["page_id"].dataType == pages.schema["page_id"].dataType
    ids = [r.page_id for r in pages.collect()]
    newest = max(x for x in ids if x is not None)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got.collect()) == sorted((str(x), "response", None) if x == newest else (str(x), "revisit", newest) for x in ids)
