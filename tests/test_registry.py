"""Every registered query agrees with its SQL on the smallest tables; those without SQL are tested elsewhere."""

import datetime
import decimal
import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from steadyield.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.fixture(scope="session")
def tables(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    wanted = tables.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, wanted.fetchall())


def test_only_links_lack_sql():
    assert set(QUERIES) - set(SQL) == {"page_links"} and set(SQL) <= set(QUERIES)


def test_links_of_all_pages(spark, sf):
    """Against a plain pattern over the whole table."""
    import re
    from urllib.parse import urljoin

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    wanted = []
    for page_id, url, html in pages:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", html or "")
        found = re.findall(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>""", bare)
        wanted += [(page_id, k, urljoin(url or "", "".join(h))) for k, h in enumerate(found)]
    got = [(r.page_id, r.link_no, r.link_url) for r in QUERIES["page_links"](spark, sf).collect()]
    assert len(got) > 100 and sorted(got) == sorted(wanted)


def test_entry_without_the_llm_subpackage(monkeypatch, spark):
    for name in [m for m in sys.modules if m.startswith("steadyield.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "steadyield.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")
