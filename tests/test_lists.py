"""Pages of daily lists: plain ones are cut by one pattern, with the rows that the parser finds."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from steadyield.sources import files

URL = "https://lists.example/inbs/I_list_001_20240101.html"
ROW = '<tr><td class="x kjTime">9:30</td><td class="x kjCode">１３０１0</td><td class="x kjName">A &amp; B&nbsp;Co &lt</td><td class="x kjTitle"><a href="{}">Notice <b> of </b>DOE</a> PDF</td><td class="x kjPlace">東</td></tr>'


def parsed(url, html):
    """By the parser alone."""
    page = files._ListRows()
    page.feed(html or "")
    page.close()
    page.close_row()
    return [(url, k, *(files.folded(row.get(c)) for c in files.LIST_CELLS.values()), urljoin(url or "", row["href"].strip())) for k, row in enumerate(page.found)]


def test_a_plain_page_needs_no_parser(monkeypatch):
    html = '<table><tr><td class="kjTime">menu</table><table id="main-list-table">' + "\n".join(ROW.format(h) for h in ("1.pdf", "2.PDF?x=1", "/a/b.pdf")) + "</table>"
    wanted = parsed(URL, html)
    monkeypatch.setattr(HTMLParser, "feed", lambda *_: pytest.fail("parsed"))
    assert list(files._listed(URL, html)) == wanted and len(wanted) == 3
    assert wanted[0][2:] == ("9:30", "13010", "A & B Co <", "Notice of DOE", "東", "https://lists.example/inbs/1.pdf")


@pytest.mark.parametrize("odd", ["<!-- <tr> -->", "<script>'<tr>'</script>", "<td class=kjTime>", "<TD CLASS='kjCode'>", "a < b", "<br/>", "<", "<td", '<a href="x>', "<title><td></title>", '<td class="a&amp;b">', "</td x>", "<td\nclass=\"kjTime\">", "<!DOCTYPE html>", "<plaintext>", "<td  class=\"kjTime\">"])
def test_odd_pages_are_parsed(odd):
    html = f'{odd}<table id="main-list-table">{ROW.format("1.pdf")}{odd}{ROW.format("2.pdf")}</table>{odd}'
    assert list(files._listed(URL, html)) == parsed(URL, html)


def test_rows_are_those_of_the_parser():
    rng, plain = random.Random(3), 0
    hrefs = ("1.pdf", "2.PDF?x=1", "a?", "?b=1", "#c", "../d.pdf", "./e.pdf", "//h/f.pdf", "http://g/h.pdf", "i;j=1", "mailto:k", "", " l.pdf ", "m..n", "o?p=1?q", ".", "..", "/r.pdf", "s t.pdf", "1:2")
    bits = ["<table>", '<table id="main-list-table">', "</table>", "<tr>", "</tr>", "</td>", "</a>", "<b>", "</b>", "<br>", "text", " ", "&amp;", "&lt;td&gt;", "&eacute", "&#x3042;", "＆", ">", '"', "\n", "<td>", '<td id="a" class="">', "<div >", "<p>", "</p >", *(f'<td class="y {c}">' for c in files.LIST_CELLS), *(f'<a href="{h}">' for h in hrefs), *(ROW.format(h) for h in hrefs)]
    for _ in range(3000):
        html = '<table id="main-list-table">' + "".join(rng.choices(bits, k=rng.randrange(30))) + rng.choice(["", "", "&am", "<"])
        url = rng.choice([URL, "https://h", "https://h/a/b?c=1#d", "x/y", "", None, "mailto:z"])
        plain += files._plain_rows(html) is not None
        assert list(files._listed(url, html)) == parsed(url, html)
    assert plain > 1500
    assert list(files._listed(None, None)) == []


def test_titles_are_folded_once(spark, sf):
    """In the reader; folding them again would change nothing and send each title through Python twice more."""
    from test_registry import QUERIES

    shown = QUERIES["daily_disclosures"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in shown and shown.count("MapInArrow") == 1
    for text in ("Ｎｏｔｉｃｅ　ｏｆ ＤＯＥ ", "㌔ ﾊﾟ゙ é\x1f́", "ﷺ ①", "ẛ̣ ̇"):
        assert files.folded(files.folded(text)) == files.folded(text)
