"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Lines of
navigation, notices, adverts and other marked surroundings are left out. A
line weighs its text, but text inside links only in an article or main
element. The weights are summed over a window that slides down the lines: text
surges where the sum rises over a threshold and dives where it falls to
nothing. All lines between a surge and its dive are kept, those of every surge.

Where lines so kept lie in article or main elements, the others go: of the
main element and the articles outside it whichever holds more text stays, and
of what stays its articles alone if they hold half of it. Of several articles
those stay that have the same parent as the one with most text, or a quarter
of its text.

Defined results: a null or empty page, or one without text, gives the empty
string; cut-off pages and unclosed tags are read as far as they go; equal
pages give equal texts; an empty table gives an empty result; nothing is cut
from long pages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 40

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg|iframe|title|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^"'<>])*)/?>""",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_AROUND = frozenset("nav footer aside form header menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# Classes, ids and roles that name what surrounds an article, alone or with what they belong to or consist of.
_MARKS = re.compile(
    r"(?:(?:site|page|main|global|local|top|bottom|left|right|primary|secondary|header|footer|cookie|gdpr|social|user|post|article|entry|related|sticky|mobile)[_-])*"
    r"(?:ads?|adverts?|advertisements?|advertising|banner|promo|promotion|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|complementary|footer|contentinfo|site-header|page-header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|trending|comments?|comment-?list|respond|replies|disqus|pagination|pager|widget|toolbar|skip-link|paywall)"
    r"(?:[_-](?:area|bar|banner|block|box|buttons?|container|form|inner|links?|list|menu|message|notice|overlay|popup|posts?|section|slot|stories|unit|widget|wrapper|wrap|[0-9]+))*",
    re.I,
)


def _named(attributes: str) -> bool:
    """Does a whole class, id, role or label name surroundings?"""
    for m in _NAMES.finditer(attributes):
        value = m[1].strip("\"'").split()
        if any(map(_MARKS.fullmatch, ["-".join(value)] if m[0][:4].lower() == "aria" else value)):
            return True
    return False


def _closings(tags: list[tuple[bool, str, str]]) -> list[int]:
    """Of each opening tag the position of the tag that closes it, or -1."""
    ends, open_at = [-1] * len(tags), {}
    for k, (closing, name, _) in enumerate(tags):
        if not closing:
            open_at.setdefault(name, []).append(k)
        elif open_at.get(name):
            ends[open_at[name].pop()] = k
    return ends


class Line(NamedTuple):
    text: str
    bare: int  # characters outside links
    weight: int
    main: int  # the outermost main element and article that the line is in, by their places in the page, or -1
    article: int


def _parents(ends: list[int], of: list[int]) -> dict[int, int]:
    """Of each of some opening tags, in order, the innermost closed element around it, or -1."""
    wanted, parents, open_ = set(of), {}, []
    for k, end in enumerate(ends):
        while open_ and ends[open_[-1]] <= k:
            open_.pop()
        if k in wanted:
            parents[k] = open_[-1] if open_ else -1
        if end > k:
            open_.append(k)
    return parents


def lines_of(html: str, by_name: bool = True) -> tuple[list[Line], dict[int, int]]:
    """The page's lines outside its marked surroundings, and the parents of its articles.

    An article, a main element and what encloses all of the page's are not dropped by their names.
    """
    found = list(_TOKEN.finditer(html))
    tags = [(m[2] == "/", m[3].lower(), m[4]) if m[3] else (True, "", "") for m in found]
    ends = _closings(tags)
    hidden = [not closing and bool(a) and bool(_HIDDEN.search(a)) for closing, _, a in tags]
    around = [not closing and ends[k] > k and name not in _VOID and name not in ("html", "body", "article", "main") and (name in _AROUND or (by_name and bool(a) and _named(a))) for k, (closing, name, a) in enumerate(tags)]
    marked = [k for k, (closing, name, _) in enumerate(tags) if name in ("article", "main") and not closing and not hidden[k]]
    free, furthest, at = [], -1, 0
    for k in marked:
        furthest = max([furthest, *(ends[x] for x in range(at, k) if around[x])])
        at = k
        if furthest < k:
            free.append(k)
    if not free:
        for k, x in enumerate(around):
            around[k] = x and bisect_right(marked, ends[k]) == bisect_right(marked, k)
    regions = free or marked
    opens, closes = set(regions), {ends[k] for k in regions if ends[k] >= 0}
    depth, first = Counter(), {"main": -1, "article": -1}
    lines: list[Line] = []
    parts: list[str] = []
    bare = weight = links = at = 0
    until = -1  # the closing tag of the surroundings that we are in

    def end_line() -> None:
        nonlocal bare, weight
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append(Line(text, bare, weight, first["main"], first["article"]))
        parts.clear()
        bare = weight = 0

    def add(text: str) -> None:
        nonlocal bare, weight
        parts.append(text)
        n = len(text.strip())
        bare += 0 if links else n
        weight += n if depth.total() or not links else 0

    for k, m in enumerate(found):
        if until < 0 and m.start() > at:
            add(unescape(html[at : m.start()]))
        at = m.end()
        closing, name, attributes = tags[k]
        if k in opens or k in closes:
            if until < 0:
                end_line()
            if k in opens:
                first[name] = first[name] if depth[name] else k
                depth[name] += 1
            else:
                depth[name] -= 1
                first[name] = first[name] if depth[name] else -1
        if until >= 0:
            if k >= until:
                until = -1
            continue
        if not name:
            continue
        if (hidden[k] and ends[k] > k and name not in _VOID and name not in ("html", "body")) or (around[k] and not (name == "header" and depth.total() and not _named(attributes))):
            end_line()
            until = ends[k]
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in _INLINE:
            links = 0
            end_line()
    if until < 0 and at < len(html):
        add(unescape(html[at:]))
    end_line()
    return lines, _parents(ends, [k for k in regions if tags[k][1] == "article"])


def surging(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between each surge and its dive."""
    weights = [x.weight for x in lines]
    n = len(lines)
    sums = [0] * n
    running = 0
    for i in range(n - 1, -1, -1):
        running += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = running
    least = min(surge, max(sums, default=0) // 4)
    kept: list[Line] = []
    done = i = 0
    while i < n:
        if sums[i] <= least:
            i += 1
            continue
        start = i
        while start < n and not weights[start]:
            start += 1
        while start > done and weights[start - 1]:
            start -= 1
        end = i
        while end < n and sums[end]:
            end += 1
        kept += lines[start:end]
        done = i = max(end, i + 1)
    return kept


def _size(lines: list[Line]) -> tuple[int, int]:
    return sum(x.bare for x in lines), sum(x.weight for x in lines)


def restricted(lines: list[Line], parents: dict[int, int]) -> list[Line]:
    """Of the kept lines those in the marked regions with most text; all if none is in one."""
    main, outside = [x for x in lines if x.main >= 0], [x for x in lines if x.main < 0 <= x.article]
    pool = main if main and _size(main) >= _size(outside) else outside
    if not pool:
        return lines
    inner = [x for x in pool if x.article >= 0]
    if not inner or 2 * _size(inner)[0] < _size(pool)[0]:
        return pool
    bare: Counter[int] = Counter()
    for x in inner:
        bare[x.article] += x.bare
    most = max(bare, key=lambda k: (bare[k], -k))
    return [x for x in inner if parents[x.article] == parents[most] or 4 * bare[x.article] >= bare[most]]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between each surge and its dive, as far as the marked regions have them, joined by spaces."""
    lines, parents = lines_of(html or "")
    if not any(x.weight for x in lines):  # names would leave the page without text
        lines, parents = lines_of(html or "", by_name=False)
    return " ".join(x.text for x in restricted(surging(lines, window, surge), parents))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's id, url, main text and its length in code points."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
