import random

from steadyield.llm.html_text import extract_text, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<div class="menu"><a href=x>Home</a> <a href=y>About us</a></div><div id="cookie-notice">We use cookies to make this page better for all.</div>
%s
<aside><p>Other stories that you may like to read today.</p></aside><form><p>Sign up here</p><input name=a></form>
<section class="comments"><p>What a fine article this is, thank you very much for it!</p></section><footer>&copy; 2024 Site</footer><script>var a = "<p>no</p>";</script></body></html>"""
BODY = """<h2>A title &amp; more</h2><p>First   paragraph with <a href=z>a link</a>,
 broken lines and <b>bold</b> words.</p><div class="ad">Buy now!</div><p>Second paragraph, longer than the first one and with more to say.<br>New line&hellip;</p>"""
WANT = "A title & more First paragraph with a link, broken lines and bold words. Second paragraph, longer than the first one and with more to say. New line…"


def test_article_and_plain_page():
    assert main_text(PAGE % f"<article>{BODY}</article>") == WANT
    assert main_text(PAGE % f"<div id=content>{BODY}</div>") == WANT


def test_cut_off_pages():
    assert main_text("<article><p>Never closed text &am") == "Never closed text &am"
    assert main_text("<article><p>One<p>Two<script>x") == "One Two"
    assert main_text("<!-- open <p>text") == ""


def test_table(spark, sf):
    pages = spark.createDataFrame([(1, "u", None, "a"), (2, None, "", "b"), (3, "v", "<p>Some text that stands alone here.", "c"), (3, "v", "<p>Some text that stands alone here.", "c"), (4, "w", "<p>" + "word " * 200_000 + "</p>", "d")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert [(r[0], r[3]) for r in got] == [(1, 0), (2, 0), (3, 33), (3, 33), (4, 999_999)]
    assert extract_text(pages.limit(0)).count() == 0
    assert extract_text(spark.read.parquet(f"{sf}/pages.parquet")).filter("n_chars = 0").count() == 0


LINKS = "".join(f"<li><a href={k}>Chapter number {k} of the book</a></li>" for k in range(4))
NAMES = " ".join(f"Chapter number {k} of the book" for k in range(4))


def test_lines_beyond_links_are_kept():
    """Link-only lines inside an article, several articles, and several runs of text without a marked article."""
    first, second = "First text that is long enough to be a run of its own.", "Second and shorter text, again a run of its own."
    assert main_text(PAGE % f"<article><p>{first}</p><ul>{LINKS}</ul><p>{second}</p></article>") == f"{first} {NAMES} {second}"
    assert main_text(PAGE % f"<article><h2><a href=x>Linked heading</a></h2><p>{first}</p></article>") == f"Linked heading {first}"
    assert main_text(PAGE % f"<article><p>{first}</p></article><ul>{LINKS}</ul><article><p>{second}</p></article>") == f"{first} {second}"
    assert main_text(PAGE % f"<div><p>{first}</p><ul>{LINKS}</ul><p>{second}</p></div>") == f"{first} {second}"
    assert main_text(PAGE % f"<div><p>{first}</p><p><a href=x>Linked line</a></p><p>{second}</p></div>") == f"{first} Linked line {second}"


def test_articles_are_not_dropped_by_names():
    text = "Text of an article that goes on for quite a while here."
    for tag in ('article class="post no-comments"', 'main class="has-sidebar"', 'div class="layout with-sidebar"', 'article id="social-policy"', "article class=comments", "main class=sidebar", "section class=widget"):
        name = tag.split()[0]
        assert main_text(f"<{tag}><p>{text}</p></{name}>") == text
        assert main_text(f"<{tag}><article><p>{text}</p></article></{name}>") == text
        assert main_text(f'<{tag}><article><p>{text}</p></article></{name}><div class="cookie-banner">We use cookies to make this page better.</div>') == text
    assert main_text(f"<form class=search><article><p>{text}</p></article></form>") == text
    assert main_text(f"<article><p>{text}</p></article><section class=comments><article><p>What a fine article this is.</p></article></section>") == text
    assert main_text(f'<div><p>{text}</p></div><div aria-label="Main navigation"><p>Many words about where to go from here.</p></div>') == text


def test_regions_are_chosen_by_text():
    long, more = "The main text of the page, which is long enough to surge and to outweigh all the rest of it.", "And more of it in a second block."
    assert main_text(f"<article><p>teaser</p></article><main><p>{long}</p><p>{more}</p></main>") == f"{long} {more}"
    assert main_text(f"<main><article><p>{long}</p></article><section><article><a href=x>One</a><p>teaser</p></article></section></main>") == long
    assert main_text(f"<main><p>{long}</p><p>{more}</p><ul><li><article>teaser</article></li></ul></main>") == f"{long} {more} teaser"
    assert main_text(f"<main><a href=x>Top</a></main><article><p>{long}</p></article>") == long
    assert main_text("<aside></aside><article>" * 20_000) == ""


def _page(rng, depth=0):
    """A random element as (name, attributes, children); children are elements or texts."""
    kinds = ("div", "p", "section", "article", "main", "aside", "nav", "ul", "a", "b", "header") if depth < 4 else ("p", "a")
    name = rng.choice(kinds) if depth else "body"
    attributes = rng.choice(("", "", "", ' class="sidebar"', ' class="text"', " hidden"))
    text = lambda: " ".join(rng.choice(("all", "these", "words", "of", "a", "page")) for _ in range(rng.choice((0, 1, 3, 12, 30))))
    flat = name in ("p", "a", "b")
    return name, "" if name == "body" else attributes, [text() if flat or rng.random() < 0.3 else _page(rng, depth + 1) for _ in range(1 if flat else rng.randint(1, 5))]


def _render(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(_render, node[2]))}</{node[0]}>"


def _plain_text(page):
    """Main text of a tree: every rule over every line, without parsing."""
    AWAY = {"aside", "nav", "header"}

    def regions(node, path, dropped):
        if isinstance(node, str):
            return []
        out = [(path, dropped)] if node[0] in ("article", "main") and "hidden" not in node[1] else []
        gone = dropped or (node[0] in AWAY or ("sidebar" in node[1] and node[0] not in ("article", "main")))
        return out + [r for k, c in enumerate(node[2]) for r in regions(c, (*path, k), gone)]

    def attempt(by_name):
        found = regions(page, (), False) if by_name else [(p, None) for p, _ in regions(page, (), False)]
        if not by_name:
            found = [(p, any(n in AWAY for n in _names(page, p)[:-1])) for p, _ in found]
        free = [p for p, d in found if not d]
        marked = free or [p for p, _ in found]
        lines, current = [], []

        def end(state):
            text = " ".join("".join(t for t, _ in current).split())
            if text:
                bare = sum(len(t.strip()) for t, linked in current if not linked)
                main, article = state
                lines.append((text, bare, sum(len(t.strip()) for t, linked in current if not linked or main or article), main, article))
            current.clear()

        def walk(node, path, main, article, linked):
            if isinstance(node, str):
                if node:
                    current.append((node, linked))
                return
            name, attributes, children = node
            state = main, article
            if path in marked:
                end(state)
                main, article = (main or path, article) if name == "main" else (main, article or path)
            holds = any(m[: len(path)] == path and m != path for m in marked)
            around = name in AWAY or (by_name and "sidebar" in attributes and name not in ("article", "main", "body"))
            around = around and (bool(free) or not holds) and not (name == "header" and (main or article) and "sidebar" not in attributes)
            if "hidden" in attributes or around:
                end((main, article))
            else:
                block = name not in ("a", "b")
                if block:
                    end((main, article))
                for k, c in enumerate(children):
                    walk(c, (*path, k), main, article, linked or name == "a")
                if block:
                    end((main, article))

        walk(page, (), None, None, False)
        return lines

    lines = attempt(True)
    if not any(x[2] for x in lines):
        lines = attempt(False)
    w = [x[2] for x in lines]
    sums = [sum(w[i : i + 3]) for i in range(len(w))]
    least = min(40, max(sums, default=0) // 4)
    keep = set()
    for i, s in enumerate(sums):
        if s > least:
            i = next(j for j in range(i, len(w)) if w[j])
            a = b = i
            while a and w[a - 1]:
                a -= 1
            while b + 1 < len(w) and sums[b + 1]:
                b += 1
            keep.update(range(a, b + 1))
    kept = [lines[i] for i in sorted(keep)]
    size = lambda x: (sum(r[1] for r in x), sum(r[2] for r in x))
    main, outside = [x for x in kept if x[3] is not None], [x for x in kept if x[3] is None and x[4] is not None]
    pool = main if main and size(main) >= size(outside) else outside
    if pool:
        inner = [x for x in pool if x[4] is not None]
        kept = pool
        if inner and 2 * size(inner)[0] >= size(pool)[0]:
            bare = {p: sum(x[1] for x in inner if x[4] == p) for p in dict.fromkeys(x[4] for x in inner)}
            most = max(bare, key=bare.get)
            kept = [x for x in inner if x[4][:-1] == most[:-1] or 4 * bare[x[4]] >= bare[most]]
    return " ".join(x[0] for x in kept)


def _names(page, path):
    names = [page[0]]
    for k in path:
        page = page[2][k]
        names.append(page[0])
    return names


def test_random_pages_against_a_plain_version():
    rng = random.Random(9)
    kept = 0
    for _ in range(3000):
        page = _page(rng)
        got = main_text(_render(page))
        assert got == _plain_text(page), _render(page)
        kept += bool(got)
    assert kept > 2000
