import math
import zlib

from steadyield.llm import url_filter
from steadyield.llm.url_filter import filter_urls


def judge(spark, urls):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in filter_urls(pages).collect()}


def test_parts_and_rules(spark):
    got = judge(spark, ["HTTP://WWW.Example.NET/en/1?q=/x#y", "https://example.net", "x://a.org/fr/2#z", "http://a.example.com/de/", "no scheme", None, "http://xexample.com/de/", "http://Ä.org?/fr/", "a://b://c/d", "http://h.example.org/\n/e"])
    assert [(got[k].host, got[k].path) for k in range(10)] == [("www.example.net", "/en/1"), ("example.net", ""), ("a.org", "/fr/2"), ("a.example.com", "/de/"), ("", ""), ("", ""), ("xexample.com", "/de/"), ("Ä.org", ""), ("b:", "//c/d"), ("h.example.org", "/\n/e")]
    assert [got[k].rule for k in range(7)] == ["example.net/en/", None, "org/fr/", "example.com/de/", None, None, None]
    assert [got[k].verdict for k in (0, 2, 3, 4, 5)] == ["allow", "allow", "block", "allow", "allow"]


def test_model_tells_hosts_apart(spark):
    bad = [f"http://{sub}{name}.example.org/en/{k}" for k, name in enumerate(("casino-win", "cheap-pills", "spam-farm", "ads-track", "free-bets")) for sub in ("", "www.", "m.")]
    good = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if not any(w in r.url for w in ("casino", "pills", "spam", "ads-", "bets"))]
    got = judge(spark, bad + good)
    assert all(got[k].verdict == "block" for k in range(len(bad)))
    wrong = sum(got[k].rule is None and got[k].verdict == "block" for k in range(len(bad), len(bad) + len(good)))
    assert wrong <= 0.02 * len(good)


def test_names_outside_the_table(spark):
    """Hosts of words that share no whole word with the table's ordinary ones, and unwanted ones in other company."""
    bad = ["casino777-royal", "bestpills24", "hot-adult-x", "pokerheaven", "lotterywinner", "mega-jackpots", "xxxvideo", "torrentking", "spammers-hub", "replicawatch"]
    good = ["oak-lane", "bluebottle", "gardeners-guild", "kestrel", "harbour-view", "quilting", "violin-lessons", "chess-club", "townhall", "sailing", "orchard", "beekeeper", "telescope", "pottery", "marathon", "lighthouse", "archive", "parliament", "geology", "puppets"]
    got = judge(spark, [f"http://www.{h}.example.org/en/{k}" for k, h in enumerate(bad + good)])
    missed = sum(got[k].verdict == "allow" for k in range(len(bad)))
    wrong = sum(got[k].verdict == "block" for k in range(len(bad), len(bad) + len(good)))
    assert missed <= 3 and wrong <= 3  # as measured: about a quarter and a tenth


def test_scores_equal_plain_ones(spark):
    weights, bias = url_filter.train(url_filter.labelled_urls())
    urls = ["http://casino.example.org/en/1", "http://river.example.org/x", "none", "http://" + "a" * 3000 + ".example.org/" + "b" * 5000] * 2
    got = judge(spark, urls)
    for k, url in enumerate(urls):
        host, path = (got[k].host, got[k].path)
        grams = {f"{part}{t[i : i + n]}" for part, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        at = {zlib.crc32(g.encode()) % (1 << url_filter.BITS) for g in grams}
        z = bias + sum(weights[x] for x in at) / max(1, len(at)) ** 0.5
        assert abs(got[k].score - 1 / (1 + math.exp(-z))) < 1e-4 and got[k].verdict == ("block" if z >= 0 else "allow")


def test_rules_may_be_others_and_table_empty(spark):
    assert judge(spark, []) == {}
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules=(("block", "b", "/c"),)).first().verdict == "block"
