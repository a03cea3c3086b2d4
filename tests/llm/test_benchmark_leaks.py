import random
import re

from helpers import LOWER, odd_texts, prose, rows
from steadyield.llm import benchmark_leaks


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_finds_passages_with_edits_and_leaves_the_rest(spark):
    rng = random.Random(2)
    bench = [" ".join(prose(rng, n)) for n in (14, 30, 60, 25)]
    texts, want = [], set()
    for k in range(40):
        body = prose(rng, 200)
        if k % 4 == 0:
            item = k // 4 % len(bench)
            chars = list(bench[item])
            for _ in range(int(0.06 * len(chars))):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(("", "z", chars[at] + "y"))
            at = rng.randrange(len(body))
            body[at:at] = "".join(chars).upper().split()
            want.add((k, item))
        texts.append((k, " ".join(body)))
    got = benchmark_leaks.benchmark_leaks(rows(spark, texts), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(texts)
    for r in got:
        stretch = text[r.doc_id][r.start : r.end]
        assert abs(len(stretch) - len(bench[r.item_id])) <= 0.2 * len(stretch)
    kept = benchmark_leaks.drop_leaks(rows(spark, texts), items(spark, bench))
    assert {r.doc_id for r in kept.collect()} == set(text) - {d for d, _ in want}


def plain(text):
    low = (text or "").translate(LOWER).encode()
    return b" " + re.sub(rb" +", b" ", bytes(c if c > 127 or chr(c).isalnum() else 32 for c in low)).strip(b" ") + b" "


def least_edits(item, text):
    """Of an item against any stretch of a text, byte by byte."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item):
        last, row = row, [k + 1]
        for j, d in enumerate(text):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_equals_plain_edit_distances(spark):
    rng = random.Random(12)
    bench = [" ".join(prose(rng, n)) for n in (2, 4, 9, 15)] + ["é" * 9 + " ünd so weiter immer fort"]
    texts = []
    for k in range(60):
        chars = list(rng.choice(bench))
        for _ in range(rng.randrange(0, 1 + len(chars) // 6)):
            at = rng.randrange(len(chars))
            chars[at] = rng.choice(("", "z", chars[at] + "y"))
        texts.append((k, " ".join(prose(rng, rng.randrange(12))) + " " + "".join(chars) + "! " + " ".join(prose(rng, rng.randrange(12)))))
    size = [len(plain(b).strip(b" ")) for b in bench]
    budget = [int(0.1 * n) for n in size]
    want = {(k, i) for k, t in texts for i, b in enumerate(bench) if least_edits(plain(b).strip(b" "), plain(t)) <= budget[i]}
    got = benchmark_leaks.benchmark_leaks(rows(spark, texts), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 10 < len(want) < 200


def test_short_items_have_their_whole_budget(spark):
    """Items of every length from 8 to 41 bytes, with as many edits as a tenth allows spread out, one more, and shared among documents."""
    rng = random.Random(31)
    bench = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(8, 42)]
    texts = []
    for item in bench:
        for edits in range(int(0.1 * len(item)) + 2):
            chars = list(item)
            for e in range(edits):
                at = (e + 1) * len(item) // (edits + 1)
                chars[min(at, len(chars) - 1)] = rng.choice(("", "z", "yz"))
            texts.append((len(texts), "k " * rng.randrange(5) + "".join(chars) + " k" * rng.randrange(5)))
    want = {(k, i) for k, t in texts for i, b in enumerate(bench) if least_edits(b.encode(), plain(t)) <= int(0.1 * len(b))}
    got = benchmark_leaks.benchmark_leaks(rows(spark, texts), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 80


def test_ids_of_other_types_and_a_long_item(spark):
    rng = random.Random(3)
    long = " ".join(prose(rng, 1500))
    cut_up = " ".join(w if k % 40 else "zz" for k, w in enumerate(long.split()))
    docs = rows(spark, [(1, "start " + cut_up + " end"), (2, " ".join(prose(rng, 1500)))])
    for kind in ("int", "string", "smallint"):
        got = benchmark_leaks.benchmark_leaks(docs, items(spark, [long]).selectExpr(f"cast(item_id as {kind}) as item_id", "text"))
        assert got.schema["item_id"].dataType.simpleString() == kind and [r.doc_id for r in got.collect()] == [1]


def test_blocks_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted((r.doc_id, r.item_id) for r in benchmark_leaks.benchmark_leaks(docs, bench).collect())
    monkeypatch.setattr(benchmark_leaks.benchmark_blocks, "__defaults__", ("item_id", "text", 3000))
    assert sorted((r.doc_id, r.item_id) for r in benchmark_leaks.benchmark_leaks(docs, bench).collect()) == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {(d, b.item_id) for d, t in texts.items() for b in bench.collect() if b.text in t} <= set(whole)


def test_odd_texts_and_empty_tables(spark):
    odd = rows(spark, odd_texts())
    got = benchmark_leaks.benchmark_leaks(odd, items(spark, [None, "", "?!", "word", "two words"])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 3), (5, 3), (6, 4)}
    assert benchmark_leaks.benchmark_leaks(odd, items(spark, [])).count() == 0
    assert benchmark_leaks.benchmark_leaks(rows(spark, []), items(spark, ["some text"])).count() == 0
