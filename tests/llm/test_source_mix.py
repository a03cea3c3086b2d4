from helpers import odd_texts, rows, words
from steadyield.llm import source_mix


def targets(sizes):
    """Shares refilled until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def check(docs):
    got = source_mix.mix_sources(docs, carry=("source",)).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6
    return got


def test_targets_and_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, check(docs)), key=str) == sorted(map(tuple, check(docs.repartition(7))), key=str)


def test_capped_sources(spark):
    texts = [(k, "w " * n) for k, n in enumerate([5, 5, 900, 40, 3, 800])]
    check(rows(spark, texts, sources=("tiny", "big", None)))


def test_odd_texts_and_empty_table(spark):
    got = {r.doc_id: r for r in check(rows(spark, odd_texts(), sources=("a", None, "b")))}
    assert got[1].taken == got[2].taken == got[3].taken == 0
    assert source_mix.mix_sources(rows(spark, [])).count() == 0


def test_queue_is_in_order_of_finish(spark, sf):
    served = source_mix.queue(source_mix.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert all(a.finish <= b.finish for a, b in zip(served, served[1:]))
