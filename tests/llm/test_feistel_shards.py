import numpy as np
from pyspark.sql import functions as F

from helpers import odd_texts, rows
from steadyield.llm.feistel_shards import feistel, half_width, numbered, permute, shard_rows


def test_permutation():
    for n in (1, 2, 3, 5, 24, 1000, 4097):
        assert sorted(permute(np.arange(n), n)) == list(range(n))
    half = half_width(1000)
    assert len(set(feistel(np.arange(1 << 2 * half), half))) == 1 << 2 * half
    p = permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05


def shards(docs):
    return sorted((str(r.doc_id), r.shard, r.slot) for r in shard_rows(docs.select("doc_id", F.crc32("text").alias("c")), "doc_id", "c").collect())


def test_shards_are_even_and_reproducible(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shards(docs)
    assert got == shards(docs.repartition(9))
    by = {}
    for _, s, k in got:
        by.setdefault(s, []).append(k)
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_numbers_follow_the_order(spark):
    got, n = numbered(rows(spark, [(5, "e"), (None, "n"), (2, "b"), (2, "b"), (9, "x")]).select("doc_id"), "doc_id")
    assert n == 5 and [r.doc_id for r in got.orderBy("row_number").collect()] == [None, 2, 2, 5, 9]
    assert sorted(r.row_number for r in got.collect()) == list(range(5))


def test_odd_texts_and_empty_table(spark):
    assert len(shards(rows(spark, odd_texts()))) == len(odd_texts())
    assert shards(rows(spark, [])) == []
