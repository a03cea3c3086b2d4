from helpers import groups, rows, words
from pyspark.sql import functions as F
from steadyield.llm import stages
from test_source_mix import targets

import corpus_pipeline


def test_stages_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = stages.keep_good_documents(spark, docs, sf)
    one = stages.keep_one_of_each_group(spark, good, sf)
    part = groups([(r.doc_id, r.text) for r in good.collect()], 5)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(part.values()))
    clean = stages.drop_benchmark_leaks(spark, one, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert clean.filter("text is null").count() == 0
    leaked = {r.doc_id for r in one.collect() if any(i in r.text for i in items)}
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == leaked
    mixed = stages.mix_to_targets(spark, clean, sf).collect()
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= max(len(words(r.text)) for r in clean.collect() if r.source == s) / 2 + 1e-6
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in mixed)
    counts = [sum(r.shard == s for r in out) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_columns_and_odd_rows(spark, sf):
    long = "some words that make a text of their own number "
    data = [(None, None), (1, ""), (2, " ".join(long + str(k * 17 % 101) for k in range(60)))]
    data += [(2, data[2][1]), (3, data[2][1].upper()), (None, " ".join(f"w{k} x{k * k}" for k in range(90)))]
    docs = rows(spark, data)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert sorted(str(r.doc_id) for r in stages.keep_one_of_each_group(spark, docs, sf).collect()) == ["1", "2", "None", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(data)


def test_columns_named_like_what_stages_add(spark, sf):
    text = " ".join(f"word{k} other{k * k}" for k in range(90))
    own = ("__nth", "__h", "__g", "__turns", "__finish", "__tie", "__NTH_")
    docs = rows(spark, [(1, text), (2, text + " more"), (2, text + " more")])
    for n, c in enumerate(own):
        docs = docs.withColumn(c, F.lit(n))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")] or name == "shard", name
        got = out.collect()
        assert got and all(r[c] == n for r in got for n, c in enumerate(own)), name


def test_of_repeated_ids_the_same_row_stays(spark, sf):
    text = " ".join(f"word{k}" for k in range(80))
    docs = rows(spark, [(5, text)] * 6, sources=("a", "b", "c", "d", "e", "f"))
    kept = {stages.keep_one_of_each_group(spark, docs.repartition(n), sf).collect()[0].source for n in (1, 2, 3, 5)}
    assert len(kept) == 1
