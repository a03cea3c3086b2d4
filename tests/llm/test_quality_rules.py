from collections import Counter

from helpers import odd_texts, rows, words
from steadyield.llm import quality_rules


def plain(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), base


def test_measures_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules.quality_rules(docs).filter("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert judged.filter("quality = 1 and not kept").count() == 0
    assert judged.filter("quality = 0 and kept").count() == 0


def test_order_of_rules_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.production_rules()
    one = quality_rules.keep_good(docs, rules=rules).select("doc_id").orderBy("doc_id").collect()
    other = quality_rules.keep_good(docs, rules=rules[::-1]).select("doc_id").orderBy("doc_id").collect()
    judged = quality_rules.quality_rules(docs).filter("kept").select("doc_id").orderBy("doc_id").collect()
    assert one == other == judged


def test_odd_texts_and_empty_table(spark):
    texts = dict(odd_texts())
    for r in quality_rules.quality_rules(rows(spark, odd_texts())).collect():
        if r.doc_id != 7:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
    assert quality_rules.keep_good(rows(spark, [])).count() == 0
    assert quality_rules.quality_rules(rows(spark, [])).count() == 0
