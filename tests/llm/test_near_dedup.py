import random

import numpy as np
import pytest

from helpers import edited, groups, odd_texts, prose, rows
from steadyield.llm import near_dedup


def found(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_those_of_all_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    rng = random.Random(width)
    texts = [(k, " ".join(prose(rng, rng.randrange(5, 120)))) for k in range(60)]
    base = prose(rng, 200)
    texts += [(100 + k, " ".join(edited(rng, base, 0.045))) for k in range(70)]  # many pairs close to the threshold
    texts += [(300 + k, texts[3][1].upper()) for k in range(40)]
    got = found(near_dedup.near_duplicates(rows(spark, texts), width=width))
    want = groups(texts, width)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_odd_texts_and_empty_table(spark):
    got = found(near_dedup.near_duplicates(rows(spark, odd_texts()), width=2))
    assert [got[k].n_shingles for k in (1, 2, 3, 4, 5, 6, 8)] == [0, 0, 0, 1, 1, 1, 1]
    assert got[5].component_id == 4 and not got[5].kept
    assert all(got[k].kept for k in (1, 2, 3, 4, 6, 7, 8, 9))
    assert near_dedup.near_duplicates(rows(spark, []), width=2).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six"
    got = near_dedup.near_duplicates(rows(spark, [(None, text), (1, text), (1, text), (1, "quite another text"), (2, "quite another text")]), width=2).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id is not None} == {1}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n, cut = 1000, int(1000 * share * 2 / (1 + share))
            value = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            sets = np.concatenate([value[:n], value[:cut], value[n : 2 * n - cut]])
            r = near_dedup.sketch(sets, np.array([0, n]))
            errors.append(near_dedup.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0] - cut / (2 * n - cut))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@pytest.mark.parametrize("rounds", [0, 1])
def test_tiles_alone_find_all_links(spark, rounds, monkeypatch):
    """Without the rounds that join parts early, the tiles must find what is left."""
    monkeypatch.setattr(near_dedup, "TILE", 5)
    monkeypatch.setattr(near_dedup, "JOIN_ROUNDS", rounds)
    rng = random.Random(9)
    base = prose(rng, 150)
    texts = [(k, " ".join(edited(rng, base, 0.05 + 0.001 * (k % 20)))) for k in range(60)]
    got = found(near_dedup.near_duplicates(rows(spark, texts), width=2))
    assert {i: r.component_id for i, r in got.items()} == groups(texts, 2)


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(9)]
    value, row = np.concatenate(sets), np.repeat(np.arange(9), [len(s) for s in sets])
    got = near_dedup.intersections(value, row, 4, 9, step=7)
    assert got.tolist() == [[len(np.intersect1d(sets[x], sets[y])) for y in range(4, 9)] for x in range(4)]


def test_links_of_a_whole_table(spark):
    """All documents of the second table, against shared shingles counted one by one."""
    from collections import Counter, defaultdict

    from helpers import shingle_set

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {i: shingle_set(t, 2) for i, t in docs.collect()}
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
        for g in sets[i]:
            holders[g].append(i)
    got = found(near_dedup.near_duplicates(docs, width=2))
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in sets}
    assert sum(not r.kept for r in got.values()) > 50
