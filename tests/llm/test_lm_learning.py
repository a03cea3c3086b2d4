"""First weights come from all training rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import LOWER, prose, rows
from steadyield.llm import lm_score
from test_lm_score import plain_pairs, steps


def test_keys_are_numbered_as_if_sorted(monkeypatch):
    rng = np.random.default_rng(0)
    for tries in (lm_score._TRIES, lm_score._TRIES[:1], np.array([1 << 40], dtype=np.uint64)):
        monkeypatch.setattr(lm_score, "_TRIES", tries)
        for n, most in ((0, 1), (1, 9), (2, 1), (500, 40), (20_000, 3000), (20_000, 2**63)):
            key = rng.integers(0, most, n).astype(np.uint64)
            got, at = lm_score.numbered(key)
            want, number = np.unique(key, return_inverse=True)
            assert np.array_equal(got.key, want) and np.array_equal(got.number, number) and np.array_equal(key[at], want)


def test_a_decision_left_out_leaves_the_plain_state():
    for zero, one in ((1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (30, 0), (90, 110), (0, 250)):
        state, lower = (int(lm_score.states_of(np.array([z]), np.array([o]))[0]) for z, o in ((zero, one), (max(zero - 1, 0), one if zero else one - 1)))
        assert lm_score._LEFT[(0 if zero else 1) * lm_score.STATES + state] == lower


@pytest.fixture(scope="module")
def learned(spark):
    """Blocks of small texts, their codes and replies."""
    rng = random.Random(8)
    texts = [(k, f"{'aé中'[k % 3]} text number {k * k} of this kind\n{' '.join(prose(rng, k))}") for k in range(40)]
    blocks = lm_score.pack(rows(spark, texts).repartition(3), "doc_id", "text")
    histogram = np.zeros(1 << 16)
    for r in blocks.collect():
        histogram[r.both] += r.times
    codes = lm_score.codes_of(histogram.reshape(256, 256))
    return dict(texts), blocks, codes, lm_score.answered(lm_score.ask(blocks, codes, 40, 3, 0.0), 40)


def test_every_training_decision_teaches(learned):
    """What meets in a block is what plain counts say of each decision of its training texts; with 40 texts nobody taught when one in hundred did."""
    texts, blocks, codes, replies = learned
    low = {i: t.translate(LOWER) for i, t in texts.items()}
    counts = Counter((c, step, bit) for i, t in low.items() if lm_score.fold_of(i) for code, cs in plain_pairs(t, codes) for c in cs for step, bit in steps(code))
    sent = defaultdict(list)
    for r in replies.orderBy("part").collect():
        sent[r.block].append(r.states)
    n_blocks = 0
    for row in blocks.collect():
        chosen = [low[i].encode() for i in row.ids]
        body = lm_score.Texts(np.frombuffer(b"".join(chosen), np.uint8), np.cumsum([0, *map(len, chosen)]))
        *states, _ = (np.concatenate(x) for x in zip(*(lm_score.unsqueeze(x, *[np.uint16] * 3, np.int64) for x in sent[row.block]), strict=True))
        met = lm_score.met_in(lm_score.held_in(body, codes, 40), states, np.array([lm_score.fold_of(i) != 0 for i in row.ids]))
        got = dict(zip(*(x.tolist() for x in lm_score.unsqueeze(met, np.uint32, np.int64)), strict=True))
        want = Counter()
        for i in row.ids:
            for code, cs in plain_pairs(low[i], codes) if lm_score.fold_of(i) else ():
                for step, bit in steps(code):
                    state = [int(lm_score.states_of(*(np.array([counts[c, step, b]]) for b in (0, 1)))[0]) for c in cs]
                    first, second, third = [int(lm_score._LEFT[bit * lm_score.STATES + x]) for x in state] + [lm_score.STATES] * (3 - len(state))
                    want[((first * lm_score.STATES + second) * (lm_score.STATES + 1) + third) * 2 + bit] += 1
        assert got == want
        n_blocks += 1
    assert n_blocks == 3


def test_weights_are_learned_from_few_texts(learned):
    texts, blocks, codes, replies = learned
    assert not any(lm_score.teaches(i, t.translate(LOWER).encode(), 0.01) for i, t in texts.items() if lm_score.fold_of(i))
    first = np.tile(lm_score._FIRST, (lm_score.GATES, 1))
    assert np.abs(lm_score.learn(blocks, replies, codes, 40).weights - first).max() > 0.1


def test_a_share_of_texts_may_teach_with_their_counts_taken_out(spark, learned):
    texts, blocks, codes, _ = learned
    asked = lm_score.answered(lm_score.ask(blocks, codes, 40, 3, 1.0), 40)
    apart, all_rows = lm_score.learn(blocks, asked, codes, 40, 1.0), lm_score.learn(blocks, asked, codes, 40)
    assert np.array_equal(apart.odds, all_rows.odds) and not np.array_equal(apart.weights, all_rows.weights)
