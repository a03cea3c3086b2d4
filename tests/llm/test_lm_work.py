"""Blocks do no more work on a byte than they need, with the same results."""

import random
from collections import Counter

import numpy as np
import pytest

from helpers import prose
from steadyield.llm import lm_score


@pytest.fixture
def block():
    """Some texts, an empty one and repeated ones among them, which of them train, and codes."""
    rng = random.Random(5)
    texts = [f"{'aé中'[k % 3]}  {k % 4}\n{' '.join(prose(rng, 40 * (k % 7)))}".encode() for k in range(60)] + [b"", b"x", b" ", "中".encode()]
    body = lm_score.Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    histogram = np.bincount(body.data[:-1].astype(int) << 8 | body.data[1:], minlength=1 << 16).reshape(256, 256)
    return texts, body, np.arange(len(texts)) % 5 != 0, lm_score.codes_of(histogram)


def test_sorted_pairs_are_those_of_numbered_streams(block, monkeypatch):
    """What a block asks for is what it finds again when answers come, also where contexts share a hash."""
    texts, body, train, codes = block
    for bits in (40, 12, 7):
        asked = []
        for n_bytes in (1 << 20, 500):
            monkeypatch.setattr(lm_score, "SORTED_BYTES", n_bytes)
            monkeypatch.setattr(lm_score, "PIECE_BYTES", 3 * n_bytes)
            *pairs, (words, often) = lm_score.pairs_in(body, train, codes, bits)
            held, whole = lm_score.held_in(body, codes, bits), lm_score.stream_of(body, codes, bits)
            assert all(np.array_equal(key, mine) for (key, _), mine in zip(pairs, held.keys, strict=True))
            assert [count.sum() for _, count in pairs] == [train[whole.doc].sum()] * 2 + [train[whole.doc][whole.start].sum()]
            for (key, count), want, times in [*zip(pairs, whole.keys, whole.counts(train[whole.doc]), strict=True)][0 if bits == 40 else 1 :]:
                assert np.array_equal(key, want) and np.array_equal(count, times)
            for k, (at, to, s) in enumerate(held.streams):
                own = lm_score.stream_of(lm_score.Texts(body.data[body.offsets[at] : body.offsets[to]], body.offsets[at : to + 1] - body.offsets[at]), codes, bits)
                assert np.array_equal(held.keys[1][held.mine[1][k].take(s.long.number)], own.long.key[own.long.number])
            wanted = Counter({lm_score.END_WORD: train.sum()})
            wanted.update({int(t): 0 for t in whole.token})
            wanted.update(whole.token[train[whole.token_doc]].tolist())
            assert dict(zip(words.tolist(), often.tolist(), strict=True)) == {int(k): n for k, n in wanted.items()} and (words[1:] > words[:-1]).all()
            asked.append([x for pair in pairs for x in pair])
        assert all(np.array_equal(a, b) for a, b in zip(*asked, strict=True))


def test_meetings_of_contexts_with_one_hash_are_all_counted(block):
    texts, body, train, codes = block
    held = lm_score.held_in(body, codes, 7)
    states = [np.zeros(lm_score.places_of(key.astype(np.uint16))[-1], np.uint16) for key in held.keys]
    _, times = lm_score.unsqueeze(lm_score.met_in(held, states, train), np.uint32, np.int64)
    assert times.sum() == sum(lm_score._LENGTH[s.code[train[at:to][s.doc]]].sum(dtype=int) for at, to, s in held.streams)


def test_without_training_texts_all_counts_are_0(block):
    texts, body, train, codes = block
    for key, count in lm_score.pairs_in(body, np.zeros_like(train), codes, 40):
        assert len(key) == len(count) and not count.any()


def test_pieces_number_no_pair_twice(block, monkeypatch):
    """What is put in order are the distinct pairs of the pieces, not every byte; before, all bytes were, piece by piece."""
    texts, body, train, codes = block
    monkeypatch.setattr(lm_score, "PIECE_BYTES", 4000)
    whole, ordered = lm_score.stream_of(body, codes, 40), []
    monkeypatch.setattr(lm_score, "numbered", lambda key, f=lm_score.numbered: ordered.append(len(key)) or f(key))
    held = lm_score.held_in(body, codes, 40)
    assert len(held.streams) > 1 and sum(ordered) < len(whole.code)
    for c, key in enumerate(whole.keys):
        assert np.array_equal(held.keys[c], key)
    long = np.concatenate([held.mine[1][k].take(s.long.number) for k, (_, _, s) in enumerate(held.streams)])
    words = np.concatenate([held.mine[2][k].take(s.words.number) for k, (_, _, s) in enumerate(held.streams)])
    assert np.array_equal(long, whole.long.number) and np.array_equal(words, whole.words.number) and np.array_equal(held.short, whole.short.number)
    ordered.clear()
    lm_score.pairs_in(body, train, codes, 40)
    assert not ordered


def test_meetings_that_come_once_are_summed_up_with_others():
    rng = np.random.default_rng(1)
    once, number, times = rng.integers(0, 50, 300).astype(np.uint32), rng.integers(30, 90, 200).astype(np.uint32), rng.integers(1, 9, 200)
    want = Counter(once.tolist())
    for n, t in zip(number.tolist(), times.tolist(), strict=True):
        want[n] += t
    got = lm_score.unsqueeze(lm_score.summed_up([(once[:100], None), (number, times), (once[100:], None)]), np.uint32, np.int64)
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == want and (np.diff(got[0].astype(int)) > 0).all()
    assert all(len(x) == 0 for x in lm_score.unsqueeze(lm_score.summed_up([]), np.uint32, np.int64))
