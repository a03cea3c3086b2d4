import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from helpers import LOWER, odd_texts, prose, rows, words
from steadyield.llm import lm_score


def test_base_score_and_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: [*words(r.text.translate(LOWER)), "\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    got = lm_score.score_texts(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.bits_per_byte for r in unseen) / len(unseen) < 2.6
    assert sum(r.score for r in unseen) > 1.15 * sum(r.base_score for r in unseen)


def test_held_out_texts_beat_the_base(spark):
    """With some more to learn from, the model says more than words alone, though it predicts white space as well."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    s, b = lm_score.score_texts(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).select("sum(score)", "sum(base_score)").first()
    assert s > b


def test_codes_are_prefix_free_and_full():
    """Decisions that sum to one over all bytes: each of the two ways costs what its chance says."""
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 1000, (256, 256)).astype(float) * (rng.random((256, 256)) < 0.1)
    histogram[7] = 0
    codes = lm_score.codes_of(histogram)
    lengths = lm_score._LENGTH[codes].astype(int)
    assert lengths.max() <= lm_score.LEVELS and (np.abs((0.5**lengths).sum(axis=1) - 1) < 1e-9).all()
    for row, length in zip(codes.tolist(), lengths.tolist(), strict=True):
        words = [format(c, "016b")[:n] for c, n in zip(row, length, strict=True)]
        assert all(not y.startswith(x) for x, y in zip(sorted(words), sorted(words)[1:]))
    assert np.abs(2.0**-lm_score._COST + 2.0 ** -lm_score._COST[::-1] - 1).max() < 1e-6


def plain_pairs(text, codes):
    """For each byte of a text its code word and, of each predictor, the context."""
    data = b"\xff" * 4 + text.encode() + b"\xff"
    out = []
    for k in range(4, len(data)):
        contexts = [("short", data[k - 2 : k]), ("long", data[k - 4 : k])]
        if data[k - 1 : k] in (b" ", b"\n", b"\xff"):
            before = data[4:k].split()
            contexts.append(("words", tuple(before[-2:]), data[k - 1]))
        out.append((int(codes[data[k - 1], data[k]]), contexts))
    return out


def steps(code):
    n = int(lm_score._LENGTH[code])
    return [((level, code >> (16 - level)), code >> (15 - level) & 1) for level in range(n)]


def test_states_come_from_plain_counts(spark):
    """What a block gets back is what plain counts over all training texts say; a teaching text's own are taken out; odds follow from counts with each decision left out."""
    rng = random.Random(8)
    texts = [(k, f"{'aé中'[k % 3]} text number {k * k} of this kind\n{' '.join(prose(rng, k))}") for k in range(40)]
    blocks = lm_score.pack(rows(spark, texts).repartition(3), "doc_id", "text").cache()
    histogram = np.zeros(1 << 16)
    for r in blocks.collect():
        histogram[r.both] += r.times
    codes = lm_score.codes_of(histogram.reshape(256, 256))
    low = lambda t: t.translate(LOWER)
    counts = Counter((c, step, bit) for i, t in texts if lm_score.fold_of(i) for code, cs in plain_pairs(low(t), codes) for c in cs for step, bit in steps(code))
    state = lambda c, step, own: int(lm_score.states_of(*(np.array([counts[c, step, b] - own[c, step, b]]) for b in (0, 1)))[0])
    for n_parts, at_once in ((1, 500), (7, 10**6)):
        replies = lm_score.answered(lm_score.ask(blocks, codes, 40, n_parts, 1.0), 40, at_once)
        states, lessons = defaultdict(list), defaultdict(list)
        for r in replies.orderBy("part").collect():
            states[r.block].append(r.states)
            lessons[r.block] += [r.lesson] if r.lesson else []
        for row in blocks.collect():
            chosen = [low(dict(texts)[i]) for i in row.ids]
            body = lm_score.Texts(np.frombuffer("".join(chosen).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in chosen)]))
            s = lm_score.stream_of(body, codes, 40)
            *got, _ = (np.concatenate(x) for x in zip(*(lm_score.unsqueeze(x, *[np.uint16] * 3, np.int64) for x in states[row.block]), strict=True))
            at = [lm_score.places_of(key.astype(np.uint16)) for key in s.keys]
            word, k = dict(zip(s.start.tolist(), s.words.number.tolist(), strict=True)), 0
            for t in chosen:
                for code, cs in plain_pairs(t, codes):
                    assert s.code[k] == code and (len(cs) == 3) == (k in word)
                    long = s.long.number[k]
                    places = [at[0][s.short.number[long]], at[1][long], *([at[2][word[k]]] if k in word else [])]
                    assert all(got[c][place + level] == state(x, step, Counter()) for c, (place, x) in enumerate(zip(places, cs, strict=True)) for level, (step, _) in enumerate(steps(code)))
                    k += 1
            # teaching texts
            train = [t for i, t in zip(row.ids, chosen, strict=True) if lm_score.fold_of(i)]
            teach = lm_score.Teaching(body.take(np.flatnonzero([lm_score.fold_of(i) for i in row.ids])), codes, 40)
            own_states = [np.concatenate(x) for x in zip(*(lm_score.unsqueeze(x, *[np.uint16] * 3) for x in lessons[row.block]), strict=True)]
            at = [lm_score.places_of(key.astype(np.uint16)) for key in teach.key]
            for j, (t, s) in enumerate(zip(train, teach.streams, strict=True)):
                own = Counter((c, step, bit) for code, cs in plain_pairs(t, codes) for c in cs for step, bit in steps(code))
                for k, (code, cs) in enumerate(plain_pairs(t, codes)):
                    for level, (step, _) in enumerate(steps(code)):
                        assert own_states[1][at[1][teach.rank[1][j][s.long.number[k]]] + level] == state(cs[1], step, own)
        sums = np.sum([r.seen for r in replies.filter("seen is not null").collect()], axis=0).reshape(3, 2, -1)
        want = np.zeros_like(sums)
        for (c, step, bit), n in counts.items():
            pair = [counts[c, step, b] - (b == bit) for b in (0, 1)]
            want[("short", "long", "words").index(c[0]), bit, lm_score.states_of(*(np.array([x]) for x in pair))[0]] += n
        assert np.array_equal(sums, want)


def test_bits_are_those_of_a_plain_mixer():
    """One decision after the other, in plain floating point."""
    rng = random.Random(4)
    texts = [" ".join(prose(rng, n)) + "\n" for n in (3, 120, 400, 1500)] + ["", "x"]
    body = lm_score.Texts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    histogram = np.bincount(body.data[:-1].astype(int) << 8 | body.data[1:], minlength=1 << 16).reshape(256, 256)
    codes, r = lm_score.codes_of(histogram), np.random.default_rng(2)
    s = lm_score.stream_of(body, codes, 40)
    at = [lm_score.places_of(key.astype(np.uint16)) for key in s.keys]
    states = [r.integers(0, lm_score.STATES, x[-1]).astype(np.uint16) for x in at]
    model = lm_score.Model(np.append(r.normal(0, 2, (3, lm_score.STATES)), np.zeros((3, 1)), axis=1).astype(np.float32), r.normal(0.4, 0.2, (lm_score.GATES, 3)))
    inputs = lm_score.Inputs(s.keys, s.short.number, states, model)
    got = lm_score.text_bits(s, np.arange(len(s.long.key)), np.arange(len(s.words.key)), inputs, model, len(texts))
    word = dict(zip(s.start.tolist(), s.words.number.tolist(), strict=True))
    want, kinds = np.zeros(len(texts)), lm_score.KINDS
    for d in range(len(texts)):
        own, turn, now = np.zeros(3), np.zeros(4), 0
        for k in np.flatnonzero(s.doc == d):
            place = int(s.place[k])
            stretch = int(math.log2(place / 256 + 1)) if place < 32512 else 7 + (place - 32512) // 16384
            if stretch != now:
                own, turn, now = own + lm_score.RATE * turn[:3] / (turn[3] + 100), np.zeros(4), stretch
            long = s.long.number[k]
            begin = [at[0][s.short.number[long]], at[1][long], *([at[2][word[k]]] if k in word else [])]
            for level, (_, bit) in enumerate(steps(int(s.code[k]))):
                seen = [int(states[c][b + level]) for c, b in enumerate(begin)]
                x = np.array([model.odds[c][v] for c, v in enumerate(seen)])
                a, b = (v // lm_score.BINS for v in seen[-2:])
                w = model.weights[a * kinds + b + (kinds * kinds if len(seen) == 3 else 0)][: len(x)]
                p = 1 / (1 + math.exp(-float(((w + own[: len(x)]) * x).sum())))
                want[d] -= math.log2(p if bit else 1 - p)
                turn[: len(x)] += (bit - p) * x
                turn[3] += p * (1 - p) * (x * x).sum()
    assert np.allclose(got, want, rtol=0.01)


def test_score_depends_on_the_text_alone(spark):
    texts = odd_texts() + [(k, f"some words number {k % 3} and more of them") for k in range(20, 60)]
    got = {r.doc_id: r for r in lm_score.score_texts(rows(spark, texts)).collect()}
    assert got[4].score == got[5].score and got[20].score == got[23].score
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[7].n_tokens == 60_001
    assert all(math.isfinite(r.score) for r in got.values())


def test_ids_of_other_types(spark):
    docs = rows(spark, [(1, "a b"), (2, "c")])
    for kind in ("smallint", "string", "decimal(9,0)"):
        got = lm_score.score_texts(docs.selectExpr(f"cast(doc_id as {kind}) as doc_id", "text"))
        assert got.schema["doc_id"].dataType.simpleString() == kind and got.count() == 2


def test_null_ids_repeated_rows_and_empty_table(spark):
    got = lm_score.score_texts(rows(spark, [(None, "a b"), (3, "a b"), (3, "a b")])).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert lm_score.score_texts(rows(spark, [])).count() == 0


def test_high_counts_are_told_apart():
    states = lm_score.states_of(*(np.array([300, 30_000, 3_000_000]) for _ in range(2)))
    assert len(set(states.tolist())) == 3


def test_teaching_texts_are_counted_whole(spark):
    """Rows that share an id, beyond their first 8000 bytes."""
    rng = random.Random(3)
    shared = next(k for k in range(10_000) if lm_score.fold_of(k) and zlib.crc32(f"w{k}".encode()) < 0.05 * 2**32)
    unseen = next(k for k in range(10_000) if not lm_score.fold_of(k))
    tail = " ".join(prose(rng, 600))
    got = lm_score.score_texts(rows(spark, [(shared, " ".join(prose(rng, 1500)) + " " + tail) for _ in range(5)] + [(unseen, tail)])).filter("held_out").first()
    assert got.bits_per_byte < 2  # the words are drawn from 240, 1.2 bits a byte


def test_all_bytes_are_predicted(spark):
    """Bytes that are not among the commonest but follow from those before."""
    line = "".join(chr(c) for c in range(0x21, 0x800) if not 0x7F <= c < 0xA0)
    unseen = next(k for k in range(100) if not lm_score.fold_of(k))
    got = lm_score.score_texts(rows(spark, [(k, f"{line} and {k % 7} more") for k in range(30)] + [(unseen, line)])).filter("held_out").agg({"bits_per_byte": "max"}).first()[0]
    assert got < 1
