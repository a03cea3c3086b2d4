import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from helpers import odd_texts, rows
from steadyield.llm.perfect_hash import PerfectHash
from steadyield.llm.token_alignment import FOLDER, align_tokens, byte_values, pieces_of
from tokenizers import Tokenizer

A = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
VALUE = byte_values()
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def a_bytes(i):
    return bytes(VALUE[c] for c in A.id_to_token(i))


def b_bytes(i):
    t = B.id_to_piece(i)
    return bytes([int(t[3:5], 16)]) if B.is_byte(i) else t.replace("▁", " ").encode()


def spans(ids, of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(of(i)), i))
        at += len(of(i))
    return out


def plain(texts):
    """Whole texts, every token compared with every token near it."""
    made, counts = [], Counter()
    for text in texts:
        a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            made.append(None)
            continue
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        links, j0 = [], 0
        for s, e, x in a:
            while b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][0] < e:
                links.append((x, b[j][2]))
                j += 1
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, at = [], 0
        ia = ib = 0
        for end in ends:
            own = [[], []]
            while ia < len(a) and a[ia][1] <= end:
                own[0].append(str(a[ia][2]))
                ia += 1
            while ib < len(b) and b[ib][1] <= end:
                own[1].append(str(b[ib][2]))
                ib += 1
            groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
            at = end
        made.append((len(a), len(b), groups, links))
        counts.update(links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if m is None else (m[0], m[1], len(m[2]), len(m[3]), sum(counts[p] == top[p[1]] for p in m[3]), sum(counts[p] for p in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest())
        for m in made
    ]


TEXTS = [
    " leading", "trailing ", "  two  spaces  ", "a\n\n  b\tc \n d", "<|endoftext|> </s><s> x", "low▁line", "日本語 テキスト 🙂🙂", "é  x\u0085 y\x1c z", "it's we'll I'D", "a", " ", "   ", "\n", "\r\n x\r", "0123 456", "a  b", "a 　 b",
    "ｆｕｌｌ", "\x00 nul", "x" * 3000 + " " + "ab" * 900,
]


def test_whole_table_and_odd_texts_against_whole_encoding(spark, sf):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "é", "7", ".", "🙂", "the", " of"]) for _ in range(60)) for _ in range(60)]
    texts = [t for _, t in odd_texts()] + TEXTS + mixed + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = rows(spark, list(enumerate(texts))).repartition(3)
    want = plain(texts)
    assert sum(w[0] == 0 for w in want) == 3  # null, empty, and one with the sign that stands for a space
    for limit in (1 << 30, 0):
        out = align_tokens(docs, table_limit=limit)
        assert out.columns == ["doc_id", *COLUMNS]
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
        wrong = [k for k in range(len(texts)) if got[k] != want[k]]
        assert len(got) == len(texts) and not wrong, [(texts[k][:40], got[k], want[k]) for k in wrong[:3]]


def test_repeated_null_and_no_rows(spark):
    docs = rows(spark, [(None, "one two"), (None, "one two"), (4, None), (4, "")])
    for limit in (1 << 30, 0):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in align_tokens(docs, table_limit=limit).collect())
        assert got == sorted(plain(["one two", "one two", None, ""]))
        assert align_tokens(docs.limit(0), table_limit=limit).count() == 0
        assert align_tokens(docs.filter("text is null"), table_limit=limit).collect()[0].n_a == 0


def test_pieces_give_back_the_text():
    for t in [x for x in TEXTS if x]:
        assert "".join(" " + p for p in pieces_of(t)) == " " + t


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        by = PerfectHash.from_bytes(PerfectHash.of(keys).to_bytes())
        assert sorted(by(keys)) == list(range(len(keys)))
        strange = by(rng.integers(-(1 << 62), 1 << 62, 500))
        assert ((strange >= -1) & (strange < max(len(keys), 1))).all()
