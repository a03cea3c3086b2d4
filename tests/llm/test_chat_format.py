import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from steadyield.llm.chat_format import Template, format_conversations, read_back

T = Template()
ROWS = "conv_id long, turn long, role string, text string, id string, part int, n_turns long"
BITS = ["<", "|", "<|turn|>", "<|text|>", "<|end|>", "<\\|end|>", "<\\\\|end|>", "<|endoftext|>", "</s>", "<s>", "[INST]", "[\\INST]", "[/INST]", "\\", " ", "\n", "🙂", "日本", "é", "ok", "[", "/"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    size = sum(len(T.turn + T.text + T.end) + len(T.escaped(r)) + len(T.escaped(t)) for r, t in turns)
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), size


@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    made = T.escaped(text)
    assert T.unescaped(made) == text and not any(c in made for c in T.strings)


def test_template_refuses_what_could_not_be_read_back():
    for bad in ("x", "<|<|>", "<\\end>"):
        with pytest.raises(ValueError):
            Template(end=bad)


def conversations(spark):
    rng, data = random.Random(8), []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            data.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "</s>role"]), "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 14)))))
    data += [(100, None, None, None), (100, 1, "assistant", ""), (100, 1, "assistant", "same"), (100, 1, "assistant", "same"), (None, 0, "user", "u"), (None, 1, "assistant", "v"), (101, 0, "assistant", "word \n" * 9000)]
    return data, spark.createDataFrame([(*d, "x", 7, 8) for d in data], ROWS).repartition(3)


def test_read_back_equals_what_went_in(spark):
    data, rows = conversations(spark)
    want = {}
    for c, t, r, x in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or 0, d[2] or "", d[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    for size in (8 << 20, 30):
        got = {r[0]: tuple(r[1:]) for r in read_back(format_conversations(rows, part_chars=size)).collect()}
        assert got == {c: plain(t) for c, t in want.items()}


def test_parts_have_the_tokens_of_the_whole(spark):
    _, rows = conversations(spark)
    whole = {r.conv_id: r for r in format_conversations(rows).collect()}
    parts = {}
    for r in format_conversations(rows, part_chars=30).collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert max(map(len, parts.values())) > 3
    for c, own in parts.items():
        own.sort(key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(own)))
        assert sum((r.token_ids for r in own), []) == whole[c].token_ids and sum((r.loss_mask for r in own), []) == whole[c].loss_mask


def test_no_rows_and_ids_of_text(spark):
    _, rows = conversations(spark)
    assert read_back(format_conversations(rows.limit(0))).count() == 0
    named = rows.selectExpr("concat('c', conv_id) as conv_id", "turn", "role", "text")
    assert {r.conv_id for r in read_back(format_conversations(named)).collect()} >= {"c0", None, "c101"}
