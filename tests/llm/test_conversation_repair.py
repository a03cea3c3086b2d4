import hashlib
import random
import re
import zlib

from steadyield.llm.conversation_repair import cheapest_edits, damaged, repair_damaged, repaired_turns

LAW = re.compile(r"(s?(ua)+)?")
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """rows of (initial, fault): the least (cost, audit) over all beginnings, with at most two inserted turns in a gap; audits as tuples."""
    best = {"": (0, "", "")}

    def offer(table, state, cost, audit, roles):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, roles)

    def with_inserts(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, audit, roles) in list(out.items()):
                letter = "a" if state == "u" else "u"
                offer(out, letter, cost + 3, audit + "I", roles + letter)
        return out

    for initial, fault in rows:
        new = {}
        for state, (cost, audit, roles) in with_inserts(best).items():
            offer(new, state, cost + 4, audit + "D", roles)
            if fault < 2:
                if (state, initial) in AFTER:
                    offer(new, AFTER[state, initial], cost + 3 * fault, audit + "K", roles + initial)
                letter = "a" if state == "u" else "u"
                offer(new, letter, cost + 3 + 3 * fault, audit + "R", roles + letter)
        best = new
    cost, audit, roles = min(v for s, v in with_inserts(best).items() if s in ("", "a"))
    assert LAW.fullmatch(roles)
    return cost, audit


def test_least_cost_and_first_audit():
    rng = random.Random(4)
    for n in [*range(9)] * 60 + [40, 41, 300]:
        rows = [(rng.choice("suaux"), rng.choice((0, 0, 0, 1, 2))) for _ in range(n)]
        cost, edits = cheapest_edits(bytes("sua".find(i) + 4 * f if i in "sua" else 3 + 4 * f for i, f in rows))
        assert (cost, "".join(edits)) == plain(rows)
        assert len(edits) == n + 1


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out.setdefault(c, [])
        if kind:
            said = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[c] += [(t, "user" if kind == 4 else role, said)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def report(rows):
    seen, faults, marks = set(), [], []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(3 if not body else 2 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
        marks.append((role[:1], min(faults[-1], 2)))
    cost, audit = plain(marks)
    lines, at, last = [], 0, ""
    for letter in audit:
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        new = "assistant" if last == "u" else "user"
        lines.append(f"{role}:{text}" if letter == "K" else f"{new}:" + ("" if letter == "I" else text))
        last = lines[-1][0]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(3), faults.count(2), faults.count(1), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(spark):
    rng, data = random.Random(9), []
    for c in range(300):
        turns = rng.sample(range(-3, 40), rng.randrange(1, 12))
        data += [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "Yes.", "No!\n ", "why", " \t", "", None, "é?", "a.b"])) for t in turns]
    data += [(900, None, "user", "one."), (None, 1, "user", "hello."), (None, 2, "assistant", "there.")]
    data += [(901, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(9000)]
    rows = spark.createDataFrame([(*d, "x", 5, "y", 6) for d in data], "conv_id long, turn long, role string, text string, id string, copy int, first string, fault int")
    return data, rows.repartition(4)


def test_reports_against_plain_repair(spark):
    data, rows = conversations(spark)
    out = repair_damaged(rows)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    want = {c: report(v) for c, v in damage(data).items()}
    assert any(not v for v in damage(data).values())
    assert got == want


def test_repaired_turns_follow_the_law(spark):
    _, rows = conversations(spark)
    digests = {r.conv_id: r.repaired_sha256 for r in repair_damaged(rows).collect()}
    turns = {}
    for r in repaired_turns(damaged(rows)).orderBy("id", "at").collect():
        turns.setdefault(r.id, []).append((r.role, r.text))
    for c, own in turns.items():
        assert LAW.fullmatch("".join(r[0] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == digests[c]


def test_no_rows_and_repeated_ones(spark):
    _, rows = conversations(spark)
    assert repair_damaged(rows.limit(0)).count() == 0
    twice = rows.filter("conv_id < 50").unionByName(rows.filter("conv_id < 50"))
    got = {r.conv_id: r for r in repair_damaged(twice).collect()}
    assert len(got) == 50
    assert sum(r.duplicate for r in got.values()) > 100
