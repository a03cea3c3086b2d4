"""Repairing the order of roles in conversations at the least cost.

Rows are kept, given another role, deleted, or empty ones inserted until the
roles are an optional system turn and then user and assistant in turn. The
cheapest edits, of equal ones those whose initials come first in ASCII, are
found by divide and conquer: costs of reaching each of four states from the
front meet costs of finishing from them from the back in the middle of the
conversation, the best crossing is fixed and both halves are done alike. So a
conversation needs one byte a row and vectors of four.

Crossings lie right behind a row. The edits up to there differ between states
before the shorter ends, since all of them use up the same rows and end with
one, so it is enough to rank the four beginnings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What has been read: nothing, the system turn, a user's turn, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: States in which a conversation may end.
DONE = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_AFTER = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
INITIALS = "sua"  # a row's kind is the place of its initial (3: another) plus 4 times its fault: none, truncated, or to be deleted
END = 12  # kind of the end, which only DONE states pass
AUDIT_ROWS = 4096  # edits of so many rows stand in one row of audits


def _moves() -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each kind of row: the cheapest edits, first in ASCII, from one state to another that use the row up."""
    out = []
    for kind in range(END + 1):
        initial, fault = INITIALS[kind % 4 : kind % 4 + 1] if kind % 4 < 3 else "", kind // 4
        best = {}
        for start in range(4):
            state, cost, letters = start, 0, ""
            # two inserted turns reach every state that any number does
            for _ in range(3):
                extra = TRUNCATED if fault == 1 else 0
                if kind == END:
                    offers = [(state, cost, letters)] if state in DONE else []
                else:
                    offers = [(state, cost + DELETE, letters + "D")]
                    if fault < 2:
                        offers += [(NEXT[state, "ua"[state == USER]], cost + REROLE + extra, letters + "R")]
                        offers += [(NEXT[state, initial], cost + KEEP + extra, letters + "K")] if (state, initial) in NEXT else []
                for to, c, edits in offers:
                    best[start, to] = min(best.get((start, to), (c, edits)), (c, edits))
                state, cost, letters = NEXT[state, "ua"[state == USER]], cost + INSERT, letters + "I"
        out.append(best)
    return out


MOVES = _moves()
_LISTED = [[(s, t, c, e) for (s, t), (c, e) in m.items()] for m in MOVES]
_NONE = 1 << 60


def _forward(kinds: bytes, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Cost of each state behind row hi - 1 from a state before row lo, and the rank of its first cheapest edits among the four."""
    cost, rank = [_NONE] * 4, [0] * 4
    cost[start] = 0
    for k in range(lo, hi):
        new, how = [_NONE] * 4, [None] * 4
        for s, t, c, edits in _LISTED[kinds[k]]:
            total = cost[s] + c
            if total < _NONE and (total < new[t] or (total == new[t] and (rank[s], edits) < how[t])):
                new[t], how[t] = total, (rank[s], edits)
        order = sorted([h for h in how if h is not None])
        cost, rank = new, [order.index(h) if h is not None else 0 for h in how]
    return cost, rank


def _backward(kinds: bytes, lo: int, hi: int, end: int) -> list[int]:
    """Cost of getting from each state before row lo to a state behind row hi - 1."""
    cost = [_NONE] * 4
    cost[end] = 0
    for k in range(hi - 1, lo - 1, -1):
        new = [_NONE] * 4
        for s, t, c, _ in _LISTED[kinds[k]]:
            new[s] = min(new[s], cost[t] + c)
        cost = new
    return cost


def cheapest_edits(kinds: bytes) -> tuple[int, list[str]]:
    """Least cost of repairing rows of these kinds, and the edits of each row: those inserted before it, then its own; the last entry is what is inserted at the end."""
    rows = kinds + bytes([END])
    total, rank = _forward(rows, 0, len(rows), START)
    final = min((t for t in DONE if total[t] < _NONE), key=lambda t: (total[t], rank[t]))
    edits: list[str] = [""] * len(rows)
    todo = [(0, len(rows), START, final)]
    while todo:
        lo, hi, start, end = todo.pop()
        if hi - lo == 1:
            edits[lo] = MOVES[rows[lo]][start, end][1]
            continue
        mid = (lo + hi) // 2
        front, order = _forward(rows, lo, mid, start)
        back = _backward(rows, mid, hi, end)
        cross = min(range(4), key=lambda s: (front[s] + back[s], order[s]))
        todo += [(lo, mid, start, cross), (mid, hi, cross, end)]
    return total[final], edits


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turn, role, text, copy) with planted faults, by crc32 of id:turn modulo 20; a null counts as one space, but stays one in id and turn."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(F.concat(as_text(id_col), F.lit(":"), as_text(turn_col))) % 20).alias("fault"))
    fault = F.col("fault")
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = own.filter(fault != 0).withColumns({"text": said, "role": F.when(fault == 4, "user").otherwise(F.col("role")), "first": F.xxhash64("role", "text")})
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return made.select("id", "turn", "role", "text", "first", copies)


_ORDER = ("turn", "first", "copy")
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LAWFUL = ("su", "ua", "au")


def audits(rows: DataFrame) -> DataFrame:
    """Figures and edits of each conversation, AUDIT_ROWS rows' edits in one row (id, part, edits, figures); edits are comma-joined.

    What is shuffled has no texts: a text's hash tells repeated ones.
    """
    blank, whole = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    light = rows.select("id", *_ORDER, F.left("role", F.lit(1)).alias("initial"), said.alias("said"), F.when(blank, 3).when(~whole, 1).otherwise(0).alias("fault")).repartition("id")
    earlier = Window.partitionBy("id", "said").orderBy(*_ORDER)
    marked = light.withColumn("fault", F.when((F.col("fault") != 3) & (F.row_number().over(earlier) > 1), 2).otherwise(F.col("fault")))
    id_type = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_field, key, kinds, counts, turns, illegal, before = None, None, bytearray(), [0] * 4, None, 0, None
        out: list[tuple] = []

        def close() -> None:
            cost, edits = cheapest_edits(bytes(kinds))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            for part, at in enumerate(range(0, len(edits), AUDIT_ROWS)):
                out.append((key, part, ",".join(edits[at : at + AUDIT_ROWS]), gaps, counts[3], counts[2], counts[1], illegal, cost))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [id_field, pa.int64(), pa.string(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "part", "edits", *_FIGURES])

        for batch in batches:
            id_field = batch.schema.field("id").type
            for conversation, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "initial", "fault")), strict=True):
                if kinds and conversation != key:
                    close()
                    kinds, counts, turns, illegal, before = bytearray(), [0] * 4, None, 0, None
                    if len(out) > 2000:
                        yield batch_of()
                        out.clear()
                key = conversation
                kinds.append((INITIALS.find(initial) if initial and initial in INITIALS else 3) + 4 * min(fault, 2))
                counts[fault] += 1
                illegal += before is not None and before + initial not in _LAWFUL
                before = initial
                if turn is not None:
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
        if kinds:
            close()
        if out:
            yield batch_of()

    ordered = marked.sortWithinPartitions("id", *_ORDER).select("id", "turn", "initial", "fault")
    return ordered.mapInArrow(read, f"id {id_type}, part long, edits string, " + ", ".join(f"{c} long" for c in _FIGURES))


class _Repaired:
    """A conversation's repaired turns as its rows pass by."""

    def __init__(self) -> None:
        self.state, self.edits, self.at = START, [], 0

    def step(self, role: str | None, text: str | None) -> list[tuple[str, str]]:
        """Turns that a row gives: those inserted before it and, unless it is deleted, itself; without a row those at the end."""
        out = []
        for letter in self.edits[self.at]:
            if letter == "D":
                continue
            if letter == "K":
                self.state = NEXT[self.state, role[:1]]
                out.append((role, text))
            else:
                out.append((ROLE_AFTER[self.state], "" if letter == "I" else text))
                self.state = USER if out[-1][0] == "user" else ASSISTANT
        self.at += 1
        return out


def _passing(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order, side by side in one partition."""
    heads = edits.select("id", F.lit(False).alias("is_row"), "part", F.struct("edits", *_FIGURES).alias("head"))
    own = rows.select("id", F.lit(True).alias("is_row"), F.lit(0).cast("long").alias("part"), *_ORDER, "role", "text")
    both = own.unionByName(heads, allowMissingColumns=True)
    return both.repartition("id").sortWithinPartitions("id", "is_row", "part", *_ORDER).select("id", "is_row", "part", "head", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    state, digest, key, figures, n, id_field = None, None, None, None, 0, None
    out: list[tuple] = []
    names = ["id", "at", "role", "text"] if turns else ["id", *_FIGURES, "audit", "repaired_sha256"]
    kinds = [pa.int64(), pa.string(), pa.string()] if turns else [*[pa.int64()] * 6, pa.string(), pa.string()]

    def take(made: list[tuple[str, str]]) -> None:
        nonlocal n
        for role, text in made:
            if turns:
                out.append((key, n, role, text))
            else:
                digest.update((("\n" if n else "") + f"{role}:{text}").encode())
            n += 1

    def close() -> None:
        take(state.step(None, None))
        if not turns:
            out.append((key, *figures, "".join(state.edits), digest.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [id_field, *kinds], strict=True)], names=names)

    for batch in batches:
        id_field = batch.schema.field("id").type
        for conversation, is_row, part, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "is_row", "part", "head", "role", "text")), strict=True):
            if is_row:
                take(state.step(role, text))
                continue
            if part == 0:
                if state:
                    close()
                state, digest, key, n, figures = _Repaired(), hashlib.sha256(), conversation, 0, [head[c] for c in _FIGURES]
            state.edits += head["edits"].split(",")
        if out:
            yield batch_of()
            out.clear()
    if state:
        close()
    if out:
        yield batch_of()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows (id, at, role, text), `at` from 0; see repair_reports for what rows are."""
    return _passing(rows, audits(rows)).mapInArrow(lambda b: _streamed(b, True), f"id {rows.schema['id'].dataType.simpleString()}, at long, role string, text string")


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (id, turn, role, text, first, copy): gaps, faults, illegal neighbours, cost, audit and the digest of its repaired turns.

    Rows go by the integer turn, nulls first, then by `first`, a hash of what
    they were, and copy; rows without an id are one conversation; role and
    text aren't null; repeated rows are duplicates. An empty table gives an
    empty one. A conversation's texts are never held together: its edits come
    before its rows, which pass by in order, so a task needs some bytes a row.
    """
    kinds = ", ".join(f"{c} long" for c in _FIGURES)
    return _passing(rows, audits(rows)).mapInArrow(lambda b: _streamed(b, False), f"id {rows.schema['id'].dataType.simpleString()}, {kinds}, audit string, repaired_sha256 string")


def repair_damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reports of all conversations after planted damage; one that lost all its rows has zeros, an empty audit and the digest of nothing."""
    ids = rows.select(F.col(id_col).alias("conv")).distinct()
    reports = repair_reports(damaged(rows, id_col, turn_col, role_col, text_col))
    met = ids.join(reports, F.col("conv").eqNullSafe(F.col("id")), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FIGURES]
    return met.select(F.col("conv").alias(id_col), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
