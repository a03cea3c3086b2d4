"""Conversations as marked text with tokens and a mask of what a model learns from.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its learned texts are cut with the spans of its tokens by binary
search. Marks are special tokens of the tokenizer, so no token reaches from a
mark into a text. Control strings within roles and texts are escaped with a
backslash after their first character; what already looks like an escaped one
gets a further backslash, so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART_CHARS = 8 << 20  # a longer conversation comes in several rows, cut between turns


@dataclass(frozen=True)
class Template:
    """Marks before a role, between role and text and after a text; further control strings; roles whose texts are learned."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        heads = {c[:1] for c in self.strings}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in self.strings):
            raise ValueError("a control string has two characters or more, no backslash, and the first character of none but at its start")

    @property
    def strings(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.control)

    @cached_property
    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """First characters of control strings with any number of backslashes between, and those with the first of the backslashes."""
        tails: dict[str, list[str]] = {}
        for c in self.strings:
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        made = lambda taken: re.compile("|".join(re.escape(h) + taken + rf"(?=\\*(?:{'|'.join(t)}))" for h, t in tails.items()))
        return made(""), made(r"\\")

    def escaped(self, text: str) -> str:
        """Without control strings; one more backslash in each place that reads as one, with or without backslashes."""
        return self.patterns[0].sub(lambda m: m[0] + "\\", text)

    def unescaped(self, text: str) -> str:
        return self.patterns[1].sub(lambda m: m[0][0], text)

    def turns(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts of a rendered conversation."""
        out = []
        for turn in text.split(self.turn)[1:]:
            role, said = turn.removesuffix(self.end).split(self.text)
            out.append((self.unescaped(role), self.unescaped(said)))
        return out


class Formatter:
    """Renders, encodes and masks conversations in one task."""

    def __init__(self, tokenizer: bytes, template: Template):
        from tokenizers import AddedToken, Tokenizer
        from tokenizers.processors import ByteLevel

        self.template = template
        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        self.tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in template.strings])
        if self.tokenizer.post_processor is None or isinstance(self.tokenizer.post_processor, ByteLevel):
            self.tokenizer.post_processor = ByteLevel(trim_offsets=False)

    def rendered(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text, and the spans of the learned texts in it that aren't empty."""
        t, out, at, spans = self.template, [], 0, []
        for role, said in turns:
            head = t.turn + t.escaped(role) + t.text
            body = t.escaped(said)
            if role in t.learned and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, t.end]
            at += len(head) + len(body) + len(t.end)
        return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)

    def formatted(self, conversations: list[list[tuple[str, str]]]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, token ids, token spans and mask of each conversation."""
        made = [self.rendered(c) for c in conversations]
        out = []
        for (text, spans), encoding in zip(made, self.tokenizer.encode_batch([t for t, _ in made], add_special_tokens=False), strict=True):
            ids, offsets = np.array(encoding.ids, dtype=np.int32), np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
            # tokens that end after a span's start and begin before its end
            first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
            last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
            steps = np.bincount(first, minlength=len(ids) + 1) - np.bincount(last, minlength=len(ids) + 1)
            out.append((text, ids, offsets, np.cumsum(steps)[:-1] > 0))
        return out


_MADE = "part int, n_turns long, text string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template(), tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows id_col, part, n_turns, text, token_ids, token_starts, token_ends (code points of text) and loss_mask.

    Turns come by turn_col, nulls first; equal turns by role and text. A null
    role or text is empty; rows without an id are one conversation; repeated
    rows count each time. A conversation of more than part_chars comes as parts
    0, 1, ... cut between turns, where marks keep tokens apart anyway, so a
    task holds no more than one part; parts of a conversation follow each
    other in the result. An empty table gives an empty one. Other columns,
    whatever their names, are left aside.
    """
    held = rows.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    id_type = rows.schema[id_col].dataType
    own = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = own.repartition("id").sortWithinPartitions("id", "turn", "role", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(held.value, template)
        id_field, waiting, turns, at, part, chars, held_chars = None, [], [], None, 0, 0, 0

        def written() -> pa.RecordBatch:
            made = formatter.formatted([w[2] for w in waiting])
            lists = lambda column, kind: pa.array([m for m in column], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in waiting], id_field), pa.array([w[1] for w in waiting], pa.int32()), pa.array([len(w[2]) for w in waiting], pa.int64()), pa.array([m[0] for m in made], pa.string()),
                 lists((m[1] for m in made), pa.int32()), lists((m[2][:, 0] for m in made), pa.int32()), lists((m[2][:, 1] for m in made), pa.int32()), lists((m[3] for m in made), pa.bool_())],
                names=[id_col, "part", "n_turns", "text", "token_ids", "token_starts", "token_ends", "loss_mask"],
            )

        for batch in batches:
            id_field = batch.schema.field("id").type
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("id", "role", "text"))
            for conversation, role, text in zip(ids, roles, texts, strict=True):
                is_new = not turns or conversation != at
                if turns and (is_new or chars > part_chars):
                    waiting.append((at, part, turns))
                    held_chars += chars
                    turns, part, chars = [], 0 if is_new else part + 1, 0
                    if held_chars > 1 << 18:
                        yield written()
                        waiting, held_chars = [], 0
                at = conversation
                turns.append((role, text))
                chars += len(role) + len(text)
        if turns:
            waiting.append((at, part, turns))
        if waiting:
            yield written()

    return ordered.mapInArrow(make, f"`{id_col}` {id_type.simpleString()}, {_MADE}")


def loss_runs(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """What the tokens under the mask cover, as runs of text; tokens that share a character cover it once."""
    out, at = [], -1
    begin = None
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if begin is None or s > at:
            if begin is not None:
                out.append(text[begin:at])
            begin, at = s, e
        at = max(at, e)
    if begin is not None:
        out.append(text[begin:at])
    return out


def read_back(formatted: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Digests of formatted conversations from their text, token spans and mask alone: id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The parts of a conversation must follow each other, as format_conversations
    gives them. turns_sha256 is of role, line feed, text, line feed for each
    turn, loss_sha256 of the unescaped text under the mask.
    """
    id_type = formatted.schema[id_col].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, id_field = None, None

        def closed() -> pa.RecordBatch:
            key, n, turns, chars, loss, size = row
            return pa.RecordBatch.from_arrays([pa.array([key], id_field), *(pa.array([x], k) for x, k in ((n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64())))], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        done: list[pa.RecordBatch] = []
        for batch in batches:
            id_field = batch.schema.field("id").type
            starts, ends, masks = (batch.column(c) for c in ("token_starts", "token_ends", "loss_mask"))
            for k, (key, part, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "part", "text")), strict=True)):
                if part == 0:
                    if row:
                        done.append(closed())
                    row = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.turns(text):
                    row[1] += 1
                    row[2].update(f"{role}\n{said}\n".encode())
                mask = starts[k].values.to_numpy(), ends[k].values.to_numpy(), masks[k].values.to_numpy(zero_copy_only=False)
                for run in loss_runs(text, *mask):
                    said = template.unescaped(run)
                    row[3] += len(said)
                    row[4].update(said.encode())
                row[5] += len(text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if row:
            yield closed()

    own = formatted.select(F.col(id_col).alias("id"), "part", "text", "token_starts", "token_ends", "loss_mask")
    return own.mapInArrow(read, f"`{id_col}` {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
