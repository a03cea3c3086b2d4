"""Quality rules as a short-circuit cascade.

Every rule rejects documents on its own measure of the whole text. Before the
run, each rule is timed on a bounded sample, which also tells how many
documents it rejects. Rules then run in the order of rejections per second of
cost, and a rule only sees the documents that all rules before it accepted.
The order changes the cost alone: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and is rejected; repeated
rows are judged one by one and alike; an empty table gives an empty result;
columns other than the text pass through unread; the longest text is measured
whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.llm.textops import LINE_CODE, Texts, Words, line_starts_of, mix, repeats_an_earlier, slices, span_hashes, texts_of, windows_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, dtype=bool)
_IS_LOWER[97:123] = True
_IS_LETTER = _IS_UPPER | _IS_LOWER
_IS_LETTER[128:] = True
_OPENS_CHAR = np.ones(256, dtype=bool)
_OPENS_CHAR[128:192] = False
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


class Measures:
    """Measures of some documents, each computed once and only when a rule asks for it."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self._kept: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def copy(self) -> Measures:
        other = Measures(self.texts)
        other._kept = dict(self._kept)
        return other

    def at(self, rows: np.ndarray) -> Measures:
        """Measures of some of the documents; what is known of them stays known."""
        part = Measures(self.texts.take(rows))
        for name, known in self._kept.items():
            if isinstance(known, Words):
                to = np.full(len(self.texts), -1)
                to[rows] = np.arange(len(rows))
                doc = to[known.doc]
                here = doc >= 0
                doc, moved = doc[here], self.texts.offsets[:-1][rows] - part.texts.offsets[:-1]
                part._kept[name] = Words(known.starts[here] - moved[doc], doc, known.hashes[here], np.searchsorted(doc, np.arange(len(rows) + 1)))
            else:
                part._kept[name] = tuple(x[rows] for x in known) if isinstance(known, tuple) else known[rows]
        return part

    @property
    def words(self) -> Words:
        return self._once("words", lambda: words_of(self.texts))

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts()

    @property
    def word_chars(self) -> np.ndarray:
        return self._once("word_chars", lambda: self.texts.per_doc((_IN_WORD & _OPENS_CHAR)[self.texts.data]))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: self.texts.per_doc(_IS_SYMBOL[self.texts.data]))

    @property
    def n_upper(self) -> np.ndarray:
        return self._once("n_upper", lambda: self.texts.per_doc(_IS_UPPER[self.texts.data]))

    @property
    def n_lower(self) -> np.ndarray:
        return self._once("n_lower", lambda: self.texts.per_doc(_IS_LOWER[self.texts.data]))

    @property
    def n_lettered(self) -> np.ndarray:
        """Words that hold a letter; any character beyond ASCII counts as one."""

        def make() -> np.ndarray:
            words = self.words
            if not len(words.starts):
                return np.zeros(len(self.texts), np.int64)
            has = np.logical_or.reduceat(_IS_LETTER[self.texts.data], words.starts)
            return np.bincount(words.doc[has], minlength=len(self.texts))

        return self._once("n_lettered", make)

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: lines with a word, and those of them equal to an earlier line."""

        def make() -> tuple[np.ndarray, np.ndarray]:
            starts = line_starts_of(self.texts)
            if not len(starts):
                return np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
            doc = np.searchsorted(self.texts.offsets, starts, side="right") - 1
            full = np.logical_or.reduceat(_IN_WORD[self.texts.data], starts)
            keys = span_hashes(self.texts.data, LINE_CODE, starts)[full]
            doc = doc[full]
            again, _ = repeats_an_earlier(mix(keys + doc.astype(np.uint64)))
            return np.bincount(doc, minlength=len(self.texts)), np.bincount(doc[again], minlength=len(self.texts))

        return self._once("lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words that lie in a three-word window found twice or more in the document."""

        def make() -> np.ndarray:
            value, at = windows_of(self.words, 3)
            doc = self.words.doc
            _, often = repeats_an_earlier(mix(value + doc[at].astype(np.uint64)))
            covered = np.zeros(len(doc), dtype=bool)
            for k in range(3):
                covered[at[often] + k] = True
            return np.bincount(doc[covered], minlength=len(self.texts))

        return self._once("n_repeat_words", make)


@dataclass(frozen=True)
class Rule:
    """A name and a test that is true for the documents to reject."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


def production_rules() -> list[Rule]:
    """Thresholds leave wide room on the clean side: a rule should fire on junk, not on odd prose."""
    return [
        Rule("too_short", lambda m: m.n_words < MIN_WORDS),
        Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
        Rule("symbol_heavy", lambda m: 4 * m.n_symbols > m.n_words),
        Rule("shouting", lambda m: (m.n_upper > m.n_lower) & (4 * m.n_upper > m.word_chars)),
        Rule("few_lettered_words", lambda m: 2 * m.n_lettered < m.n_words),
        Rule("repeated_lines", lambda m: 2 * m.lines[1] > np.maximum(m.lines[0], 4)),
        Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
    ]


BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", known: tuple[str, ...] = (), sample_rows: int = 1000, sample_fraction: float = 0.02) -> list[str]:
    """Names of the rules, most rejections per second of cost first.

    A rule's cost and rejections are those on what the rules before it leave of
    the sample, with their measures and those named in known at hand. The
    sample is a random sample of the rows, cut at sample_rows rows and at
    20,000 characters of each text. It decides the order and nothing else.
    """
    sample = docs.select(F.substring(F.col(text_col), 1, 20_000).alias("t")).sample(sample_fraction, seed=7).limit(sample_rows).collect()  # reads as many partitions as it needs
    m = Measures(texts_of(pa.array([t or "" for (t,) in sample], pa.large_string())))
    for name in known:
        getattr(m, name)
    left, order = list(rules), []
    while left and len(m.texts):
        tried = []
        for place, rule in enumerate(left):
            trial, began = m.copy(), time.perf_counter()
            bad = rule.rejects(trial)
            cost = max(time.perf_counter() - began, 1e-6)
            tried.append((-(np.count_nonzero(bad) + 0.5) / cost, place, bad, trial))
        _, place, bad, m = min(tried, key=lambda t: t[:2])
        order.append(left.pop(place).name)
        m = m.at(np.flatnonzero(~bad))
    return order + [r.name for r in left]


def run_cascade(m: Measures, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Which documents are kept, and for the others the position of the rule that rejected first (else -1); a rule measures what is left alone."""
    alive, by = np.arange(len(m.texts)), np.full(len(m.texts), -1)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(m)
        by[alive[bad]] = k
        if bad.any():
            alive, m = alive[~bad], m.at(np.flatnonzero(~bad))
    return by < 0, by


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Measures and verdict of every document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by."""
    rules = production_rules() if rules is None else rules
    order = plan_cascade(docs, rules, text_col, BASE_MEASURES)
    names = [r.name for r in sorted(rules, key=lambda r: order.index(r.name))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in rules}
        ordered = [by_name[n] for n in names]
        for whole in batches:
            for batch in slices(whole, "t"):
                m = Measures(texts_of(batch.column("t")))
                for name in BASE_MEASURES:  # wanted of all rows
                    getattr(m, name)
                kept, by = run_cascade(m, ordered)
                base = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.lines[1], m.n_repeat_words)), pa.array(base), pa.array(kept & ~base), pa.array([names[k] if k >= 0 else None for k in by], pa.string())],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(judge, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule accepts, with their own columns; the cascade stops at a row's first rejection."""
    rules = production_rules() if rules is None else rules
    order = plan_cascade(docs, rules, text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = sorted(rules, key=lambda r: order.index(r.name))
        for whole in batches:
            for batch in slices(whole, text_col):
                kept, _ = run_cascade(Measures(texts_of(batch.column(text_col))), ordered)
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(sift, docs.schema)
