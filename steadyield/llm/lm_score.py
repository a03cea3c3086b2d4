"""Language-model scores by online logistic context mixing.

Texts, lower-cased in A-Z, are predicted bit by bit. A byte is a few binary
decisions down a prefix code over all 256 byte values (the end of a text is one
that UTF-8 does not use); the byte before selects the code. Three predictors
know how often a decision fell to 0 and to 1 after a context: the two bytes
before, the four bytes before, and, where a word may begin, the two words
before. How often and with what odds, in coarse steps,
is a state, and each state has its own log odds, learned from all decisions of
the training texts, each left out of the counts that it meets. The odds are
summed with weights that a gate selects by the states of the longer contexts.
Weights are first learned from all decisions of the training texts, each left
out of its own counts: every block says which states met before which bit and
how often, which is all that Newton's method needs. Then they are refined
within every text after each of its stretches, so a text's score depends on the
model and the text alone. The bits of all decisions are the bits of the text.

Counts come from all training texts, whole. A context is known by a hash whose
bits grow with the corpus, 32 to 64 slots for each of its bytes (up to 48 bits). What is counted is
pairs of context and byte: each block of texts says which pairs it holds and
how often its training texts do, pairs meet in a shuffle, dealt over parts
whose number grows with the corpus, and the states of the decisions on the way
to each pair's byte go back to the blocks that asked. No task holds the counts
of all contexts, and a block asks for a pair once, however often it holds it.
The words of the base score go the same way, by 64-bit hashes.

Defined results: a null or empty text has its end as only token and byte; a
null id counts as the empty text in the split and its row is scored; equal
texts get equal scores, whatever their ids; without training texts all
predictors say one half; an empty table gives an empty result; texts are
scored whole.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut
from steadyield.llm.textops import U64, Texts, _power_tables, mix, slices, texts_of

FOLDS = 10
END = 255  # no byte of UTF-8
PAD = 4
CONTEXTS = 3
LEVELS = 15  # decisions of a byte at most
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 19
SORTED_BYTES = 1 << 20  # of texts whose pairs are sorted at once
PART_BYTES = 16 << 20  # of texts, for each part of the contexts
SLOT_BITS = 5  # slots for each byte of the corpus, as a power of 2
NEWTON = 4
ENTRIES = 600_000  # of a part that are added up at once
SEEN = (1, 2, 3, 5, 10, 31, 201, 2001, 20_001, 200_001, 2_000_001, 20_000_001)  # where the coarse steps of how often a decision was seen begin
KINDS = len(SEEN) + 1
BINS = 32  # of log odds from -8 to 8
STATES = KINDS * BINS
GATES = 2 * KINDS * KINDS  # within words and where they begin


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32, END]] = True
_CODE = mix(np.arange(5000, 5256, dtype=U64)) | U64(1)
_SALT = mix(np.arange(9001, 9006, dtype=U64))
_TRIES = mix(np.arange(7001, 7005, dtype=U64)) | U64(1)
END_WORD = U64(0x5E0FD0C5E0FD0C5)
# how many bits stand before the last set bit of 16
_LENGTH = np.array([0] + [LEVELS - ((x & -x).bit_length() - 1) for x in range(1, 1 << 16)], dtype=np.uint8)


def fold_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS


def teaches(doc_id, text: bytes, share: float) -> bool:
    """Is this training row, by its id and text, one of those that teach weights?"""
    return zlib.crc32(text, zlib.crc32(f"w{doc_id}".encode())) < share * 2**32


def code_lengths(weight: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code."""
    heap = [(float(w), k) for k, w in enumerate(weight)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(weight) - 1, dtype=np.int64)
    for inner in range(len(weight), 2 * len(weight) - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = inner
        heapq.heappush(heap, (a + b, inner))
    depth = np.zeros(len(parent), dtype=np.int64)
    for k in range(len(parent) - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[: len(weight)]


def prefix_code(weight: np.ndarray) -> np.ndarray:
    """The code word of each symbol in 16 bits: its decisions, at most LEVELS, then a 1 and zeros."""
    floor = weight.sum() / 2**14 + 0.01
    while (length := code_lengths(weight + floor)).max() > LEVELS:
        floor *= 2
    words, at = np.zeros(len(weight), dtype=np.uint16), 0
    for k in np.lexsort((np.arange(len(weight)), length)):
        words[k] = at | 1 << (LEVELS - length[k])
        at += 1 << (LEVELS + 1 - length[k])
    return words


def codes_of(histogram: np.ndarray) -> np.ndarray:
    """The code words of all bytes, a row for each byte before, from how often the training texts hold each pair of bytes."""
    rare = prefix_code(histogram.sum(axis=0))
    return np.stack([prefix_code(row + 0.01 * histogram.sum(axis=0) / max(1, histogram.sum())) if row.any() else rare for row in histogram])


@dataclass
class Numbered:
    """Keys, distinct unless said otherwise, and of each key given its number."""

    key: np.ndarray
    number: np.ndarray


def met_first(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that stand for the distinct keys, rising, and for each key that of its own. Equal keys meet in a slot by their hash; those that found another key there try again by the next hash, and what is left is sorted."""
    n = len(key)
    width = U64(63 - n.bit_length())
    table, every = np.empty(1 << (n.bit_length() + 1), dtype=np.int32), np.arange(n, dtype=np.int32)
    found, at, left = None, every, key
    for salt in _TRIES:
        slot = (left * salt >> width).view(np.int64)
        table[slot] = at
        met = table.take(slot)
        if found is None:
            found = met
        else:
            found[at] = met
        at = at.take(np.flatnonzero(key.take(met) != left))
        left = key.take(at)
        if not len(at):
            break
    order = np.argsort(left, kind="stable")
    if len(order):
        begin = np.append(True, np.diff(left[order]) != 0)
        found[at[order]] = at[order][begin][np.cumsum(begin) - 1]
    return np.flatnonzero(found == every), found


def numbered(key: np.ndarray) -> tuple[Numbered, np.ndarray]:
    """The keys by number, rising, and a position of each distinct one."""
    first, found = met_first(key)
    distinct = key.take(first)
    order = np.argsort(distinct)
    number = np.empty(len(key), dtype=np.int32)
    number[first[order]] = np.arange(len(order), dtype=np.int32)
    return Numbered(distinct[order], number.take(found)), first[order]


def numbered_as_met(key: np.ndarray) -> tuple[Numbered, np.ndarray]:
    """As numbered, but in the order of the positions, which spares a sort."""
    first, found = met_first(key)
    number = np.empty(len(key), dtype=np.int32)
    number[first] = np.arange(len(first), dtype=np.int32)
    return Numbered(key.take(first), number.take(found)), first


@dataclass
class Spelled:
    """Bytes of some texts, ends included: how many each text has, their code words and the PAD bytes before; where words may begin and the keys of the pairs of words there; tokens and their texts. A pair's key is the hash of its context, and the code word in the last bits."""

    sizes: np.ndarray
    code: np.ndarray
    before: np.ndarray
    start: np.ndarray
    word: np.ndarray
    token: np.ndarray
    token_doc: np.ndarray

    @property
    def pair(self) -> np.ndarray:
        """The bytes before each byte and its code word as one number, which no two pairs share."""
        return self.before << U64(16) | self.code


@dataclass
class Stream:
    """Spelled texts with their pairs numbered: those of the longer context, of these those of the shorter one, and the pairs of words where words begin."""

    sizes: np.ndarray
    code: np.ndarray
    long: Numbered
    short: Numbered
    start: np.ndarray
    words: Numbered
    token: np.ndarray
    token_doc: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    @property
    def place(self) -> np.ndarray:
        """The place of each byte in its text."""
        return np.arange(len(self.code)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    @property
    def keys(self) -> list[np.ndarray]:
        return [self.short.key, self.long.key, self.words.key]

    def counts(self, taught: np.ndarray) -> list[np.ndarray]:
        """How often the flagged bytes hold each pair."""
        long = np.bincount(self.long.number[taught], minlength=len(self.long.key))
        short = np.bincount(self.short.number, long, minlength=len(self.short.key)).astype(np.int64)
        return [short, long, np.bincount(self.words.number[taught[self.start]], minlength=len(self.words.key))]


def keyed(context: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    low = U64(64 - bits)
    return (mix(context) >> low << low) | code


def long_keys(before: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    return keyed(before + _SALT[1], code, bits)


def short_keys(before: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    return keyed((before & U64(0xFFFF)) + _SALT[0], code, bits)


def spelled(texts: Texts, codes: np.ndarray, bits: int) -> Spelled:
    n, sizes = len(texts), np.diff(texts.offsets)
    first = np.concatenate([[0], np.cumsum(sizes + PAD + 1)])
    data = np.full(first[-1], END, dtype=np.uint8)
    live = np.ones(len(data), dtype=bool)
    for k in range(PAD):
        live[first[:-1] + k] = False
    body = live.copy()
    body[first[1:] - 1] = False
    data[body] = texts.data
    code = np.ones(len(data), dtype=np.uint16)
    code[1:] = codes.ravel().take(data[:-1].astype(np.int32) << 8 | data[1:])
    before = np.zeros(len(data), dtype=U64)
    before[PAD:] = np.ndarray(max(0, len(data) - PAD), ">u4", data, strides=1)  # four bytes from each place on, the last one lowest

    solid = ~_IS_SPACE[data]
    after = np.append(False, solid[:-1])  # a byte of a word stands before
    starts, ends = np.flatnonzero(solid & ~after), np.flatnonzero(~solid & after)
    token = mix(span_hashes_between(data, starts, ends))
    # where a word may begin: the two words before, of the same text
    outer = np.flatnonzero(live & ~after)
    last = np.searchsorted(ends, outer)
    head = np.repeat(first[:-1], np.diff(np.searchsorted(outer, first)))
    held, where = np.concatenate([[U64(0), U64(1)], token]), np.concatenate([[-1, -1], ends])
    one, two = (np.where(where[last + k] > head, held[last + k], U64(k)) for k in (1, 0))
    word = keyed(one * U64(3) + mix(two + _SALT[4]) + data[outer - 1], code[outer], bits)
    token_doc = (np.searchsorted(first, starts, side="right") - 1).astype(np.int32)
    return Spelled(sizes + 1, code[live], before[live], np.flatnonzero(~after[live]).astype(np.int32), word, token, token_doc)


def stream_of(texts: Texts, codes: np.ndarray, bits: int, rising: bool = True) -> Stream:
    """The texts with numbered pairs, distinct and rising by key. If they need not be, pairs of the shorter and longer context are numbered as they come, those of contexts with one hash apart, and pairs of words are not looked for twice."""
    s = spelled(texts, codes, bits)
    if rising:
        long, at = numbered(long_keys(s.before, s.code, bits))
        short, _ = numbered(short_keys(s.before[at], s.code[at], bits))
        words, _ = numbered(s.word)
    else:
        exact, at = numbered_as_met(s.pair)
        long = Numbered(long_keys(s.before[at], s.code[at], bits), exact.number)
        short, _ = numbered_as_met(short_keys(s.before[at], s.code[at], bits))
        words = Numbered(s.word, np.arange(len(s.word), dtype=np.int32))
    return Stream(s.sizes, s.code, long, short, s.start, words, s.token, s.token_doc)


def span_hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_CODE[data] * powers[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def pieces(texts: Texts, n_bytes: int) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about so many bytes, which fit a processor's cache."""
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + n_bytes, side="right")) - 1)
        yield at, to, Texts(texts.data[texts.offsets[at] : texts.offsets[to]], texts.offsets[at : to + 1] - texts.offsets[at])
        at = to


def joined(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys, rising, and for each list given the positions of its keys there."""
    held, _ = numbered(np.concatenate(keys))
    return held.key, np.split(held.number, np.cumsum([len(k) for k in keys])[:-1])


def begins_of(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, with the sums of their counts."""
    key = np.concatenate(keys)
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")  # merges lists that rise
    key = key[order]
    begin = begins_of(key)
    return key[begin], np.add.reduceat(np.concatenate(counts)[order], begin)


def counted(key: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and how often each is flagged."""
    some, rest = np.sort(key[taught]), np.sort(key[~taught])
    begin, others = begins_of(some), rest[begins_of(rest)]
    return added([some[begin], others], [np.diff(np.append(begin, len(some))), np.zeros(len(others), np.int64)])


def pairs_in(texts: Texts, train: np.ndarray, codes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct pairs of each predictor and the distinct words of some texts, rising, with how often the training texts hold each."""
    held, word, token, of_word, of_token = ([] for _ in range(5))
    for at, to, piece in pieces(texts, SORTED_BYTES):
        s, mine = spelled(piece, codes, bits), train[at:to]
        taught = np.repeat(mine, s.sizes)
        both = np.sort(s.pair << U64(1) | taught)
        pair = both >> U64(1)
        begin = begins_of(pair)
        held.append((pair[begin], np.add.reduceat(both & U64(1), begin).astype(np.int64)))
        word.append(s.word)
        token.append(s.token)
        of_word.append(taught[s.start])
        of_token.append(mine[s.token_doc])
    pair, count = added(*zip(*held, strict=True))
    before, code = pair >> U64(16), pair.astype(np.uint16)
    end, n_ends = np.array([END_WORD]), np.array([np.count_nonzero(train)])
    words, often = counted(np.concatenate(token), np.concatenate(of_token))
    return [
        added([short_keys(before, code, bits)], [count]),
        added([long_keys(before, code, bits)], [count]),
        counted(np.concatenate(word), np.concatenate(of_word)),
        added([words, end], [often, n_ends]),
    ]


def bounds_of(key: np.ndarray, n_parts: int) -> np.ndarray:
    """Where the keys of each part begin and end; parts are equal ranges of hashes."""
    edges = np.array([-(-(p << 32) // n_parts) << 32 for p in range(1, n_parts)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]]).astype(np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one string, bytes of equal rank together."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(a) for a in arrays], dtype=np.int64).tobytes() + b"".join(planes), 1)


def unsqueeze(packed: bytes, *kinds, first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """The arrays, or those from first to before last."""
    data, out = zstandard.decompress(packed), []
    sizes, at = np.frombuffer(data, np.int64, len(kinds)).tolist(), 8 * len(kinds)
    for k, (n, kind) in enumerate(zip(sizes, kinds, strict=True)):
        width = np.dtype(kind).itemsize
        if first <= k < (len(kinds) if last is None else last):
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


_PAIRS = (U64, np.uint16, np.uint16, np.uint32)
_WORDS = (U64, np.uint32)


def wrapped(key: np.ndarray, count: np.ndarray, bits: int, text: np.ndarray | None = None) -> list[np.ndarray]:
    """Rising pairs as gaps between contexts, pairs of each context, code words and counts; contexts of different texts are apart."""
    context = key >> U64(64 - bits)
    new = np.append(True, context[1:] != context[:-1]) if len(key) else np.zeros(0, bool)
    if text is not None and len(key):
        new[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(new)
    return [np.diff(context[at], prepend=U64(0)), np.diff(np.append(at, len(key))).astype(np.uint16), key.astype(np.uint16), count.astype(np.uint32)]


def unwrapped(gap: np.ndarray, width: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    return np.repeat(np.cumsum(gap, dtype=U64) << U64(64 - bits), width) | code


def states_of(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The state of decisions: how often they were seen and their log odds, in coarse steps."""
    out = _FEW.take(zero.astype(np.intp) * _MANY + one.astype(np.intp), mode="clip")
    many = np.flatnonzero((zero >= _MANY) | (one >= _MANY))
    out[many] = computed_states(zero[many], one[many])
    return out


def computed_states(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    odds = np.log((one + 0.2) / (zero + 0.2))
    level = np.searchsorted(SEEN, zero + one, side="right")
    return (level * BINS + np.clip(np.floor(odds * (BINS / 16) + BINS / 2), 0, BINS - 1)).astype(np.uint16)


_MANY = 256
_FEW = computed_states(*(x.ravel() for x in np.indices((_MANY, _MANY))))
_KIND = (np.arange(STATES) // BINS).astype(np.int16)
_START = (np.arange(STATES) % BINS + 0.5 - BINS / 2) * 16 / BINS * (_KIND > 0)


def left_out() -> np.ndarray:
    """For each bit and state the state that such a decision leaves behind when it is left out of its own counts: that of most decisions, contexts seen n times being as frequent as 1 / n^2."""
    zero, one = (x.ravel() for x in np.indices((_MANY, _MANY)))
    out = np.tile(np.arange(STATES, dtype=np.uint16), (2, 1))
    for bit, own in ((0, zero), (1, one)):
        some = np.flatnonzero(own)
        to = computed_states(zero[some] - (bit == 0), one[some] - (bit == 1))
        often = np.bincount(_FEW[some] * np.intp(STATES) + to, own[some] / (zero + one)[some] ** 2.0, minlength=STATES * STATES).reshape(STATES, STATES)
        out[bit, often.any(axis=1)] = often.argmax(axis=1)[often.any(axis=1)]
    return out


_LEFT = left_out().ravel()
_KEPT = np.tile(np.arange(STATES, dtype=np.uint16), 2)


def decisions(group: np.ndarray, code: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Level by level the pairs that decide there, their bits, how often the decision fell that way and the other, and the first pair of each way.

    Pairs of a context, their group, stand together, by rising code word.
    """
    at, here = np.arange(len(code)), np.bincount(group, count)[group] if len(code) else np.zeros(0)
    length = _LENGTH[code]
    for level in range(LEVELS):
        on = np.flatnonzero(length[at] > level)
        if not len(on):
            return
        at, here = at[on], here[on]
        step = code[at] >> np.uint16(LEVELS - level)
        of = group[at]
        begin = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (of[1:] != of[:-1])]))
        same = np.repeat(np.add.reduceat(count[at], begin), np.diff(np.append(begin, len(at))))
        yield at, step & 1, same, here - same, begin
        here = same


def by_bit(bit: np.ndarray, same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(bit, other, same), np.where(bit, same, other)


def places_of(code: np.ndarray) -> np.ndarray:
    """Where the states of each pair begin if they stand pair by pair."""
    return np.concatenate([[0], np.cumsum(_LENGTH[code], dtype=np.int64)])


def merge_pairs(keys: list[np.ndarray], counts: list[np.ndarray], taught: list[np.ndarray], own: list[np.ndarray], ends: list[np.ndarray], bits: int, at_once: int = ENTRIES) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The states of the pairs of all requests, and of those of teaching texts less their own counts; how often each state was seen before a 0 and a 1.

    The last come from all decisions of the training texts, each with itself
    left out of the counts that make its state. Some contexts at a time, to
    bound memory. ends: whether a pair of a teaching text is the first of its
    context there.
    """
    cuts, own_cuts = (np.cumsum([len(k) for k in x])[:-1] for x in (keys, taught))
    key, count = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    place_type = np.int32 if len(key) < 1 << 27 else np.int64
    their, less, new = np.concatenate(taught), np.concatenate(own), np.concatenate(ends)
    code, own_code = key.astype(np.uint16), their.astype(np.uint16)
    place, own_place = places_of(code).astype(place_type), places_of(own_code)
    out, own_out = np.zeros(place[-1], dtype=np.uint16), np.zeros(own_place[-1], dtype=np.uint16)
    own_group, sums = np.cumsum(new), np.zeros((2, STATES))
    shares = -(-len(key) // at_once)
    low = U64(64 - bits)
    for share in range(shares):
        some = np.flatnonzero((key >> low) % U64(shares) == U64(share)) if shares > 1 else np.arange(len(key))
        mine = np.flatnonzero((their >> low) % U64(shares) == U64(share)) if shares > 1 else np.arange(len(their))
        if not len(some):
            continue
        order = np.argsort(key[some], kind="stable")
        sorted_key = key[some][order]
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        begin = np.flatnonzero(fresh)
        distinct, total = sorted_key[begin], np.add.reduceat(count[some][order].astype(np.float64), begin)
        which = np.empty(len(some), dtype=np.int64)
        which[order] = np.cumsum(fresh) - 1
        del order, sorted_key, fresh
        context = distinct >> low
        group = np.cumsum(np.append(False, context[1:] != context[:-1]))
        lookup = np.searchsorted(distinct, their[mine])
        apart = decisions(own_group[mine], own_code[mine], less[mine].astype(np.float64)) if len(mine) else iter(())
        length = _LENGTH[code[some]]
        for level, (at, bit, same, other, begin) in enumerate(decisions(group, distinct.astype(np.uint16), total)):
            begin = begin[same[begin] > 0]
            way, often = bit[begin], same[begin]
            lone = states_of(*by_bit(way, often - 1, other[begin]))
            sums += np.bincount(way * np.intp(STATES) + lone, often, minlength=2 * STATES).reshape(2, STATES)
            state = np.zeros(len(distinct), dtype=np.uint16)
            state[at] = states_of(*by_bit(bit, same, other))
            on = np.flatnonzero(length > level)
            out[place[some[on]] + level] = state[which[on]]
            if (step := next(apart, None)) is not None:
                alone, own_bit, own_same, own_other, _ = step
                all_same, all_other = np.zeros(len(distinct)), np.zeros(len(distinct))
                all_same[at], all_other[at] = same, other
                asked = lookup[alone]
                own_out[own_place[mine[alone]] + level] = states_of(*by_bit(own_bit, all_same[asked] - own_same, all_other[asked] - own_other))
    return np.split(out, place[cuts]), np.split(own_out, own_place[own_cuts]), sums


@dataclass
class Model:
    odds: np.ndarray  # for each predictor the log odds of each state, and of none
    weights: np.ndarray  # for each gate those of the predictors


def gate_of(a: np.ndarray, b: np.ndarray, at_start: bool) -> np.ndarray:
    """By how often the two longest contexts at hand saw their decisions."""
    return a * np.int16(KINDS) + b + np.int16(KINDS * KINDS if at_start else 0)


_STEP = 64.0
_REACH = 14
_GRID = np.arange(-_REACH * _STEP, _REACH * _STEP + 1) / _STEP
# what a decision costs and how far its chance was from 1, by the log odds for what it was
_COST = np.log2(1 + np.exp(-_GRID)).astype(np.float32)
_MISS = (1 / (1 + np.exp(_GRID))).astype(np.float32)
# what the slopes of two weights, nothing and the curvature take of it, read as one number
_SAYS = np.stack([_MISS, _MISS, 0 * _MISS, _MISS - _MISS * _MISS], axis=1).view(np.complex128).ravel()


def odds_of(sums: np.ndarray) -> np.ndarray:
    chance = (sums[:, 1] + 20 / (1 + np.exp(-_START))) / (sums.sum(axis=1) + 20)
    return np.append(np.clip(np.log(chance / (1 - chance)), -8, 8), np.zeros((CONTEXTS, 1)), axis=1).astype(np.float32)


def meetings(states: list[np.ndarray], places: list[np.ndarray], code: np.ndarray, times: np.ndarray | None, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """What meets in the decisions of some bytes, as numbers of the predictors' states and the bit, and how often (None: once); places: where the states of each byte begin, of two predictors or three; left: the state that counts, by bit and state."""
    out, length, at = [], _LENGTH[code], np.arange(len(code))
    for level in range(LEVELS):
        at = at.take(np.flatnonzero(length.take(at) > level))
        if not len(at):
            break
        bit = (code.take(at) >> np.uint16(LEVELS - level)) & np.uint16(1)
        of_bit = bit * np.intp(STATES)
        met = [left.take(of_bit + s.take(place.take(at) + level)).astype(np.uint32) for s, place in zip(states, places)]
        met += [np.uint32(STATES)] * (CONTEXTS - len(met))
        out.append((((met[0] * np.uint32(STATES) + met[1]) * np.uint32(STATES + 1) + met[2]) * np.uint32(2) + bit, None if times is None else times.take(at)))
    return out


def summed_up(met: list[tuple[np.ndarray, np.ndarray | None]]) -> bytes:
    """The distinct meetings and how often each came."""
    once = np.sort(np.concatenate([np.zeros(0, np.uint32), *(n for n, times in met if times is None)]))
    begin = begins_of(once)
    number, times = [once[begin]], [np.diff(np.append(begin, len(once)))]
    both = np.sort(np.concatenate([np.zeros(0, U64), *(n.astype(U64) << U64(32) | times.astype(U64) for n, times in met if times is not None)]))
    if len(both):
        more = (both >> U64(32)).astype(np.uint32)
        begin = begins_of(more)
        number.append(more[begin])
        times.append(np.add.reduceat((both & U64(0xFFFFFFFF)).astype(np.int64), begin))
    return squeeze(*added(number, times))


def newton_sums(number: np.ndarray, times: np.ndarray, model: Model) -> np.ndarray:
    """For each gate the slope and the curvature of the bits' log chance in its weights."""
    bits, rest = (number & 1).astype(np.float64), number >> 1
    rest, third = np.divmod(rest, np.uint32(STATES + 1))
    seen = np.stack([*np.divmod(rest, np.uint32(STATES)), third], axis=1).astype(np.intp)
    kind = [_KIND.take(np.minimum(seen[:, c], STATES - 1)) for c in range(CONTEXTS)]
    gate = np.where(seen[:, 2] == STATES, gate_of(kind[0], kind[1], False), gate_of(kind[1], kind[2], True))
    x = np.stack([model.odds[c].take(seen[:, c]) for c in range(CONTEXTS)], axis=1).astype(np.float64)
    chance = 1 / (1 + np.exp(-(x * model.weights[gate]).sum(axis=1)))
    miss, spread = (bits - chance) * times, chance * (1 - chance) * times
    sums = [np.bincount(gate, miss * x[:, i], minlength=GATES) for i in range(CONTEXTS)]
    sums += [np.bincount(gate, spread * x[:, i] * x[:, j], minlength=GATES) for i in range(CONTEXTS) for j in range(CONTEXTS)]
    return np.stack(sums, axis=1)


_FIRST = np.array([0.4] * CONTEXTS)
_FIRM = 20.0  # how firmly weights keep to the first ones


def newton_step(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    m = CONTEXTS
    slope = sums[:, :m] - _FIRM * (weights - _FIRST)
    return weights + np.clip(np.linalg.solve(sums[:, m:].reshape(-1, m, m) + _FIRM * np.eye(m), slope[:, :, None])[:, :, 0], -0.5, 0.5)


def steps_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each begin, so many of each."""
    to = np.cumsum(size)
    out = np.arange(to[-1] if len(to) else 0)
    out += np.repeat(begin - to + size, size)
    return out


def signs_of(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of all decisions of some code words 1 for the bit 1 and -1 for 0."""
    level = steps_of(np.zeros(len(size), np.int64), size).astype(np.uint16)
    return ((np.repeat(code, size) >> (np.uint16(LEVELS) - level)) & np.uint16(1)).astype(np.float32) * np.float32(2) - np.float32(1)


class Inputs:
    """What the decisions of some pairs say, pair by pair, signed by how they fell.

    within: of the pairs of the longer context both predictors' log odds, their
    weighted sum and the sum of their squares; seen: the gate's share. words:
    the states of the pairs of words, which few bytes share, and odds: the signed
    log odds by bit and state. short: of each pair of the longer context, the
    pair of the shorter one that follows from it.
    """

    def __init__(self, keys: list[np.ndarray], short: np.ndarray, states: list[np.ndarray], model: Model):
        codes = [key.astype(np.uint16) for key in keys]
        short_at, self.within_at, self.begins_at = map(places_of, codes)
        size = _LENGTH[codes[1]].astype(np.int64)
        lower = states[0].take(steps_of(short_at.take(short), size))
        sign, kind = signs_of(codes[1], size), _KIND.take(states[1])
        gate = gate_of(_KIND.take(lower), kind, False)
        x, y = model.odds[0].take(lower) * sign, model.odds[1].take(states[1]) * sign
        weights = model.weights.astype(np.float32)
        self.within = np.empty((len(sign), 4), dtype=np.float32)
        self.within[:, 0], self.within[:, 1], self.within[:, 3] = x, y, x * x + y * y
        self.within[:, 2] = x * weights[:, 0].take(gate) + y * weights[:, 1].take(gate)
        self.seen = kind
        self.words, self.odds = states[2], np.concatenate([-model.odds[2, :STATES], model.odds[2, :STATES]])

    def at(self, level: int, place: np.ndarray) -> np.ndarray:
        return self.within.view(np.complex128).ravel()[level:].take(place).view(np.float32).reshape(-1, 4)

    def at_start(self, level: int, pair: np.ndarray, word: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of pairs of words, and the gates."""
        state = self.words[level:].take(word)
        gate = gate_of(self.seen[level:].take(pair), _KIND.take(state), True)
        return self.odds.take(state + (code >> np.uint16(LEVELS - level) & np.uint16(1)) * np.uint16(STATES)), gate


def text_bits(s: Stream, long: np.ndarray, words: np.ndarray, inputs: Inputs, model: Model, n: int) -> np.ndarray:
    """The bits of each text of a piece, its end included; long, words: the numbers of its pairs in the inputs."""
    total, shift = np.zeros(n), np.zeros((n, CONTEXTS), dtype=np.float32)
    weights = np.append(model.weights, np.zeros((GATES, 1)), axis=1).astype(np.float32).view(np.complex128).ravel()
    doc, place = s.doc, s.place
    # stretches of a text double in length up to 16,384 bytes
    stretch = _STRETCH.take(place >> 8, mode="clip")
    if len(place) > _DOUBLED and (far := place >= _DOUBLED).any():
        stretch[far] = _STRETCH[-1] + 1 + (place[far] - _DOUBLED) // 16384
    inside = np.ones(len(place), dtype=np.int64)
    inside[s.start] = 0
    length = _LENGTH.take(s.code)
    key = (stretch * 2 + inside) * 16 + (LEVELS - length)
    order = np.argsort(key.astype(np.int16) if key.max() < 1 << 15 else key, kind="stable")
    doc, length, code = doc.take(order), length.take(order), s.code.take(order)
    pair = inputs.within_at.take(long).take(s.long.number.take(order))
    word = np.zeros(len(place), dtype=np.int64)
    word[s.start] = inputs.begins_at.take(words).take(s.words.number)
    edges = np.searchsorted((key >> 4).take(order), np.arange(2 * int(stretch.max()) + 3)).tolist()
    for k in range(0, len(edges) - 1, 2):
        turn = np.zeros((CONTEXTS + 1, n))
        a, b, c = edges[k : k + 3]
        if a < b:
            score_run(inputs, doc[a:b], length[a:b], pair[a:b], (word.take(order[a:b]), code[a:b]), weights, shift, total, turn)
        if b < c:
            score_run(inputs, doc[b:c], length[b:c], pair[b:c], None, weights, shift, total, turn)
        shift += (RATE * turn[:-1] / (turn[-1] + 100)).astype(np.float32).T
    return total


RATE = 0.8
_DOUBLED = 256 * 127
_STRETCH = np.repeat(np.arange(7), 2 ** np.arange(7))  # by 256 bytes


def score_run(inputs: Inputs, doc: np.ndarray, length: np.ndarray, pair: np.ndarray, word: tuple[np.ndarray, np.ndarray] | None, weights: np.ndarray, shift: np.ndarray, total: np.ndarray, turn: np.ndarray) -> None:
    """Adds the bits of some bytes of each text, by falling code length, to total, and to turn what they say on the texts' own weights. word: where words may begin, their pairs of words and code words."""
    own = [shift[:, c].take(doc) for c in range(2 if word is None else 3)]
    # of each byte the slopes of the first two weights and, last, the curvature; the third slope; bits
    sums, third, bits = np.zeros((len(doc), 4), np.float32), np.zeros(len(doc), np.float32), np.zeros(len(doc), np.float32)
    deciding = (len(doc) - np.cumsum(np.bincount(length, minlength=LEVELS + 1))).tolist()
    for level in range(LEVELS):
        n = deciding[level]
        if not n:
            break
        got = inputs.at(level, pair[:n])
        if word is None:
            z = got[:, 2] + own[0][:n] * got[:, 0]
            z += own[1][:n] * got[:, 1]
        else:
            odds, gate = inputs.at_start(level, pair[:n], word[0][:n], word[1][:n])
            of = weights.take(gate).view(np.float32).reshape(-1, 4)
            z = (of[:, 0] + own[0][:n]) * got[:, 0]
            z += (of[:, 1] + own[1][:n]) * got[:, 1]
            z += (of[:, 2] + own[2][:n]) * odds
            got[:, 3] += odds * odds
        z *= np.float32(_STEP)
        z += np.float32(_REACH * _STEP + 0.5)
        at = np.clip(z, 0, 2 * _REACH * _STEP, out=z).astype(np.intp)
        bits[:n] += _COST.take(at)
        says = _SAYS.take(at).view(np.float32).reshape(-1, 4)
        got *= says
        sums[:n] += got
        if word is not None:
            third[:n] += says[:, 0] * odds
    # texts stand together within each code length
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    of = doc[begin]
    for to, what in ((total, bits), (turn[0], sums[:, 0]), (turn[1], sums[:, 1]), (turn[-1], sums[:, 3]), *([] if word is None else [(turn[2], third)])):
        to += np.bincount(of, np.add.reduceat(np.ascontiguousarray(what), begin), minlength=len(total))


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: packed lower-case texts with ids, and what the training texts among them count."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for whole in batches:
            for batch in slices(whole, "t", BLOCK_BYTES):
                texts = texts_of(batch.column("t"))
                ids = batch.column("id")
                train = np.array([fold_of(i) != 0 for i in ids.to_pylist()])
                data = _LOWER[texts.data]
                before = np.append(np.uint8(END), data[:-1])
                full = np.diff(texts.offsets) > 0
                before[texts.offsets[:-1][full]] = END
                both = (before.astype(np.uint16) << 8 | data)[np.repeat(train, np.diff(texts.offsets))]
                histogram = np.bincount(both, minlength=1 << 16)
                ends = np.full(len(texts), END)
                ends[full] = data[texts.offsets[1:][full] - 1]
                histogram += np.bincount(ends[train] << 8 | END, minlength=1 << 16)
                met = np.flatnonzero(histogram)
                block = (TaskContext.get().partitionId() << 32) | k
                k += 1
                values = [block, texts.offsets.tolist(), zstandard.compress(data.tobytes(), 3), met.tolist(), histogram[met].tolist(), len(data)]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([held, *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names=["ids", "block", "offsets", "texts", "both", "times", "n_bytes"])

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return cut(lean.mapInArrow(rows, f"ids array<{kind}>, block long, offsets array<long>, texts binary, both array<long>, times array<long>, n_bytes long"), "lm-blocks")


def texts_in(row: dict) -> Texts:
    return Texts(np.frombuffer(zstandard.decompress(row["texts"].as_py()), np.uint8), np.asarray(row["offsets"].values))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Texts]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            yield row, texts_in(row)


def trained(row: dict) -> np.ndarray:
    return np.array([fold_of(i) != 0 for i in row["ids"].as_py()], dtype=bool)


def teaching(row: dict, texts: Texts, share: float) -> np.ndarray:
    """Which texts of a block teach."""
    return np.array([k for k, i in enumerate(row["ids"].as_py()) if fold_of(i) and teaches(i, texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes(), share)], dtype=np.int64)


class Teaching:
    """Teaching texts: a stream each, their pairs apart, and the order in which they ask."""

    def __init__(self, texts: Texts, codes: np.ndarray, bits: int):
        self.streams = [stream_of(texts.take(np.array([k])), codes, bits) for k in range(len(texts))]
        self.key, self.count, self.text, self.rank = [], [], [], []
        counts = [s.counts(np.ones(len(s.code), dtype=bool)) for s in self.streams]
        for c in range(CONTEXTS):
            sizes = [len(s.keys[c]) for s in self.streams]
            key = np.concatenate([s.keys[c] for s in self.streams] or [np.zeros(0, U64)])
            count = np.concatenate([x[c] for x in counts] or [np.zeros(0, np.int64)])
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((key.astype(np.uint16), text, key >> U64(64 - bits)))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            self.key.append(key[order])
            self.count.append(count[order])
            self.text.append(text[order])
            self.rank.append(np.split(rank, np.cumsum(sizes)[:-1]) if sizes else [])


def ask(blocks: DataFrame, codes: np.ndarray, bits: int, n_parts: int, share: float) -> DataFrame:
    """What blocks hold, by part: their pairs and words with counts, and the pairs of each teaching text by itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in unpacked(batches):
            lists = [(*x, None) for x in pairs_in(texts, trained(row), codes, bits)]
            lessons = Teaching(texts.take(teaching(row, texts, share)), codes, bits)
            lists += zip(lessons.key, lessons.count, lessons.text, strict=True)
            edges = [bounds_of(key, n_parts) for key, _, _ in lists]
            parts, asked = [], []
            for p in range(n_parts):
                flat = []
                for k, ((key, count, text), edge) in enumerate(zip(lists, edges, strict=True)):
                    here = slice(edge[p], edge[p + 1])
                    flat += [np.diff(key[here], prepend=U64(0)), count[here].astype(np.uint32)] if k == CONTEXTS else wrapped(key[here], count[here], bits, None if text is None else text[here])
                if any(map(len, flat)):
                    parts.append(p)
                    asked.append(squeeze(*flat))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array(asked, pa.binary())], names=["block", "part", "asked"])

    return blocks.select("block", "ids", "offsets", "texts").mapInArrow(rows, "block long, part long, asked binary")


def answered(asked: DataFrame, bits: int, at_once: int = ENTRIES) -> DataFrame:
    """For each block and part the states and word counts it asked for, those of its teaching texts; the part's distinct and all training words, and how often its states were seen, stand in one of its rows."""

    def add(rows: pa.Table) -> pa.Table:
        # one predictor's pairs are unpacked at a time
        asked, kinds = rows.column("asked").to_pylist(), (*_PAIRS * CONTEXTS, *_WORDS, *_PAIRS * CONTEXTS)
        m, n, answers, lessons, sums = 4 * CONTEXTS, len(asked), [], [], []
        for c in range(CONTEXTS):
            keys, counts, taught, own, starts = [], [], [], [], []
            for x in asked:
                *pairs, count = unsqueeze(x, *kinds, first=4 * c, last=4 * c + 4)
                keys.append(unwrapped(*pairs, bits))
                counts.append(count)
                *pairs, count = unsqueeze(x, *kinds, first=m + 2 + 4 * c, last=m + 6 + 4 * c)
                taught.append(unwrapped(*pairs, bits))
                own.append(count)
                starts.append(np.zeros(len(count), dtype=bool))
                starts[-1][np.cumsum(pairs[1], dtype=np.int64) - pairs[1]] = True
            for x, found in zip((answers, lessons, sums), merge_pairs(keys, counts, taught, own, starts, bits, at_once), strict=True):
                x.append(found)
        word, often = zip(*(unsqueeze(x, *kinds, first=m, last=m + 2) for x in asked), strict=True)
        word = [np.cumsum(w, dtype=U64) for w in word]
        distinct, count = added(word, [x.astype(np.int64) for x in often])
        words = [count[np.searchsorted(distinct, w)] for w in word]
        sent = [squeeze(*(a[k] for a in answers), words[k]) for k in range(n)]
        own = [squeeze(*(x[k] for x in lessons)) if any(len(x[k]) for x in lessons) else None for k in range(n)]
        known, tokens = np.zeros((2, n), dtype=np.int64)
        known[0], tokens[0] = np.count_nonzero(count), count.sum()
        seen = pa.array([np.stack(sums).ravel().tolist()] + [None] * (n - 1), pa.list_(pa.float64()))
        return pa.table([rows.column("block"), rows.column("part"), pa.array(sent, pa.binary()), pa.array(own, pa.binary()), pa.array(known), pa.array(tokens), seen], names=["block", "part", "states", "lesson", "n_words", "n_tokens", "seen"])

    return cut(asked.groupBy("part").applyInArrow(add, "block long, part long, states binary, lesson binary, n_words long, n_tokens long, seen array<double>"), "lm-states")


def together(replies: pa.Table, *kinds) -> list[np.ndarray]:
    """What the parts sent to a block, in order."""
    got = [unsqueeze(x, *kinds) for x in replies.sort_by("part").column(-1).to_pylist()]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def with_replies(blocks: DataFrame, replies: DataFrame, column: str):
    """Each block together with what its parts sent, one at a time."""
    sent = replies.filter(F.col(column).isNotNull()).select("block", "part", column)
    return blocks.groupBy("block").cogroup(sent.groupBy("block"))


@dataclass
class Held:
    """A block's streams; of each predictor its distinct pairs and where those of each stream are among them; of each pair of the longer context that of the shorter one."""

    streams: list[tuple[int, int, Stream]]
    keys: tuple[np.ndarray, ...]
    mine: tuple[list[np.ndarray], ...]
    short: np.ndarray


def held_in(texts: Texts, codes: np.ndarray, bits: int) -> Held:
    streams = [(at, to, stream_of(piece, codes, bits, rising=False)) for at, to, piece in pieces(texts, PIECE_BYTES)]
    keys, mine = zip(*(joined([s.keys[c] for _, _, s in streams]) for c in range(CONTEXTS)), strict=True)
    short = np.empty(len(keys[1]), dtype=np.int64)
    for k, (_, _, s) in enumerate(streams):
        short[mine[1][k]] = mine[0][k].take(s.short.number)
    return Held(streams, keys, mine, short)


def met_in(held: Held, states: list[np.ndarray], train: np.ndarray) -> bytes:
    """What meets in all decisions of a block's training texts, each left out of its own counts."""
    code = [key.astype(np.uint16) for key in held.keys]
    begin = [places_of(c) for c in code]
    within, out = np.zeros(len(code[1]), dtype=np.int64), []
    for k, (at, to, s) in enumerate(held.streams):
        taught = train[at:to][s.doc]
        of = np.flatnonzero(taught[s.start])
        start = s.long.number.take(s.start[of])
        # whether a word may begin is known from the last byte of the longer context
        np.add.at(within, held.mine[1][k], np.bincount(s.long.number[taught], minlength=len(s.long.key)) - np.bincount(start, minlength=len(s.long.key)))
        long, words = held.mine[1][k].take(start), held.mine[2][k].take(s.words.number.take(of))
        out += meetings(states, [begin[0].take(held.short.take(long)), begin[1].take(long), begin[2].take(words)], code[1].take(long), None, _LEFT)
    long = np.flatnonzero(within)
    return summed_up(out + meetings(states, [begin[0].take(held.short.take(long)), begin[1].take(long)], code[1].take(long), within.take(long), _LEFT))


def learn(blocks: DataFrame, replies: DataFrame, codes: np.ndarray, bits: int, share: float | None = None) -> Model:
    """Odds of states and weights from all decisions of the training texts, each left out of its own counts. With a share, weights come from that share of the texts, each seen with all its own counts taken out."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in unpacked(batches):
            some = texts.take(teaching(row, texts, share))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()]), pa.array([some.offsets.tolist()]), pa.array([zstandard.compress(some.data.tobytes(), 3)])], names=["block", "offsets", "texts"])

    def look(block: pa.Table, sent: pa.Table) -> pa.Table:
        lessons = Teaching(texts_in({c: block.column(c)[0] for c in block.column_names}), codes, bits)
        states = together(sent, *[np.uint16] * CONTEXTS)
        begins, met = [places_of(key.astype(np.uint16)) for key in lessons.key], []
        for k, s in enumerate(lessons.streams):
            short, long, words = (begin[rank[k]] for begin, rank in zip(begins, lessons.rank, strict=True))
            places = [short[s.short.number][s.long.number], long[s.long.number]]
            inside = np.delete(np.arange(len(s.code)), s.start)
            met += meetings(states, [p[inside] for p in places], s.code[inside], None, _KEPT)
            met += meetings(states, [*(p[s.start] for p in places), words[s.words.number]], s.code[s.start], None, _KEPT)
        return pa.table([pa.array([summed_up(met)], pa.binary())], names=["seen"])

    def look_at_all(block: pa.Table, sent: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        *states, _ = together(sent, *[np.uint16] * CONTEXTS, np.int64)
        return pa.table([pa.array([met_in(held_in(texts_in(row), codes, bits), states, trained(row))], pa.binary())], names=["seen"])

    texts = blocks.select("block", "ids", "offsets", "texts")
    if share is None:
        lessons = with_replies(texts, replies, "states").applyInArrow(look_at_all, "seen binary")
    else:
        lessons = with_replies(texts.mapInArrow(choose, "block long, offsets array<long>, texts binary"), replies, "lesson").applyInArrow(look, "seen binary")
    lessons = cut(lessons, "lm-lessons")

    def summed(model: Model) -> np.ndarray:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for packed in batch.column("seen").to_pylist():
                    number, times = unsqueeze(packed, np.uint32, np.int64)
                    for at in range(0, len(number), 1 << 18):
                        total = total + newton_sums(number[at : at + (1 << 18)], times[at : at + (1 << 18)], model)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        got = lessons.mapInArrow(rows, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        return np.array([r.v for r in got])

    sums = np.zeros(CONTEXTS * 2 * STATES)
    for k, v in replies.filter("seen is not null").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col")).collect():
        sums[k] = v
    model = Model(odds_of(sums.reshape(CONTEXTS, 2, STATES)), np.tile(_FIRST, (GATES, 1)))
    for _ in range(NEWTON):
        if not len(found := summed(Model(model.odds, model.weights))):
            break
        model.weights = newton_step(found.reshape(GATES, -1), model.weights).round(6)
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """Each document's id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits per byte; share: see learn."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = pack(docs, id_col, text_col)
    histogram = np.zeros(1 << 16)
    for both, n in blocks.select(F.explode(F.arrays_zip("both", "times")).alias("x")).groupBy("x.both").agg(F.sum("x.times")).collect():  # 65,536 rows at most
        histogram[both] = n
    codes = codes_of(histogram.reshape(256, 256))
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(48, (n_bytes | 1 << 16).bit_length() + SLOT_BITS)
    n_parts = max(1, math.ceil(n_bytes / PART_BYTES))
    replies = answered(ask(blocks, codes, bits, n_parts, share or 0.0), bits)
    distinct, total = (x or 0 for x in replies.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    model = learn(blocks, replies, codes, bits, share)
    known = spark.sparkContext.broadcast((codes, model))

    def score(block: pa.Table, sent: pa.Table) -> pa.Table:
        codes, model = known.value
        row = {c: block.column(c)[0] for c in block.column_names}
        texts = texts_in(row)
        n = len(texts)
        *states, seen = together(sent, *[np.uint16] * CONTEXTS, np.int64)
        held = held_in(texts, codes, bits)
        inputs = Inputs(held.keys, held.short, states, model)
        word, tokens_at = joined([np.array([END_WORD]), *(s.token for _, _, s in held.streams)])
        end_count = int(seen[tokens_at[0][0]])
        tokens, met, base, bit_sums = np.zeros((4, n))
        for k, (at, to, s) in enumerate(held.streams):
            m, count = to - at, seen[tokens_at[k + 1]]
            tokens[at:to] = np.bincount(s.token_doc, minlength=m) + 1
            met[at:to] = np.bincount(s.token_doc[count > 0], minlength=m) + (end_count > 0)
            base[at:to] = np.bincount(s.token_doc, np.log10(count + 0.1), minlength=m) + math.log10(end_count + 0.1)
            bit_sums[at:to] = text_bits(s, held.mine[1][k], held.mine[2][k], inputs, model, m)
        values = [(~trained(row), pa.bool_()), (tokens.astype(np.int64), pa.int64()), (met.astype(np.int64), pa.int64()), (base, pa.float64()), (-bit_sums * math.log10(2), pa.float64()), (bit_sums / (np.diff(texts.offsets) + 1), pa.float64())]
        return pa.table([row["ids"].values, *(pa.array(v, t) for v, t in values)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    scored = with_replies(blocks.select("block", "ids", "offsets", "texts"), replies, "states").applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    each = math.log10(total + 0.1 * (distinct + 1))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") - F.col("n_tokens") * each).alias("base_score"), "score", "bits_per_byte")
