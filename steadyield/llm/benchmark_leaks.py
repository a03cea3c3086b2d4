"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a plain form: ASCII letters in lower case, each run of
bytes that are neither letters, digits nor beyond ASCII as one blank. A text
holds a benchmark item if some stretch of it is within the item's edit budget,
a tenth of its length. Such a stretch shares at least m - q + 1 - k * q of the
item's m - q + 1 q-grams, for budget k, and they lie on neighbouring diagonals
(position in the text less position in the item) that differ by k at most.
Shared q-grams are counted in overlapping bands of diagonals of that width, so
no such stretch is missed, and each band with enough of them is verified by
aligning the item within it. q is 8, but 5 for the few lengths (10 to 15, 20 to
23, 30 and 31) at which the budget could spoil all q-grams of 8. Lengths and
edits are in bytes of UTF-8.

The benchmark is the stated query set. It meets all documents in blocks of
bounded size, each sent to all tasks.

Defined results: a null or empty text holds nothing; an item without letters
or digits is held by no text; an item shorter than 8 must occur as it is,
between blanks; equal texts and equal items match alike; an empty table on
either side gives an empty result; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from steadyield.llm.textops import U64, Texts, slices, texts_of

Q = 8  # a q-gram of bytes is then one 64-bit number
SHORT_Q = 5  # at a tenth as budget no item of 8 bytes or more loses all its q-grams of this size
EDIT_SHARE = 0.1
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _c in range(128):
    if not (chr(_c).isascii() and chr(_c).isalnum()):
        _PLAIN[_c] = 32


def plain_form(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The texts in plain form, a blank before and after each, and where each byte stood in the source."""
    n = len(texts)
    at = np.arange(len(texts.data)) + np.repeat(np.arange(n) * 2 + 1, np.diff(texts.offsets))
    data = np.full(len(texts.data) + 2 * n, 32, dtype=np.uint8)
    data[at] = _PLAIN[texts.data]
    source = np.zeros(len(data), dtype=np.int64)
    source[at] = np.arange(len(texts.data))
    offsets = texts.offsets + 2 * np.arange(n + 1)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1]] = True
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return Texts(data[keep], total[offsets]), source[keep]


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram that starts at each byte but the last few, q from 4 to 8."""
    if len(data) < q:
        return np.zeros(0, U64)
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    n = len(data) - q + 1
    return four[:n].astype(U64) | (four[q - 4 : q - 4 + n].astype(U64) << U64(8 * (q - 4)))


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * U64(0x9E3779B97F4A7C15)) >> U64(64 - _FILTER_BITS)).astype(np.int64)


@dataclass
class Postings:
    """Where the q-grams of some items stand, for one q."""

    q: int
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


@dataclass
class Index:
    """A block of the benchmark: items in plain form and the postings of their q-grams."""

    ids: list
    items: list[bytes]
    budget: np.ndarray
    least: np.ndarray  # shared q-grams that a stretch within budget must have
    postings: list[Postings]
    short: list[int]
    kind: pa.DataType


def _postings(items: list[bytes], of: np.ndarray, q: int) -> Postings:
    codes = [grams(np.frombuffer(items[k], np.uint8), q) for k in of]
    item = np.repeat(of, [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes])
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    unique, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[_slot(unique)] = True
    return Postings(q, unique, np.append(first, len(flat)), item[order], place[order], seen)


def build_index(ids: list, texts: list[str | None], edit_share: float = EDIT_SHARE, kind: pa.DataType | None = None) -> Index:
    plain, _ = plain_form(texts_of(pa.array([t or "" for t in texts], pa.large_string())))
    items = [plain.data[a:b].tobytes().strip(b" ") for a, b in zip(plain.offsets[:-1], plain.offsets[1:], strict=True)]
    size = np.array([len(x) for x in items], dtype=np.int64)
    budget = (edit_share * size).astype(np.int64)
    long = size >= Q
    q = np.where((budget + 1) * Q <= size, Q, SHORT_Q)
    if (long & ((budget + 1) * q > size)).any():
        raise ValueError(f"edit_share {edit_share} leaves an item without a whole q-gram of {SHORT_Q} bytes")
    postings = [_postings(items, of, k) for k in (Q, SHORT_Q) if len(of := np.flatnonzero(long & (q == k)))]
    return Index(ids, items, budget, size - q + 1 - budget * q, postings, np.flatnonzero((size > 0) & ~long).tolist(), kind or (pa.array(ids).type if ids else pa.int64()))


def candidates(texts: Texts, index: Index, p: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, item and lowest diagonal of each band that holds enough shared q-grams."""
    none = np.zeros(0, np.int64)
    codes = grams(texts.data, p.q)
    at = np.flatnonzero(p.seen[_slot(codes)])
    if not len(at):
        return none, none, none
    which = np.minimum(np.searchsorted(p.codes, codes[at]), len(p.codes) - 1)
    good = p.codes[which] == codes[at]
    at, which = at[good], which[good]
    doc = np.searchsorted(texts.offsets, at, side="right") - 1
    inside = at + p.q <= texts.offsets[doc + 1]
    at, which, doc = at[inside], which[inside], doc[inside]
    n = p.first[which + 1] - p.first[which]
    if not n.sum():
        return none, none, none
    begin = np.repeat(p.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    posting = begin + np.arange(n.sum())
    item = p.item[posting]
    diagonal = np.repeat(at - texts.offsets[doc], n) - p.place[posting]
    doc = np.repeat(doc, n)
    # half a band is budget + 1 diagonals; a band is two neighbouring halves
    half = np.floor_divide(diagonal, index.budget[item] + 1)
    shift = len(texts.data) + int(index.budget.max()) + max(map(len, index.items)) + 2  # makes halves positive
    key = np.sort(((doc * len(index.items) + item) << 33) + half + shift)
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(edge, len(key)))
    key = key[edge]
    after = np.zeros_like(count)
    joins = key[1:] == key[:-1] + 1
    after[:-1][joins] = count[1:][joins]
    (doc, item), half = np.divmod(key >> 33, len(index.items)), (key & ((1 << 33) - 1)) - shift
    enough = count + after >= index.least[item]
    return doc[enough], item[enough], half[enough] * (index.budget[item[enough]] + 1)


def align(texts: Texts, index: Index, doc: np.ndarray, item: np.ndarray, low: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item within its band of diagonals, and where that stretch ends in the document.

    Items of like sizes are aligned side by side, at most 512 and as many as
    their windows hold about so many cells.
    """
    best, end = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    size = np.array([len(x) for x in index.items], dtype=np.int64)
    by_size = np.argsort(size[item], kind="stable")
    at = 0
    while at < len(doc):
        lanes = min(512, max(1, cells // (2 * int(size[item[by_size[at]]]) + 64)))
        part = by_size[at : at + lanes]
        at += lanes
        m, k = size[item[part]], index.budget[item[part]]
        width = int(3 * (k.max() + 1) + 1)
        rows = int(m.max())
        pattern = np.zeros((len(part), rows), np.uint8)
        for lane, x in enumerate(item[part]):
            pattern[lane, : m[lane]] = np.frombuffer(index.items[x], np.uint8)
        # window[lane, c] is the byte at diagonal low - k and row c; the document ends where bytes are 0
        start = low[part] - k
        column = start[:, None] + np.arange(rows + width)
        length = (texts.offsets[1:] - texts.offsets[:-1])[doc[part]]
        valid = (column >= 0) & (column < length[:, None])
        window = np.where(valid, texts.data[np.clip(texts.offsets[doc[part]][:, None] + column, 0, max(len(texts.data) - 1, 0))], 0)
        steps = np.arange(width)
        cost = np.zeros((len(part), width), np.int64)
        done = np.full(len(part), 1 << 30, np.int64)
        for r in range(rows):
            kept = cost + (pattern[:, r, None] != window[:, r : r + width])
            dropped = np.concatenate([cost[:, 1:], np.full((len(part), 1), 1 << 20)], axis=1) + 1
            cost = np.minimum(kept, dropped)
            cost = np.minimum.accumulate(cost - steps, axis=1) + steps
            if (ready := m == r + 1).any():
                lane = np.flatnonzero(ready)
                done[lane] = cost[lane].min(axis=1)
                end[part[lane]] = start[lane] + r + 1 + cost[lane].argmin(axis=1)
        best[part] = done
    return best, end


def find(texts: Texts, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Document, item, edits and the stretch as bytes of the document, for every item that a document holds."""
    plain, source = plain_form(texts)
    none = np.zeros(0, np.int64)
    doc, item, low = (np.concatenate(x) for x in zip((none, none, none), *(candidates(plain, index, p) for p in index.postings)))
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    if len(doc):
        edits, end = align(plain, index, doc, item, low)
        for d, x, e, to in zip(*(v[edits <= index.budget[item]].tolist() for v in (doc, item, edits, end)), strict=True):
            if (d, x) not in out or e < out[d, x][0]:
                a, b = plain.offsets[d], plain.offsets[d + 1]
                last = min(max(a + to - 1, a), b - 1)
                first = min(max(a + to - len(index.items[x]), a + 1), last)
                out[d, x] = (e, int(source[first] - texts.offsets[d]), int(source[last] - texts.offsets[d]) + 1)
    for x in index.short:
        needle = b" " + index.items[x] + b" "
        body, from_ = plain.data.tobytes(), 0
        while (hit := body.find(needle, from_)) >= 0:
            d = int(np.searchsorted(plain.offsets, hit, side="right")) - 1
            if hit + len(needle) <= plain.offsets[d + 1]:
                out.setdefault((d, x), (0, int(source[hit + 1] - texts.offsets[d]), int(source[hit + len(needle) - 2] - texts.offsets[d]) + 1))
            from_ = hit + 1
    return sorted((d, x, *v) for (d, x), v in out.items())


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's index in blocks of items; the driver holds one block at a time, of block_bytes and one item at most."""
    kind = to_arrow_type(benchmark.schema[id_col].dataType)
    sized = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("b", F.coalesce(F.octet_length("t"), F.lit(0)))
    total = sized.agg(F.sum("b")).first()[0] or 0
    if total <= block_bytes:
        rows = sized.collect()
        yield build_index([r.id for r in rows], [r.t for r in rows], kind=kind)
        return
    parts = -(-2 * total // block_bytes)
    hashed = sized.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(parts)))
    upto = F.sum("b").over(Window.orderBy("part"))
    runs = hashed.groupBy("part").agg(F.sum("b").alias("b")).withColumn("block", F.floor(upto / block_bytes)).groupBy("block").agg(F.min("part").alias("a"), F.max("part").alias("z")).orderBy("block").collect()
    for run in runs:
        rows = hashed.filter(F.col("part").between(run.a, run.z)).collect()
        yield build_index([r.id for r in rows], [r.t for r in rows], kind=kind)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and item that it holds: edits, and the stretch in characters (its start is exact up to the edits)."""
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    id_kind = docs.schema[id_col].dataType.simpleString()
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t is not null")
    found = []
    for index in benchmark_blocks(benchmark, item_col):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "t"):
                    index, texts = sent.value, texts_of(batch.column("t"))
                    hits = find(texts, index)
                    chars = lambda d, a, b: int(np.count_nonzero(texts.data[texts.offsets[d] + a : texts.offsets[d] + b] & 0xC0 != 0x80))
                    starts = [chars(d, 0, a) for d, _, _, a, _ in hits]
                    ends = [s + chars(d, a, b) for s, (d, _, _, a, b) in zip(starts, hits, strict=True)]
                    ids = batch.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                    items = pa.array([index.ids[h[1]] for h in hits], index.kind)
                    yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(x, pa.int64()) for x in ([h[2] for h in hits], starts, ends))], names=["id", "item", "edits", "start", "end"])

        found.append(lean.mapInArrow(search, f"id {id_kind}, item {item_kind}, edits long, start long, end long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    for index in benchmark_blocks(benchmark, item_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def sift(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    clean = np.ones(batch.num_rows, dtype=bool)
                    clean[[h[0] for h in find(texts_of(batch.column(text_col)), sent.value)]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
