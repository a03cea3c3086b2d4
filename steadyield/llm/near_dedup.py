"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles is summed up in registers: each holds the
minimum of exponentially distributed hash values of the set, rounded down to a
power of a base close to 1 and truncated to 8 bits. Registers of a union are
the larger registers, and two sets agree in a register with a probability close
to their similarity. Runs of registers form bands; documents that agree in a
band become candidates, their similarity is estimated jointly from all
registers and both set sizes by maximum likelihood, and pairs that may reach
the threshold are verified on their full sets.

Equal sets are one class from the start, so copies cost nothing further. A
bucket of a band links its members to one leader, so a bucket of k members
yields k - 1 pairs, and each class keeps the leader it resembles most. Parts that still
share a bucket are then compared by one member each. Last, what lies
outside a bucket's largest part is compared with all of the bucket, set by set.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than a shingle has one shingle, the
whole sequence; rows that repeat an id are versions of one document and share
its component; a null id is linked with nothing and kept; an empty table gives
an empty result; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut
from steadyield.llm.textops import U64, Texts, mix, slices, texts_of, windows_of, words_of

THRESHOLD = (80, 100)
BAND_WIDTH = 6
BANDS = 42
REGISTERS = BAND_WIDTH * BANDS  # a pair at similarity 0.8 misses all bands with probability 3e-6
BASE = 1.1
RATE = 20.0
LIMIT = 254
SLACK = 4.0  # standard errors that the estimate may lie below the threshold
TILE = 256
JOIN_ROUNDS = 2

_XOR = (mix(np.arange(1, REGISTERS + 1, dtype=U64)) >> U64(32)).astype(np.uint32)
_MUL = (mix(np.arange(1001, REGISTERS + 1001, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document by document, and the document of each; repeats included."""
    words = words_of(texts, fold_case=True)
    value, at = windows_of(words, width)
    doc = words.doc[at]
    counts = words.counts()
    for n in range(1, width):
        if (short := counts == n).any():
            v, at = windows_of(words, n)
            mine = short[words.doc[at]]
            value, doc = np.concatenate([value, v[mine]]), np.concatenate([doc, words.doc[at[mine]]])
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]


def distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in rising order."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def sketch(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of the sets that begin at these positions, a row each."""
    low = (value >> U64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(starts)), dtype=np.uint32)
    x, y = np.empty_like(low), np.empty_like(low)
    for k in range(REGISTERS):
        np.bitwise_xor(low, _XOR[k], out=x)
        np.multiply(x, _MUL[k], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, _MUL[-1 - k], out=x)
        least[k] = np.minimum.reduceat(x, starts)
    exponential = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint8)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    runs = registers.reshape(len(registers), BANDS, BAND_WIDTH).astype(U64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), runs.shape[:2])
    for k in range(BAND_WIDTH):
        key = mix(key * U64(0xD6E8FEB86659FD93) + runs[:, :, k] + U64(1))
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers and set sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top * (np.arange(steps) + 0.5) / steps
    rate = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = rate(u - v * j), rate(v - u * j)
    equal = a.shape[1] - above - below
    fit = above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-9, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def describe(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Of each row: id, set size, digest of the set and registers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                texts = texts_of(batch.column("t"))
                n = len(texts)
                value, doc = distinct(*shingles(texts, width))
                counts = np.bincount(doc, minlength=n)
                full = np.flatnonzero(counts)
                starts = np.searchsorted(doc, full)
                registers = np.zeros((n, REGISTERS), np.uint8)
                digest = np.zeros((n, 2), U64)
                if len(full):
                    registers[full] = sketch(value, starts)
                    for k in range(2):
                        digest[full, k] = mix(np.add.reduceat(mix(value + U64(7 + k)), starts) + counts[full].astype(U64))
                held = lambda table: pa.array([r.tobytes() if c else None for r, c in zip(table, counts, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), held(digest), held(registers)], names=["id", "n", "digest", "registers"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(rows, f"id {kind}, n long, digest binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """A row c, key for each band of each class."""
    kind = classes.schema["c"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            ids = batch.column("c").take(pa.array(np.repeat(np.arange(len(registers)), BANDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(band_keys(registers).ravel())], names=["c", "key"])

    return classes.select("c", "registers").mapInArrow(rows, f"c {kind}, key long")


def packed_texts(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows c, packed with the compressed texts of the members."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([packer.compress(t.as_py().encode()) for t in batch.column("t")], pa.binary())], names=["c", "packed"])

    lean = docs.select(F.col(id_col).alias("c"), F.col(text_col).alias("t")).filter("c is not null and t is not null")
    return lean.mapInArrow(rows, f"c {kind}, packed binary").join(members, "c", "left_semi")


def within_reach(r_a: np.ndarray, r_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs, and whether sizes and estimate leave the threshold within reach."""
    part, whole = THRESHOLD
    need = part / whole
    j = estimate(r_a, r_b, n_a, n_b)
    return j, (j >= need - SLACK * (need * (1 - need) / REGISTERS) ** 0.5) & (whole * np.minimum(n_a, n_b) >= part * np.maximum(n_a, n_b))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b with estimated similarity, less those that cannot reach the threshold."""
    side = classes.select("c", "n", "registers")
    joined = pairs.join(side.withColumnsRenamed({"c": "a", "n": "n_a", "registers": "r_a"}), "a").join(side.withColumnsRenamed({"c": "b", "n": "n_b", "registers": "r_b"}), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 2000) for at in range(0, whole.num_rows, 2000)):
                r_a, r_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                j, good = within_reach(r_a, r_b, np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")))
                good = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(j).filter(good)], names=["a", "b", "j"])

    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(judge, f"a {kind}, b {kind}, j double")


def links_across(apart: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links a, b between different parts of the buckets, from rows key, c, part: all of them, or one for two parts that meet in a task.

    In a bucket everything is compared with what lies outside its largest
    part. Both sides are cut into tiles of at most about TILE members, so no
    task holds a bucket, and the full sets of two tiles are compared at once:
    the product of their incidence matrices is the sizes of all intersections.
    """
    part, whole = THRESHOLD
    sizes = apart.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k"))
    shape = sizes.groupBy("key").agg(F.max_by("part", "k").alias("main"), F.sum("k").alias("k"), F.max("k").alias("largest"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    rows = apart.join(shape.select("key", "main", tiles(F.col("k")).alias("wide"), tiles(F.col("k") - F.col("largest")).alias("high")), "key")
    mine = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.filter("part <> main").select("key", mine(F.col("high")).alias("i"), across("wide").alias("j"), F.lit(0).alias("side"), "c", "part")
    other = rows.select("key", across("high").alias("i"), mine(F.col("wide")).alias("j"), F.lit(1).alias("side"), "c", "part")
    met = one.unionByName(other).join(texts, "c").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "c")
    kind = apart.schema["c"].dataType.simpleString()

    def compare(batch: pa.RecordBatch, opener: zstandard.ZstdDecompressor) -> Iterator[pa.RecordBatch]:
        column = lambda name: np.asarray(batch.column(name))
        tile = np.stack([column("key"), column("i").astype(np.int64), column("j").astype(np.int64)], axis=1)
        edges = np.append(np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(axis=1))), len(tile)).tolist()
        bodies = [opener.decompress(x) for x in batch.column("packed").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        value, row = distinct(*shingles(Texts(np.frombuffer(b"".join(bodies), np.uint8), offsets), width))
        at = np.searchsorted(row, np.arange(len(tile) + 1))
        n, side, parts = np.diff(at), column("side"), batch.column("part").to_pylist()
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            if lo == mid or mid == hi:
                continue
            common = intersections(value[at[lo] : at[hi]], row[at[lo] : at[hi]] - lo, mid - lo, hi - lo)
            union = n[lo:mid, None] + n[None, mid:hi] - common
            seen = set()
            for x, y in zip(*np.nonzero(whole * common >= part * union), strict=True):
                p, q = parts[lo + x], parts[mid + y]
                if p != q and (min(p, q), max(p, q)) not in seen:
                    seen.add((min(p, q), max(p, q)))
                    a.append(lo + x)
                    b.append(mid + y)
        yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, rest = zstandard.ZstdDecompressor(), None
        for batch in (full.slice(k, 1000) for full in batches for k in range(0, full.num_rows, 1000)):
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key, i, j = (np.asarray(batch.column(c)) for c in ("key", "i", "j"))
            others = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            done = int(others[-1]) + 1 if len(others) else 0
            if done:
                yield from compare(batch.slice(0, done), opener)
            rest = batch.slice(done)
        if rest is not None and rest.num_rows:
            yield from compare(rest, opener)

    return met.select("key", "i", "j", "side", "c", "part", "packed").mapInArrow(whole_tiles, f"a {kind}, b {kind}")


def intersections(value: np.ndarray, row: np.ndarray, height: int, rows: int, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the first sets with the others, some thousand shared elements at a time."""
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.append(True, value[1:] != value[:-1])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, row = number[shared], row[shared]
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    out = np.zeros((height, rows - height), dtype=np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        here = slice(*np.searchsorted(number, (first, first + step)))
        has = np.zeros((rows, min(step, int(number[-1]) + 1 - first)), dtype=np.float32)
        has[row[here], number[here] - first] = 1
        out += has[:height] @ has[height:].T
    return out.astype(np.int64)


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    part, whole = THRESHOLD
    kind = pairs.schema["a"].dataType.simpleString()
    side = texts
    joined = pairs.select("a", "b").join(side.withColumnsRenamed({"c": "a", "packed": "t_a"}), "a").join(side.withColumnsRenamed({"c": "b", "packed": "t_b"}), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()

        def sets(packed: list[bytes]) -> list[np.ndarray]:
            parts = [opener.decompress(x) for x in packed]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            value, doc = distinct(*shingles(Texts(np.frombuffer(b"".join(parts), np.uint8), offsets), width))
            return np.split(value, np.searchsorted(doc, np.arange(1, len(parts))))

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 64):
                batch = whole_batch.slice(at, 64)
                good = []
                for x, y in zip(sets(batch.column("t_a").to_pylist()), sets(batch.column("t_b").to_pylist()), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(whole * common >= part * (len(x) + len(y) - common))
                good = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(judge, f"a {kind}, b {kind}")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Of each node that is not the smallest of its component that smallest node, as rows (c, component).

    Every node hooks to its smallest smaller neighbour; the trees are flattened
    by doubling, links are carried over to the roots, and what still links two
    roots goes the next round. Each step is written to the shared folder.
    """
    edges = cut(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "edges")
    found = None
    for _ in range(max_rounds):
        if not edges.take(1):
            break
        up = cut(edges.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "c"), "hooks")
        for _ in range(max_rounds):
            above = up.select(F.col("c").alias("up"), F.col("up").alias("top"))
            higher = up.join(above, "up", "left")
            if not higher.filter("top is not null").take(1):
                break
            up = cut(higher.select("c", F.coalesce("top", "up").alias("up")), "hooks")
        found = up if found is None else cut(moved(found, "up", up).union(up), "labels")
        edges = cut(moved(moved(edges, "lo", up), "hi", up).select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        found = edges.select(F.col("hi").alias("c"), F.col("lo").alias("up"))
    return found.withColumnRenamed("up", "component")


def moved(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """The rows with a node in this column replaced by its root."""
    to = up.select(F.col("c").alias(column), F.col("up").alias("__root"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__root", column)).select(rows.columns)


def still_apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows key, c, part of the buckets whose members lie in different parts."""
    labelled = shared.select("key", "c").join(labels, "c", "left").withColumn("part", F.coalesce("component", "c")).select("key", "c", "part")
    mixed = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("key")
    return cut(labelled.join(mixed, "key"), "apart")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id and kept."""
    rows = cut(describe(docs, id_col, text_col, width), "sketches")
    known = rows.filter("id is not null and digest is not null")
    by_digest = cut(known.groupBy("digest").agg(F.min("id").alias("c")), "digests")
    classes = cut(known.join(by_digest, "digest").filter("id = c").dropDuplicates(["digest"]).select("c", "n", "registers"), "classes")
    banded = bands(classes)
    leaders = banded.groupBy("key").agg(F.min("c").alias("leader"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "leader")
    shared = cut(banded.join(leaders, "key"), "buckets")
    texts = cut(packed_texts(docs, shared.select("c").distinct(), id_col, text_col), "texts")
    first = shared.filter("c <> leader").select(F.col("c").alias("a"), F.col("leader").alias("b")).distinct()
    best = likely(first, classes).groupBy("a").agg(F.max_by("b", F.struct("j", "b")).alias("b"))
    links = cut(verified(best, texts, width), "links")
    labels = cut(components(links), "components")
    # parts that share a bucket are first compared by one member each, then what is still apart with all of its bucket
    for round_no in range(JOIN_ROUNDS):
        apart = still_apart(shared, labels)
        one = apart.groupBy("key", "part").agg(F.min_by("c", F.xxhash64("c", F.lit(round_no))).alias("c"))
        lead = one.groupBy("key").agg(F.min(F.struct("part", "c")).alias("lead"))
        pairs = one.join(lead, "key").filter("part <> lead.part").select(F.col("c").alias("a"), F.col("lead.c").alias("b")).distinct()
        new = cut(verified(cut(likely(pairs, classes), "likely"), texts, width), "links")
        if not new.take(1):
            break
        links = links.union(new)
        labels = cut(components(links), "components")
    more = links_across(still_apart(shared, labels), texts, width)
    # an id that stands in several classes ties them
    homes = known.select("id", "digest").join(by_digest, "digest").select("id", "c")
    tied = homes.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z").select("id", "a")
    versions = homes.join(tied, "id").select("a", F.col("c").alias("b")).filter("a < b").distinct()
    late = cut(more.union(versions), "late-links")
    if late.take(1):
        labels = cut(components(links.union(late)), "components")
    found = rows.select("id", "n", "digest").join(by_digest, "digest", "left").join(labels, "c", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "c", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
