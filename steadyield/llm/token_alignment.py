"""Aligning the tokens of two tokenizers and counting which tokens go together.

Both encode a text with one space before it, as plain text. Tokens whose bytes
overlap are linked. The first pass counts, task by task, the links of each
pair of ids. Distinct pairs get a minimal perfect hash, one for each bucket of
B ids; the counts of the parts of the corpus become dense vectors indexed by
it, which are added up in a tree. A second pass aligns each document again
and looks its pairs up; a pair's key is compared with the one that the
hash's table holds at its place.

Neither tokenizer joins a character that isn't white space with a space after
it (for B this is checked against its pieces), so a text is cut there and each
distinct piece is encoded and aligned once in a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut
from steadyield.llm.perfect_hash import PerfectHash
from steadyield.llm.textops import U64, mix, slices

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE_PIECE = "▁"
BUCKETS = 256  # of B ids; a bucket can hold all A ids for each of its B ids and no more
FAN = 32  # vectors added up in one task
SLICE = 1 << 20  # bytes of text worked on at once
CACHED = 300_000  # pieces that a task remembers
# Fixed value: how the first tokenizer cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_LIMIT = 64 << 20  # bytes of the table of counts that each task may hold; a larger one is joined in a shuffle
HOT_SHARE = 1000  # pairs that more than one in so many links hold, fewer than this, are joined apart

_GAP = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"\s ")
_BLANK_END = re.compile(r"(?:^|\s) ")


def pieces_of(text: str) -> list[str]:
    """Cuts space + text before each space that follows a character other than white space; the first space of each piece is left out."""
    if not _SPACED.search(" " + text):
        return text.split(" ")
    return [p[1:] for p in _GAP.split(" " + text)]


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_tokenizers(folder: str = FOLDER) -> tuple[bytes, bytes]:
    return Path(folder, A_FILE).read_bytes(), Path(folder, B_FILE).read_bytes()


class Aligner:
    """Encodes and aligns pieces and remembers them: an entry number for each, and arrays of figures and links by entry."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        a, value = json.loads(a_file), byte_values()
        vocab = {bytes(value[c] for c in t): i for t, i in a["model"]["vocab"].items() if i not in {x["id"] for x in a["added_tokens"]}}
        self.a_bytes = _by_id(vocab)
        self.encode_a = _byte_bpe(a_file, a, vocab)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}", t) for t in pieces):
            raise ValueError("a piece of the second tokenizer joins a character with a space after it")
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(SPACE_PIECE, " ").encode() for i, t in enumerate(pieces)]
        self.lone_space = self.b.piece_to_id(SPACE_PIECE)
        self.sizes = [np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.with_names = True
        # an id and what follows it: within its side of a group, or at the end of its side
        self.tokens = [[np.array([f"{i}{c}" for i in range(len(x))], dtype=object) for c in ends] for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.token_sizes = [np.array([len(str(i)) + 1 for i in range(len(x))], dtype=np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.links: list[np.ndarray] = []  # pair keys of the entries, in their order
        self.names: list[str] = []  # groups as text, each with what follows it
        self.figures = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.fits = np.zeros(0, dtype=bool)
        self.new_figures: list[np.ndarray] = []
        self.new_fits: list[bool] = []

    def encode_b(self, text: str) -> list[int]:
        # without a character there is no word for the tokenizer's own space to go before
        return self.b.encode(text) or [self.lone_space]

    def learn(self, pieces: set[str]) -> None:
        """Encodes and aligns those of the pieces that are not known: most as one text, which is cut between them."""
        new = [p for p in pieces if p not in self.at]
        apart = [p for p in new if not p or p[-1].isspace()] if _BLANK_END.search(" ".join(new) + " ") else []
        joined = [p for p in new if p and not p[-1].isspace()] if apart else new
        if joined and not self.add(joined):
            apart += joined
        for p in apart:
            self.add([p], alone=True)
        self.figures = np.concatenate([self.figures, *self.new_figures])
        self.fits = np.concatenate([self.fits, np.array(self.new_fits, dtype=bool)])
        self.new_figures, self.new_fits = [], []

    def add(self, pieces: list[str], alone: bool = False) -> bool:
        """Adds entries for pieces that may be encoded as one text; False if that text isn't read back in full, unless there is but one."""
        text = " ".join(pieces)
        ids = [np.array(x, dtype=np.int64) for x in (self.encode_a(" " + text), self.encode_b(text))]
        given = (" " + text).encode()
        fits = all(b"".join(map(of.__getitem__, x.tolist())) == given for of, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
        if not fits and not alone:
            return False
        known = len(self.at)
        self.at.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        self.new_fits += [fits] * len(pieces)
        if not fits:
            self.new_figures.append(np.zeros((1, 4), np.int64))
            self.links.append(np.zeros(0, np.int64))
            self.names.append("")
            return True
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)]
        # between two neighbouring ends of any token there is one token of each
        cuts = np.union1d(*ends)
        at = [np.searchsorted(e, cuts) for e in ends]
        self.links.append(ids[0][at[0]] << 32 | ids[1][at[1]])
        group_ends = np.intersect1d(*ends, assume_unique=True)
        stops = np.cumsum([len(p.encode()) + 1 for p in pieces])
        upto = np.stack([np.searchsorted(x, stops, side="right") for x in (*ends, group_ends, cuts)], axis=1)
        self.new_figures.append(np.diff(upto, axis=0, prepend=0))
        if self.with_names:
            group = [np.searchsorted(group_ends, e) for e in ends]
            last = [np.append(g[1:] != g[:-1], True) for g in group]
            words = np.concatenate([np.where(z, of[1][x], of[0][x]) for of, x, z in zip(self.tokens, ids, last, strict=True)])
            order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
            whole = "".join(words[order].tolist())
            sizes = sum(np.concatenate([[0], np.cumsum(of[x])])[upto[:, k]] for k, (of, x) in enumerate(zip(self.token_sizes, ids, strict=True)))
            self.names += [whole[i:j] for i, j in zip([0, *sizes[:-1].tolist()], sizes.tolist(), strict=True)]
        return True

    def entries(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every piece of the texts, where each text's pieces begin, and which texts have tokens: neither null nor empty, and read back in full."""
        parts = [pieces_of(t) if t and SPACE_PIECE not in t else [] for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        missing = np.concatenate([[0], np.cumsum(~self.fits[at])])
        return at, starts, (sizes > 0) & (missing[starts[1:]] == missing[starts[:-1]])

    def is_full(self) -> bool:
        return len(self.fits) > CACHED


_MADE: dict[tuple[bytes, bytes], Aligner] = {}


def aligner_of(files: tuple[bytes, bytes], names: bool) -> Aligner:
    """This process's aligner, with nothing in its memory."""
    key = tuple(hashlib.sha256(f).digest() for f in files)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Aligner(*files)
    made = _MADE[key]
    made.clear()
    made.with_names = names
    return made


def _by_id(vocab: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = t
    return out


def _byte_bpe(a_file: bytes, a: dict, vocab: dict[bytes, int]):
    """Encodes with the first file's vocabulary: by ranks where ids follow the order of merges, which is faster, else by the file's own library."""
    slow = []

    def plain(text: str) -> list[int]:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_str(a_file.decode()))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    names, merges = a["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in a["model"]["merges"]]
    split = a["pre_tokenizer"]
    if any(names.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or split["type"] != "ByteLevel" or not split.get("use_regex", True) or split["add_prefix_space"] or a["normalizer"]:
        return plain
    import tiktoken

    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def ranked(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as stopped:  # its pattern gives up on very long runs of white space
            if isinstance(stopped, (KeyboardInterrupt, SystemExit)):
                raise
            return plain(text)

    return ranked


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """By B id alone, so that a bucket has all pairs of its B ids."""
    return (mix((keys & 0xFFFFFFFF).view(U64)) % U64(BUCKETS)).astype(np.int64)


def pair_counts(docs: DataFrame, text_col: str, files: tuple[bytes, bytes]) -> DataFrame:
    """Links of each pair as rows (part, bucket, keys, counts); a part is what a task gathers until its memory is full."""
    held = docs.sparkSession.sparkContext.broadcast(files)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen, task, flushed = aligner_of(held.value, names=False), np.zeros(0, np.int64), TaskContext.get().partitionId(), 0

        def gathered() -> pa.RecordBatch:
            times = np.repeat(seen, aligner.figures[:, 3])
            links = np.concatenate(aligner.links)[times > 0]
            order = np.argsort(links, kind="stable")
            first = np.flatnonzero(np.append(True, links[order][1:] != links[order][:-1]))
            keys, counts = links[order][first], np.add.reduceat(times[times > 0][order], first)
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            cuts = pa.array(np.append(starts, len(keys)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order], pa.int64())) for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), task << 32 | flushed), pa.int64()), pa.array(names, pa.int32()), *lists], names=["part", "bucket", "keys", "counts"])

        for batch in batches:
            for piece in slices(batch, text_col, SLICE):
                if aligner.is_full():
                    if seen.any():
                        yield gathered()
                        flushed += 1
                    aligner.clear()
                    seen = np.zeros(0, np.int64)
                at, starts, whole = aligner.entries(piece.column(text_col).to_pylist())
                at = at[np.repeat(whole, np.diff(starts))]
                seen = np.pad(seen, (0, len(aligner.fits) - len(seen))) + np.bincount(at, minlength=len(aligner.fits))
        if seen.any():
            yield gathered()

    return docs.select(text_col).mapInArrow(count, "part long, bucket int, keys array<long>, counts array<long>")


def hashed_pairs(parts: DataFrame) -> DataFrame:
    """Each bucket's hash of its distinct pairs and the keys by their number."""

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        by = PerfectHash.of(keys)
        placed = np.empty(len(keys), np.int64)
        placed[by(keys)] = keys
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "hash": [by.to_bytes()], "keys": [placed.tobytes()]}, schema=pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("keys", pa.binary())]))

    distinct = parts.select("bucket", F.explode("keys").alias("key")).distinct()
    return distinct.groupBy("bucket").applyInArrow(build, "bucket int, hash binary, keys binary")


def verified(by: PerfectHash, placed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys that all were hashed; another key is an error."""
    slot = by(keys)
    if len(keys) and ((slot < 0).any() or (placed[slot] != keys).any()):
        raise ValueError("a pair is missing from the table of pairs")
    return slot


def summed_counts(parts: DataFrame, hashes: DataFrame) -> DataFrame:
    """One dense vector of counts for each bucket, added up in a tree of tasks that take FAN vectors each."""
    schema, form = "bucket int, at long, vector binary", pa.schema([("bucket", pa.int32()), ("at", pa.int64()), ("vector", pa.binary())])

    def row(key: tuple, vector: np.ndarray) -> pa.Table:
        return pa.table({"bucket": [key[0].as_py()], "at": [key[1].as_py()], "vector": [vector.tobytes()]}, schema=form)

    def dense(key: tuple, counted: pa.Table, hashed: pa.Table) -> pa.Table:
        by, placed = PerfectHash.from_bytes(hashed.column("hash")[0].as_py()), np.frombuffer(hashed.column("keys")[0].as_py(), np.int64)
        vector = np.zeros(len(placed), np.int64)
        for keys, counts in zip(counted.column("keys"), counted.column("counts"), strict=True):
            vector[verified(by, placed, keys.values.to_numpy())] += counts.values.to_numpy()
        return row(key, vector)

    def added(key: tuple, group: pa.Table) -> pa.Table:
        return row(key, sum(np.frombuffer(v.as_py(), np.int64) for v in group.column("vector")))

    n = -(-parts.select("part").distinct().count() // FAN)
    left = parts.select("bucket", F.pmod(F.xxhash64("part"), F.lit(max(n, 1))).alias("at"), "keys", "counts")
    right = hashes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))))
    vectors = left.groupBy("bucket", "at").cogroup(right.groupBy("bucket", "at")).applyInArrow(dense, schema)
    while n > 1:
        n = -(-n // FAN)
        vectors = vectors.withColumn("at", F.pmod("at", F.lit(n))).groupBy("bucket", "at").applyInArrow(added, schema)
    return vectors.select("bucket", "vector")


def count_table(parts: DataFrame) -> DataFrame:
    """Rows (bucket, hash, keys, counts, best): by number, each pair's key, its links in the corpus and whether its B id has no pair with more."""
    hashes = cut(hashed_pairs(parts), "pair-hashes")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                _, b = np.unique(np.frombuffer(keys.as_py(), np.int64) & 0xFFFFFFFF, return_inverse=True)
                counts = np.frombuffer(counts.as_py(), np.int64)
                most = np.zeros(b.max() + 1, np.int64)
                np.maximum.at(most, b, counts)
                best.append((counts == most[b]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], names=["bucket", "hash", "keys", "counts", "best"])

    both = hashes.join(summed_counts(parts, hashes).withColumnRenamed("vector", "counts"), "bucket").select("bucket", "hash", "keys", "counts")
    return cut(both.mapInArrow(rated, "bucket int, hash binary, keys binary, counts binary, best binary"), "pair-counts")


class Counts:
    """The table of counts, held whole."""

    def __init__(self, rows: list):
        self.of = {r["bucket"]: (PerfectHash.from_bytes(bytes(r["hash"])), *(np.frombuffer(r[c], t) for c, t in (("keys", np.int64), ("counts", np.int64), ("best", bool)))) for r in rows}

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair and whether it is its B id's best."""
        keys, which = np.unique(keys, return_inverse=True)
        count, best, bucket = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), bucket_of(keys)
        for b in np.unique(bucket):
            at, (by, placed, counts, tops) = np.flatnonzero(bucket == b), self.of[int(b)]
            slot = verified(by, placed, keys[at])
            count[at], best[at] = counts[slot], tops[slot]
        return count[which], best[which]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _distinct_pairs(links: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> pa.Array:
    """Each text's distinct pairs and how often it has them."""
    out = []
    for i, j, w in zip(starts[:-1], starts[1:], whole, strict=True):
        own = at[i:j] if w else at[:0]
        n = sizes[own]
        keys, times = np.unique(links[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], return_counts=True)
        out.append([{"key": x, "n": y} for x, y in zip(keys.tolist(), times.tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))


def _documents(docs: DataFrame, id_col: str, text_col: str, files: tuple[bytes, bytes], rows: list | None) -> DataFrame:
    """The second pass: every document's figures; without the table of counts, its distinct pairs instead of what the table would say."""
    spark = docs.sparkSession
    held, table = spark.sparkContext.broadcast(files), None if rows is None else spark.sparkContext.broadcast(rows)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = aligner_of(held.value, names=True), None if table is None else Counts(table.value)
        figures = np.zeros((0, 6), np.int64)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                if aligner.is_full():
                    aligner.clear()
                    figures = figures[:0]
                batches_known, known = len(aligner.links), len(figures)
                at, starts, whole = aligner.entries(part.column(text_col).to_pylist())
                if len(aligner.fits) > known:
                    more = np.zeros((len(aligner.fits) - known, 6), np.int64)
                    more[:, :4] = aligner.figures[known:]
                    if counts:
                        count, best = counts(np.concatenate(aligner.links[batches_known:]))
                        ends = np.cumsum(more[:, 3])
                        for k, values in ((4, best), (5, count)):
                            total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
                            more[:, k] = total[ends] - total[ends - more[:, 3]]
                    figures = np.concatenate([figures, more])
                total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(figures[at], axis=0)])
                out = (total[starts[1:]] - total[starts[:-1]]) * whole[:, None]
                names = list(map(aligner.names.__getitem__, at.tolist()))
                digests = [hashlib.sha256("".join(names[i:j])[:-1].encode()).hexdigest() if w else "" for i, j, w in zip(starts[:-1].tolist(), starts[1:].tolist(), whole.tolist(), strict=True)]
                columns = [part.column(id_col), *(pa.array(out[:, k], pa.int64()) for k in range(6 if counts else 4)), pa.array(digests, pa.string())]
                if counts is None:
                    links, sizes = np.concatenate([*aligner.links, np.zeros(0, np.int64)]), aligner.figures[:, 3]
                    columns.append(_distinct_pairs(links, np.cumsum(sizes) - sizes, sizes, at, starts, whole))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(_FIGURES if counts else _FIGURES[:4]), "groups_sha256", *([] if counts else ["pairs"])])

    id_type = docs.schema[id_col].dataType.simpleString()
    wanted = ", ".join(f"{c} long" for c in (_FIGURES if rows is not None else _FIGURES[:4]))
    more = "" if rows is not None else ", pairs array<struct<key:long,n:long>>"
    return docs.select(id_col, text_col).mapInArrow(align, f"`{id_col}` {id_type}, {wanted}, groups_sha256 string{more}")


def _joined(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, files: tuple[bytes, bytes]) -> DataFrame:
    """The documents' figures where the table is too large to be held: pairs meet it in a shuffle, and the few very common ones without."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], t), k) for c, t, k in (("keys", np.int64, pa.int64()), ("counts", np.int64, pa.int64()), ("best", np.int8, pa.int8()))], names=["key", "count", "best"])

    aligned = cut(_documents(docs, id_col, text_col, files, None), "aligned").withColumn("row", F.monotonically_increasing_id())
    counted = table.select("keys", "counts", "best").mapInArrow(unpacked, "key long, count long, best tinyint")
    total = counted.agg(F.sum("count")).first()[0] or 0
    is_hot = F.col("count") * HOT_SHARE > F.lit(total)
    pairs = aligned.select("row", F.explode("pairs").alias("p")).select("row", "p.key", "p.n")
    hot = F.broadcast(counted.filter(is_hot).select("key", F.col("count").alias("hot_count"), F.col("best").alias("hot_best")))
    split = pairs.join(hot, "key", "left")
    met = split.filter("hot_count is null").select("row", "key", "n").join(counted.filter(~is_hot), "key").select("row", "n", "count", "best")
    met = met.unionByName(split.filter("hot_count is not null").select("row", "n", F.col("hot_count").alias("count"), F.col("hot_best").alias("best")))
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = aligned.drop("pairs").join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return out.select(id_col, *_FIGURES, "groups_sha256")


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, table_limit: int = TABLE_LIMIT) -> DataFrame:
    """One row for each row of docs: id_col, the figures of its tokens, groups and links, and the digest of its groups.

    A text that is null, empty or not read back in full by both tokenizers has
    no tokens: zeros and an empty digest. Rows are not merged: equal texts and
    repeated or null ids count each time. An empty table gives an empty table.
    Other columns, whatever their names, are left aside.
    """
    files = read_tokenizers(folder)
    own = docs.select(F.col(id_col), F.col(text_col))
    table = count_table(cut(pair_counts(own, text_col, files), "pair-parts"))
    size = table.agg(F.sum(sum(F.octet_length(c).cast("long") for c in ("hash", "keys", "counts", "best")))).first()[0] or 0
    if size > table_limit:
        return _joined(own, table, id_col, text_col, files)
    return _documents(own, id_col, text_col, files, table.collect())
