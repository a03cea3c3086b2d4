"""WARC archives, compressed record by record with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary built from
a bounded sample of the archive's own records; every record follows as a frame
of its own. Records whose payload an earlier-written page with a larger id
holds as well become revisit records without a body.

Archives are written by the tasks into one shared folder under names that
follow from the partition, and moved to their names when complete: a task that
runs again writes its rows in the same order and replaces its own archives.
Those that the index of the committed tasks names are read back with Spark's binary
file reader, so any file system that Spark knows can hold them. Page ids of
any type that text can be cast back to stand in the records as escaped text.

Defined results: a null payload is the empty one; a null URL is written as an
empty target; copies below 1000 bytes are all responses; rows repeated with
the same id and payload get the same record type; an empty table gives no
archive and an empty result; payloads are archived whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 48 << 10
SAMPLE_BYTES = 1 << 20
SKIPPABLE_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, archive string"
_NO_ID = "<urn:nopage>"


def _id(page_id: str | int | None) -> str:
    return _NO_ID if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _page(urn: str) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn != _NO_ID else None


def record(page_id: str | int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: str | int | None) -> bytes:
    """One WARC record: a response, or a revisit if it refers to another page."""
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """A whole archive: dictionary frame, then a frame for each record."""
    samples, size, step = [], 0, max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        samples += [r[i : i + 4096] for i in range(0, min(len(r), 65536), 4096)]
        size += min(len(r), 65536)
        if size > SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the records themselves serve as a raw dictionary
        dictionary = b"".join(records)[: DICTIONARY_BYTES // 4]
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=3)
    packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)), dictionary, *map(packer.compress, records)])


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order: header fields and body."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("not an archive: no dictionary frame")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    with io.BufferedReader(opener.stream_reader(memoryview(content)[8 + size :], read_across_frames=True), 1 << 18) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            fields = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            yield fields, stream.read(int(fields["Content-Length"]))


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The pages with payload, digest and, for copies, the page that they refer to."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    many = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = cut(many, "copied")
    # payloads that very many pages hold are joined in parts; there are fewer than HOT_SHARE of them
    hot = F.broadcast(copied.filter(F.col("n") * HOT_SHARE > pages.count()).select("digest", F.lit(SPLITS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, "digest", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("parts")
    copied = copied.join(hot, "digest", "left").select("digest", "newest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    typed = rows.join(copied, ["digest", "part"], "left")
    return typed.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("newest")), None).otherwise(F.col("newest"))).drop("newest", "part")


HOT_SHARE = 1000
SPLITS = 64


def write_archives(typed: DataFrame, folder: str, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all records; returns page_id, archive and record number, as kept in the folder's index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        pending: list[tuple[str | None, bytes]] = []
        n = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, size
            name = f"part-{part:06d}-{n:04d}.warc.zst"
            temporary = f"{root}/_unfinished-{name}-{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(temporary) as out:
                out.write(archive_bytes([r for _, r in pending]))
            files.move(temporary, f"{root}/{name}")
            index = pa.RecordBatch.from_arrays([pa.array([p for p, _ in pending], pa.string()), pa.array([name] * len(pending), pa.string()), pa.array(range(len(pending)), pa.int64())], names=["page_id", "archive", "record"])
            pending.clear()
            n, size = n + 1, 0
            return index

        for batch in batches:
            for page_id, url, payload, n_bytes, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "n_bytes", "digest", "refers_to")), strict=True):
                made = record(page_id.as_py(), url.as_py(), payload.as_py(), n_bytes.as_py(), digest.as_py(), refers_to.as_py())
                pending.append((page_id.as_py(), made))
                size += len(made)
                if size >= archive_size:
                    yield flush()
        if pending:
            yield flush()

    lean = typed.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    # in a fixed order, so that a task that runs again writes the same archives
    lean = lean.select(F.col("page_id").cast("string"), "url", "payload", "n_bytes", "digest", F.col("refers_to").cast("string")).sortWithinPartitions("digest", "page_id", "url")
    kind = typed.schema["page_id"].dataType
    index = lean.mapInArrow(write, "page_id string, archive string, record long").withColumn("page_id", F.col("page_id").cast(kind))
    index.write.mode("overwrite").parquet(f"{folder}/_index")
    return typed.sparkSession.read.schema(index.schema).parquet(f"{folder}/_index")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """Every record of the archives that a folder's index names, its ids cast to their type; payloads of responses are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for fields, block in read_archive(content.as_py()):
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    n_bytes = int(head.rpartition(b"Content-Length: ")[2])
                    if fields["WARC-Type"] == "response" and (len(body) != n_bytes or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], n_bytes, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To", "")), body if with_payload else None, path.as_py()))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).withColumn("archive", F.element_at(F.split("path", "/"), -1))
    index = spark.read.schema("archive string").parquet(f"{folder}/_index")
    stray = [r.archive for r in files.select("archive").join(index, "archive", "left_anti").collect()]  # of tasks that were lost, a few at most
    if stray:
        files = files.filter(~F.col("archive").isin(stray))
    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
