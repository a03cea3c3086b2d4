"""Secret scan with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger
says which rule versions have seen which blob and what they found. A run scans
only the pairs of blob and rule version that the ledger lacks, each distinct
blob once however many documents hold it, and joins the findings back to all
documents. Blobs that very many documents hold are joined in parts.

Defined results: a null text is scanned as the empty one and has no findings;
equal texts share one scan and get the same findings, under whatever ids;
null or repeated ids are kept as they are; an empty table gives an empty
result; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut


@dataclass(frozen=True)
class SecretRule:
    """Leftmost matches that do not overlap count if the given group has so many characters."""

    kind: str
    version: int
    pattern: str
    min_chars: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self):
        seek = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer
        group, least = self.group, self.min_chars

        def find(text: str) -> Iterator[tuple[int, int]]:
            for m in seek(text):
                start, end = m.span(group)
                if end - start >= least:
                    yield m.span()

        return find


# Runs are maximal, so a lower bound on a run's length can stand in its pattern where a shorter run blocks no other match.
BASE_RULES = (
    SecretRule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", 1, r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    SecretRule("forge", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<rank:int,rule:string,kind:string,start:long,end:long>>"
LEDGER_SCHEMA = f"blob string, done array<string>, spans {_SPANS}"


def scan_new_blobs(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that the ledger has not."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("blob", F.sha2("t", 256))
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("t").alias("t")).withColumn("missing", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("done"))).alias("seen"))
        once = blobs.groupBy("blob").agg(F.first("t").alias("t"))
        todo = once.join(seen, "blob", "left").withColumn("missing", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("missing") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(k, r.kind, r.key, r.finder()) for k, r in enumerate(rules)]
        for batch in batches:
            found = []
            for text, missing in zip(batch.column("t"), batch.column("missing").to_pylist(), strict=True):
                text = text.as_py()
                found.append([{"rank": k, "rule": key, "kind": kind, "start": s, "end": e} for k, kind, key, find in finders if key in missing for s, e in find(text)])
            kind = pa.list_(pa.struct([("rank", pa.int32()), ("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("missing"), pa.array(found, kind)], names=["blob", "done", "spans"])

    return todo.select("blob", "missing", "t").mapInArrow(scan, LEDGER_SCHEMA)


def update_ledger(docs: DataFrame, folder: str, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Adds what the ledger in a shared folder lacks on these documents and reads the whole of it."""
    spark = docs.sparkSession
    try:
        ledger = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # a ledger that can't be read is not scanned anew
            raise
        ledger = None
    scan_new_blobs(docs, ledger, text_col, rules).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder)


HOT_SHARE = 1000  # a blob that more than one in so many rows hold is joined in SPLITS parts; there are fewer such blobs than this
SPLITS = 64


def find_secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Each document's id, blob address and spans by start and rule order, from ledger rows that cover all its blobs; findings of other rule versions are left out."""
    keys = [r.key for r in rules]
    hits = findings.filter(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    ordered = F.array_sort(F.transform(F.filter("spans", lambda s: s["rule"].isin(keys)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    hits = hits.select("blob", ordered.alias("spans"))
    paths = cut(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob")), "paths")
    many = paths.groupBy("blob").count().filter(F.col("count") * HOT_SHARE > paths.count()).select("blob", F.lit(SPLITS).alias("parts"))
    hot = F.broadcast(cut(many, "hot-blobs"))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    paths = paths.join(hot, "blob", "left").select("id", "blob", part)
    hits = hits.join(hot, "blob", "left").select("blob", "spans", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return paths.join(hits, ["blob", "part"], "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: str | F.Column) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
