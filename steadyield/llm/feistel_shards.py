"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their ids. A keyed Feistel network permutes
the smallest even-width binary range that holds all numbers; a value beyond
the last number is sent through again until it falls within (cycle walking),
so the numbers themselves are permuted. The permuted number p gives shard
p mod n and slot p div n: counts are at most one apart, slots have no gaps,
and both can be computed for any row number without a shuffle of the texts.

Defined results: null ids are numbered first; rows with equal id, size and
checksum are interchangeable and get neighbouring numbers; a null text has no
bytes and the checksum 0; an empty table gives an empty result; columns called
shard and slot give way to the new ones, all others stay. The law is
rows, so copies of one text may lie in different shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyield.llm.lineage import cut

SHARDS = 24
KEYS = (0x3C6EF372, 0x1B873593, 0x27D4EB2F, 0x165667B1)


def half_width(n: int) -> int:
    """Bits in each half of the range that holds the numbers below n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, keys: tuple[int, ...] = KEYS) -> np.ndarray:
    """One pass through the network: a permutation of the numbers of 2 * half bits."""
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for key in keys:
        mixed = ((right + 1) * key + (key >> 7)) & 0x7FFFFFFF
        left, right = right, left ^ ((((mixed >> 15) ^ mixed) * 0x2545F & 0x7FFFFFFF) >> 3 & mask)
    return (left << half) | right


def permute(x: np.ndarray, n: int, keys: tuple[int, ...] = KEYS) -> np.ndarray:
    """The permuted numbers, all below n like the numbers given."""
    half = half_width(n)
    out = feistel(x.astype(np.int64), half, keys)
    while (beyond := out >= n).any():
        out[beyond] = feistel(out[beyond], half, keys)
    return out


def numbered(rows: DataFrame, *order: Column | str, name: str = "row_number") -> tuple[DataFrame, int]:
    """The rows with their global number from 0 in the given order, and how many there are.

    A range sort places them, each partition counts its own, and one sum for
    each partition is added; no task sees more than a partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = cut(placed.withColumn("__part", F.spark_partition_id()).withColumn("__local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sums = local.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sums.select("__part", "count", before.alias("__before")), "starts")  # a row for each partition
    total = starts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    out = local.join(F.broadcast(starts.drop("count")), "__part").withColumn(name, F.col("__before") + F.col("__local"))
    return out.drop("__part", "__local", "__before"), int(total)


def shard_rows(rows: DataFrame, *order: Column | str, shards: int = SHARDS) -> DataFrame:
    """The rows with shard and slot in place of any such columns, of equal counts by at most one; order must tell apart all rows that differ."""
    with_number, total = numbered(rows.drop("shard", "slot"), *order, name="__number")

    @F.arrow_udf("long")
    def moved(number: pa.Array) -> pa.Array:
        return pa.array(permute(np.asarray(number), total))

    p = with_number.withColumn("__p", moved("__number"))
    return p.withColumn("shard", (F.col("__p") % shards).cast("int")).withColumn("slot", F.floor(F.col("__p") / shards).cast("long")).drop("__p", "__number")
