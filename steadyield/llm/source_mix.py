"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order that their ids and a seed
decide. A document's virtual finish time is the source's cumulative size up to
it, further passes over the source included, divided by the source's target.
Serving by finish time keeps all sources in step with their targets, and when
virtual time reaches 1 the total budget is spent: that is where the queue is
cut. A whole document is served if its middle lies before the cut, which leaves
each source within half a document of its target.

The running sums need no task to hold a source: documents fall into buckets by
their place in the shuffle, sums of buckets are summed up per source, and only
the rows of one bucket of one source are summed one by one.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows repeated with the same id queue side by
side, each a document; an empty table gives an empty result; a source without
words gets the target 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from steadyield.llm.lineage import cut
from steadyield.llm.textops import slices, texts_of, words_of

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKET_DIGITS = 3
SEED = "mix-1"


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words of each text; null counts as empty."""
    batch = pa.RecordBatch.from_arrays([text], names=["t"])
    return pa.concat_arrays([pa.array(words_of(texts_of(b.column("t"))).counts(), pa.int64()) for b in slices(batch, "t")] or [pa.array([], pa.int64())])


def place(id_col: str | Column, seed: str = SEED) -> Column:
    """Place in the shuffle, as hexadecimal digits."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Source, source_size and target of each source from rows (source, size).

    Sources in code-point order weigh 5, 2, 1 and so on; targets share the sum
    of all sizes by weight and stop at max_passes times the source's size, the
    excess going to the others. Filling up sources by rising cap per weight,
    the first whose share does not reach its cap sets the share of all the
    rest. The windows run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    shares = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", max_passes * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(filled))
        .withColumn("open", F.col("cap").cast("double") * F.col("left_weight") > (F.col("total") - F.col("before")).cast("double") * F.col("weight"))
    )
    first = F.min(F.when(F.col("open"), F.struct("rank", "before", "left_weight"))).over(everything)
    share = ((F.col("total") - F.col("first.before")) * F.col("weight")).cast("double") / F.col("first.left_weight")
    capped = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    return shares.withColumn("first", first).select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_passes: int = MAX_PASSES, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document's id, the carried columns, size, source_size, target, copies taken, taken words and the finish time of its first pass.

    A carried column keeps its name whatever it is, unless it is that of the id or of a result, which then stands for it.
    """
    results = ("size", "source_size", "target", "copies", "taken", "finish")
    carried = {name: f"__carry{k}" for k, name in enumerate(carry) if name not in (id_col, *results)}
    kept = [F.col(name).alias(inner) for name, inner in carried.items()]
    lean = docs.select(F.col(id_col).alias("__id"), *kept, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(id_col, seed).alias("__place"))
    sized = cut(lean, "mix-sizes").withColumn("__bucket", F.substring("__place", 1, BUCKET_DIGITS))
    sums = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__earlier", F.coalesce(earlier, F.lit(0))).alias("s").join(source_targets(sized, max_passes=max_passes).alias("t"), F.expr("s.source <=> t.source")).select("s.source", "s.__bucket", "__earlier", "source_size", "target")
    rows = sized.alias("d").join(sums.alias("s"), F.expr("d.source <=> s.source AND d.__bucket = s.__bucket")).select("d.*", "__earlier", "source_size", "target")
    within = Window.partitionBy("source", "__bucket").orderBy("__place", "__id", "size", *carried.values()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.col("__earlier") + F.sum("size").over(within))
    served = lambda k: ((2 * (k * F.col("source_size") + F.col("__upto")) - F.col("size")).cast("double") < 2 * F.col("target")) & (F.col("size") > 0)
    copies = sum((F.when(served(k), 1).otherwise(0) for k in range(1, max_passes)), F.when(served(0), 1).otherwise(0))
    out = rows.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).withColumn("finish", F.try_divide(F.col("__upto"), F.col("target")))
    return out.select(F.col("__id").alias(id_col), *(F.col(inner).alias(name) for name, inner in carried.items()), *results)


def queue(served: DataFrame, ordered: bool = True) -> DataFrame:
    """One row for each serving of a document with its finish time, in global order if asked for; needs the result of mix_sources."""
    passes = served.filter("copies > 0").withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    passes = passes.withColumn("finish", F.col("finish") + F.col("__pass") * F.col("source_size") / F.col("target")).drop("__pass")
    return passes.orderBy("finish") if ordered else passes
