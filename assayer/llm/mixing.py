"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight, but none takes more than ``max_epochs`` times its size.
What a clamped source leaves is shared again among the others by weight until no target is above its
limit. The level of the water only rises, so the clamped sources follow from the level alone and one
round is one aggregate over the table of sources.

A source's rate, target over size, is split in whole repetitions of every document and a fraction.
The fraction is a seeded choice of hash buckets whose sizes add up nearest to what is missing, found
on a histogram of fixed size per source. A hot source is therefore never gathered: its documents are
reduced to bucket sums in the tasks that read them.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a
source of size 0 has target 0; a null doc_id falls in one bucket; repeated rows share a bucket and
are taken together. An empty table gives no rows. Input columns stay in the struct ``row``. If all
sources are clamped, the rest of the budget is left over. The choice depends on doc_id and seed only,
so reruns agree under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import store, words_of

BUCKETS = 4096  # three hex digits of the hash


def bucket(doc_id: Column, seed: int) -> Column:
    """Seeded bucket of a document, 0 to 4095."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("int")


def ranked_weights(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds the weights to (source, source_size) rows in code point order, null last, repeating."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight) rows; one small job per round."""
    cap, level = F.col("source_size") * F.lit(float(max_epochs)), 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        taken, open_weight = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        risen = (budget - (taken or 0.0)) / open_weight
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies): how often the mix takes each document.

    ``share`` is the budget as a multiple of all sizes. Sizes are words.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"), bucket(F.col(doc_id), seed).alias("bucket"),
    )
    histogram = store(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-histogram")
    sizes = histogram.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = store(ranked_weights(sizes, weights), "mix-sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = water_fill(weighted, share * total, max_epochs).withColumn("whole", F.floor(rate).cast("int"))
    plan = filled.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    before = F.col("upto") - F.col("size")
    near = (F.col("missing") > 0) & (F.col("upto") <= F.col("missing")) | ((before < F.col("missing")) & (F.col("upto") - F.col("missing") <= F.col("missing") - before))
    cuts = (
        histogram.withColumn("upto", upto).join(plan.select(F.col("source").alias("of"), "missing"), F.col("source").eqNullSafe(F.col("of")))
        .groupBy("of").agg(F.max(F.when(near, F.col("bucket"))).alias("last"))
    )
    rules = store(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select(
            F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last")
        ),
        "mix-plan",
    )
    copies = F.col("whole") + (F.col("bucket") <= F.col("last")).cast("int")
    return rows.join(rules, F.col("source").eqNullSafe(F.col("of"))).select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it was taken, with their own columns."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
