"""Structured Streaming forms of the run pipeline.

Sinks write one folder per micro-batch and overwrite it when a batch is replayed,
so every result is exactly once after a lost executor or a restarted query. Keyed
state is a table saved in steps (``operators.saved``), whose readers open a bounded
number of folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from assayer.functions.text import scrub
from assayer.operators import saved
from assayer.operators.planning import admit_within_budget
from assayer.operators.scoring import count_runs
from assayer.operators.scrubbing import Registry, scrub_with_registry
from assayer.session import committed_folders


def stream_runs(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Run rows as JSON-lines files arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _write_batch(path: str, prepare: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _keep(stream: DataStreamWriter, path: str, checkpoint: str, keys: Sequence[str], order: list[Column], merge_every: int) -> DataStreamWriter:
    return stream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: saved.save(batch, path, keys, order, batch_id, merge_every) and None
    )


def upsert(
    runs: DataFrame, path: str, checkpoint: str, keys: Sequence[str], newest_first: Sequence[str], merge_every: int = saved.MERGE_EVERY
) -> DataStreamWriter:
    """Last-wins sink: the newest row per key, over all batches."""
    return _keep(runs.writeStream, path, checkpoint, keys, saved.newest_first(*newest_first), merge_every)


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """Current state of an upsert sink."""
    return saved.read(spark, path, keys, saved.newest_first(*newest_first))


def first_wins(
    runs: DataFrame, path: str, checkpoint: str, keys: Sequence[str], oldest_first: Sequence[str], merge_every: int = saved.MERGE_EVERY
) -> DataStreamWriter:
    """First-wins sink: the oldest row per key of its earliest batch; no row is too late to be written."""
    return _keep(runs.writeStream, path, checkpoint, keys, saved.oldest_first(*oldest_first), merge_every)


def read_first(spark: SparkSession, path: str, keys: Sequence[str], oldest_first: Sequence[str]) -> DataFrame:
    """First arrival of each key of a first-wins sink."""
    return saved.read(spark, path, keys, saved.oldest_first(*oldest_first))


def live_counts(runs: DataFrame, keys: Sequence[str] = ("task_id", "agent")) -> DataFrame:
    """Running counts and sums per group; derive the metrics when reading."""
    return count_runs(runs, keys)


def write_live_counts(
    counts: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("task_id", "agent"), merge_every: int = saved.MERGE_EVERY
) -> DataStreamWriter:
    """Sink for :func:`live_counts`: a batch brings the groups that changed, the last one of each counts."""
    return _keep(counts.writeStream.outputMode("update"), path, checkpoint, keys, saved.newest_first(), merge_every)


def read_live_counts(spark: SparkSession, path: str, keys: Sequence[str] = ("task_id", "agent")) -> DataFrame:
    """Current counts of all groups."""
    return saved.read(spark, path, keys, saved.newest_first())


def spend_cap(runs: DataFrame, path: str, checkpoint: str, cap: float, suite: str, order: Sequence[str]) -> DataStreamWriter:
    """Marks each run as admitted while the suite's known spend is below ``cap``.

    What each suite has spent before a batch is one row in the totals of the batch before it, the only ones
    that are read; a batch writes the totals of all suites after it. Inside a batch the spend runs in ``order``.
    """
    money = "decimal(18,6)"
    zero = F.lit(0).cast(money)

    def mark(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [int(name.removeprefix("totals-")) for name in committed_folders(spark, path) if name.startswith("totals-")]
        last = max((n for n in done if n < batch_id), default=None)
        fresh = batch.groupBy(suite).agg(F.sum(F.coalesce(F.col("cost_usd").cast(money), zero)).cast(money).alias("spend"))
        before = fresh.limit(0) if last is None else spark.read.parquet(f"{path}/totals-{last}")
        carried = before.select(suite, F.col("spend").alias("carried"))
        batch.persist()
        try:
            inside = admit_within_budget(batch, cap, [suite], order)
            total = F.col("spent_before") + F.coalesce("carried", zero)
            admitted = total < F.lit(str(cap)).cast(money)
            inside.join(carried, suite, "left").withColumns(
                {
                    "spent_before": total.cast(money),
                    "admitted": admitted,
                    "shutdown_reason": F.when(~admitted, "budget_exceeded"),
                }
            ).drop("carried").write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")
            totals = before.union(fresh).groupBy(suite).agg(F.sum("spend").cast(money).alias("spend"))
            totals.write.mode("overwrite").parquet(f"{path}/totals-{batch_id}")
        finally:
            batch.unpersist()

    return runs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(mark)


def scrub_stream(chunks: DataFrame, column: str, registry: Column | None = None) -> DataFrame:
    """Scrubs log chunks as they arrive, with a caller's few secrets; no state, no shuffle."""
    return chunks.withColumn(column, scrub(F.col(column), registry))


def scrub_arrivals(chunks: DataFrame, column: str, registry: Registry, path: str, checkpoint: str) -> DataStreamWriter:
    """Scrubs log chunks as they arrive with an indexed registry of any size.

    Each batch is joined with the stored index, which is built once; a replayed batch overwrites its folder.
    """
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        _write_batch(path, lambda batch, _: scrub_with_registry(batch, column, registry))
    )
