"""Latest-wins tables: replace semantics on append-only storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import keys as key_functions


def latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The newest row per key.

    ``row_number() = 1`` is planned with a group limit on both sides of the
    shuffle, so each map task ships at most one row per key however hot it is.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def with_run_key(runs: DataFrame) -> DataFrame:
    """Adds the content key of each run."""
    names = ("task_id", "agent", "repeat", "seed", "task_version_hash", "env_manifest_hash")
    return runs.withColumn("run_key", key_functions.run_key(**{name: F.col(name) for name in names}))


def merge_runs(stored: DataFrame, incoming: DataFrame, version: str = "created_at") -> DataFrame:
    """Stored runs with the incoming ones replacing those of equal ``run_key``."""
    newest = [F.col(version).desc(), F.col("__source").desc(), F.hash(F.struct("*")).desc()]
    both = stored.withColumn("__source", F.lit(0)).unionByName(incoming.withColumn("__source", F.lit(1)))
    return latest(both, ["run_key"], newest).drop("__source")


def child_checks(runs: DataFrame, *parent: str) -> DataFrame:
    """Check rows of a deduplicated run table; children lie in their parent's row and bring its columns along."""
    return runs.select("run_key", *parent, F.posexplode("checks").alias("position", "check")).select("run_key", *parent, "position", "check.*")


def latest_cell(runs: DataFrame, version: str = "created_at") -> DataFrame:
    """Newest run per (task, agent, repeat); ties go to the greater ``run_key``."""
    return latest(
        runs, ["task_id", "agent", "repeat"], [F.col(version).desc(), F.col("run_key").desc()]
    )


def set_metadata(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Key-value upsert: the value with the greatest ``version`` stays."""
    both = stored.unionByName(incoming)
    return both.groupBy(*keys).agg(
        F.max(F.struct("version", "value")).alias("newest")
    ).select(*keys, "newest.value", "newest.version")


def metadata_map(entries: DataFrame, suite: Sequence[str]) -> DataFrame:
    """One map per suite; a suite has a handful of keys by design."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return entries.groupBy(*suite).agg(F.map_from_entries(pairs).alias("metadata"))
