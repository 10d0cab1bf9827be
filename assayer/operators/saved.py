"""A keyed table that is saved in steps: the first row of each key, in a given order, is its state.

A step is one folder, written by Spark's commit protocol and counted only once it is complete, so a step
that was lost half-way is simply saved again and changes nothing. A step holds the rows that it brought and
is written where they are, without a shuffle. Every ``merge_every`` steps it holds the whole state instead:
of the last such base, the steps since and its own rows the first per key, found in one shuffle. Readers open
the last base and the steps after it, never more than ``merge_every`` folders however many steps there were,
and rank their rows; older folders can be removed. Folders are compressed with zstd, which halves hashes in hex.

The number of a step is the id of a stream's batch, or the next free one for a batch job. Rows carry it as
``step`` while they are ordered, so an order can prefer earlier or later arrivals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.latest import latest
from assayer.session import committed_folders

MERGE_EVERY = 16
STEP = "step"


def newest_first(*columns: str) -> list[Column]:
    """Order of a last-wins table: the greatest values first, of equal ones the later step."""
    return [F.col(c).desc() for c in (*columns, STEP)]


def oldest_first(*columns: str) -> list[Column]:
    """Order of a first-wins table: the earlier step first, then the smallest values."""
    return [F.col(c).asc() for c in (STEP, *columns)]


def _steps(spark: SparkSession, path: str) -> dict[int, str]:
    """Complete steps and their kinds, from the names of the folders."""
    names = (name.split("-") for name in committed_folders(spark, path) if name.startswith(("base-", "part-")))
    return {int(number): kind for kind, number in sorted(names, reverse=True)}  # a base before a part of the same number


def _open(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of the last base and the steps since, each with its step."""
    steps = {n: kind for n, kind in _steps(spark, path).items() if before is None or n < before}
    start = max((n for n, kind in steps.items() if kind == "base"), default=0)
    rows = None
    for number in sorted(n for n in steps if n >= start):
        folder = spark.read.parquet(f"{path}/{steps[number]}-{number}").withColumn(STEP, F.lit(number).cast("long"))
        rows = folder if rows is None else rows.unionByName(folder)
    return rows


def save(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], step: int | None = None, merge_every: int = MERGE_EVERY) -> int:
    """Saves one step and returns its number. A step that is saved again is written again."""
    spark = rows.sparkSession
    if step is None:
        step = max(_steps(spark, path), default=-1) + 1
    merging = step % merge_every == merge_every - 1
    if merging:
        own, earlier = rows.withColumn(STEP, F.lit(step).cast("long")), _open(spark, path, before=step)
        rows = latest(own if earlier is None else earlier.unionByName(own), keys, order).drop(STEP)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{'base' if merging else 'part'}-{step}")
    return step


def read(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The state: one row per key."""
    rows = _open(spark, path)
    if rows is None:
        raise ValueError(f"nothing has been saved in {path}")
    return latest(rows, keys, order).drop(STEP)


def save_runs(runs: DataFrame, path: str, version: str = "created_at", ties: Sequence[str] = (), step: int | None = None) -> int:
    """Saves runs with their checks inside; a run replaces the stored one of its ``run_key``, children and all."""
    return save(runs, path, ["run_key"], newest_first(version, *ties), step)


def read_runs(spark: SparkSession, path: str, version: str = "created_at", ties: Sequence[str] = ()) -> DataFrame:
    """The stored runs, one per ``run_key``."""
    return read(spark, path, ["run_key"], newest_first(version, *ties))
