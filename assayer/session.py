"""Session helpers: sensible defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPREAD_BYTES = 128 << 20  # one split of a file, by Spark's default


def build_session(app_name: str = "assayer", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    ``master`` and resources are normally left to spark-submit; tests and the
    benchmark pass ``local[n]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the storage every executor can reach.

    The cluster names that storage in ``spark.checkpoint.dir``; where it is unset,
    the warehouse, which is shared as well, takes its place.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/assayer-{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to reliable storage once and reads it from there on."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def store_table(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` once to shared storage and reads it from there on; its size is then known to the planner."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as the side of the next join that grows with the data: both sides are shuffled by key and merged.

    The planner counts exploded rows once and every text as 20 bytes, so it can take such a table to be small and
    send it whole through the driver. Merged sides are bounded by their partitions, hot keys are split at run time.
    """
    return df.hint("merge")


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that a job has completely written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = (status.getPath() for status in system.listStatus(place) if status.isDirectory())
    return [folder.getName() for folder in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))]


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table out over all cores before costly row work.

    Small is what one task would read whole, at most ``SPREAD_BYTES`` by the planner's estimate. A larger table
    comes in several splits and is left as it is, so what is shuffled here never grows with the data.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df
