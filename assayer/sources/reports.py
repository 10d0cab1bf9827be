"""Reading and writing result reports: JSON documents, JSON lines, CSV."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions.text import fixed
from assayer.schemas import AGGREGATE, REPORT, RUN

# Report columns and the metadata keys that stay private.
RUN_COLUMNS = ("run_id", "task_id", "agent", "repeat", "passed", "score", "duration_s", "cost_usd", "error_kind")
AGGREGATE_COLUMNS = (
    "task_id", "agent", "repeats", "successes", "pass_at_1", "mean_score", "mean_duration_s", "mean_cost_usd",
)
PRIVATE_METADATA = ("task_version_hashes_json", "skipped_adapters_json")

KEEP_NULLS = {"ignoreNullFields": "false"}

# Sections of a document's lines in order; 2 and 4 close the lists.
_HEAD, _RUNS, _AGGREGATES = 0, 1, 3


def load_reports(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Report documents with a strict schema, one row each, and the file they came from.

    ``multi_line=False`` reads one document per line, which Spark can split.
    """
    docs = spark.read.schema(REPORT).option("multiLine", multi_line).option("mode", "FAILFAST").json(paths)
    return docs.withColumn("report", F.col("_metadata.file_path"))


def report_runs(reports: DataFrame, *keys: str) -> DataFrame:
    """Runs of the loaded reports."""
    return reports.select(*(keys or ("report",)), F.explode("runs").alias("run")).select(*(keys or ("report",)), "run.*")


def report_aggregates(reports: DataFrame, *keys: str) -> DataFrame:
    """Aggregates of the loaded reports; the interval as ``struct(low, high)``."""
    names = keys or ("report",)
    return _with_bounds(reports.select(*names, F.explode("aggregates").alias("a")).select(*names, "a.*"))


def _with_bounds(rows: DataFrame) -> DataFrame:
    bounds = F.struct(F.col("pass_at_1_ci95")[0].alias("low"), F.col("pass_at_1_ci95")[1].alias("high"))
    return rows.withColumn("pass_at_1_ci95", bounds)


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs by task, agent and repeat."""
    return runs.orderBy("task_id", "agent", "repeat")


def list_aggregates(aggregates: DataFrame) -> DataFrame:
    """Aggregates by agent and task."""
    return aggregates.orderBy("agent", "task_id")


def public_metadata(metadata: Column) -> Column:
    """Metadata map without the private keys."""
    return F.map_filter(metadata, lambda key, _: ~key.isin(*PRIVATE_METADATA))


def run_record(columns: Sequence[str]) -> Column:
    """Run as a struct in schema order; fields a table lacks are null."""
    return _record(RUN, columns)


def aggregate_record(columns: Sequence[str]) -> Column:
    """Aggregate as a struct in schema order, the interval as a two-element list."""
    return _record(AGGREGATE, columns, pass_at_1_ci95=F.array("pass_at_1_ci95.low", "pass_at_1_ci95.high"))


def _record(schema, columns: Sequence[str], **overrides: Column) -> Column:
    return F.struct(
        *[
            (overrides.get(f.name, F.col(f.name)) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def report_document_lines(
    runs: DataFrame, aggregates: DataFrame, run_id: str, generated_at: str, suite: Column, metadata: Column,
    schema_version: str = "1.0.0",
) -> DataFrame:
    """One report document as ordered text lines.

    Runs and aggregates stay distributed: each is one line, and a range sort puts
    the lines in place. The concatenated part files are one JSON document.
    """
    spark = runs.sparkSession
    head = F.to_json(
        F.struct(
            F.lit(schema_version).alias("schema_version"), F.lit(run_id).alias("run_id"),
            F.lit(generated_at).alias("generated_at"), suite.alias("suite"),
            public_metadata(metadata).alias("metadata"),
        ),
        KEEP_NULLS,
    )
    empty = [F.lit("").alias(c) for c in ("k1", "k2")] + [F.lit(0).alias("k3")]
    one = spark.range(1)
    opening = F.concat(F.expr("''"), F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"runs":['))
    frames = [one.select(F.lit(_HEAD).alias("section"), *empty, opening.alias("line"))]
    frames.append(_member_lines(runs, _RUNS, ("task_id", "agent", "repeat"), run_record(runs.columns)))
    frames.append(one.select(F.lit(2).alias("section"), *empty, F.lit('],"aggregates":[').alias("line")))
    frames.append(_member_lines(aggregates, _AGGREGATES, ("agent", "task_id", None), aggregate_record(aggregates.columns)))
    frames.append(one.select(F.lit(4).alias("section"), *empty, F.lit("]}").alias("line")))
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines.orderBy("section", "k1", "k2", "k3", "line")


def _member_lines(df: DataFrame, section: int, order: Sequence[str | None], record: Column) -> DataFrame:
    keys = [
        (F.lit(0) if name is None else F.col(name).cast("int" if place == 2 else "string")).alias(f"k{place + 1}")
        for place, name in enumerate(order)
    ]
    rows = df.select(F.lit(section).alias("section"), *keys, F.to_json(record, KEEP_NULLS).alias("json"))
    place = F.struct("k1", "k2", "k3", "json")
    first = rows.agg(F.min(place).alias("first")).scalar()
    line = F.concat(F.when(place == first, "").otherwise(","), F.col("json"))
    return rows.select("section", "k1", "k2", "k3", line.alias("line"))


def write_report_document(lines: DataFrame, path: str) -> None:
    """Writes the lines of a document in order, a folder a section; commit is atomic per write.

    The part files in order of their paths are one JSON document, and :func:`load_report_parts` reads them in parallel.
    """
    lines.select("section", "line").write.mode("overwrite").partitionBy("section").text(path)


@dataclass(frozen=True)
class ReportParts:
    """Report documents of many part files: rows of ``head``, ``runs`` and ``aggregates`` name their ``report`` folder."""

    head: DataFrame
    runs: DataFrame
    aggregates: DataFrame


def load_report_parts(spark: SparkSession, paths: str | Sequence[str]) -> ReportParts:
    """Loads documents that :func:`write_report_document` wrote, with the strict schema of :func:`load_reports`.

    A section is read from its own files, a member a line, so a document of any size is split like any table.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/section=", 1)

    def section(number: int) -> DataFrame:
        where = [paths] if isinstance(paths, str) else list(paths)
        return spark.read.text([f"{path.rstrip('/')}/section={number}" for path in where]).select(folder.alias("report"), F.col("value").alias("line"))

    def parsed(rows: DataFrame, json: Column, schema: StructType) -> DataFrame:
        return rows.select("report", F.from_json(json, schema, {"mode": "FAILFAST"}).alias("row")).select("report", "row.*")

    member = F.regexp_replace("line", "^,", "")
    head = StructType([f for f in REPORT if f.name not in ("runs", "aggregates")])
    closed = F.concat(F.regexp_replace("line", r',"runs":\[$', ""), F.lit("}"))
    return ReportParts(
        parsed(section(_HEAD), closed, head), parsed(section(_RUNS), member, RUN), _with_bounds(parsed(section(_AGGREGATES), member, AGGREGATE)),
    )


def runs_jsonl(runs: DataFrame) -> DataFrame:
    """Runs as JSON lines in stable order, null fields kept."""
    return list_runs(runs).select(F.to_json(run_record(runs.columns), KEEP_NULLS).alias("value"))


def append_runs_jsonl(runs: DataFrame, path: str) -> None:
    """Appends finished runs to a folder of JSON-lines files."""
    runs.select(F.to_json(run_record(runs.columns), KEEP_NULLS).alias("value")).write.mode("append").text(path)


def runs_csv(runs: DataFrame) -> DataFrame:
    """Nine run columns as CSV text, an unknown cost left empty."""
    numbers = {name: _csv_number(name) for name in ("score", "duration_s", "cost_usd")}
    flag = F.initcap(F.col("passed").cast("string"))
    return list_runs(runs).select(
        *[{**numbers, "passed": flag}.get(c, F.col(c)).cast("string").alias(c) for c in RUN_COLUMNS]
    )


def aggregates_csv(aggregates: DataFrame) -> DataFrame:
    """Eight aggregate columns as CSV text."""
    numbers = {name: _csv_number(name) for name in ("pass_at_1", "mean_score", "mean_duration_s", "mean_cost_usd")}
    return list_aggregates(aggregates).select(
        *[numbers.get(c, F.col(c)).cast("string").alias(c) for c in AGGREGATE_COLUMNS]
    )


def _csv_number(name: str) -> Column:
    return F.coalesce(fixed(F.col(name), 6), F.lit(""))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header; empty and null are both written as nothing."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def replace_aggregates(aggregates: DataFrame, path: str) -> None:
    """Replaces the stored aggregates by a new set."""
    aggregates.write.mode("overwrite").parquet(path)

