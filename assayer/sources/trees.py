"""Scanning file trees, manifests and archives into tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.paths import EXCLUDED_DIRS, has_excluded_segment
from assayer.schemas import TASK
from assayer.session import spread
from assayer.sources import listing

MANIFEST_NAME = "task.yaml"


def scan_tree(spark: SparkSession, root: str, tree_id: str, excluded: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """Files below ``root`` in the shape of ``schemas.FILE``.

    On mounted storage the listing brings links, special files and permission bits, and excluded directories
    are never entered. Object stores have none of these: there the files are scanned and excluded paths dropped.
    """
    if "://" not in root or root.startswith("file:"):
        place = re.sub("^file:/*", "/", root)
        return listing.read_contents(listing.list_trees(spark.createDataFrame([(tree_id, place)], "tree_id string, root string"), excluded))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.expr("substring(path, locate({0}, path) + length({0}))".format("'" + base.replace("'", "\\'") + "'"))
    files = found.select(path.alias("path"), "length", "content").filter(~has_excluded_segment(F.col("path"), excluded))
    return files.select(
        F.lit(tree_id).alias("tree_id"), "path", F.lit("file").alias("kind"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size"), F.lit(False).alias("executable"), "content",
    )


def scan_manifests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(dir, content) of the manifests at or below files, directories or globs.

    A directory that has a manifest itself is not searched any further.
    """
    frames = [_below(spark, path.rstrip("/")) for path in paths]
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return discover(found)


def _below(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", MANIFEST_NAME).load(path)
    depth = len([part for part in path.split("://")[-1].removeprefix("file:").split("/") if part])
    local = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    placed = files.select(local.alias("path"), "content").withColumn(
        "__root", F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split("path", "/"), lambda p: p != ""), 1, depth), "/"))
    )
    own = placed.filter(F.col("path") == F.concat("__root", F.lit(f"/{MANIFEST_NAME}"))).select("__root").withColumn("__own", F.lit(True))
    nearest = placed.join(own, "__root", "left").filter(
        F.col("__own").isNull() | (F.col("path") == F.concat("__root", F.lit(f"/{MANIFEST_NAME}")))
    )
    return nearest.select("path", "content")


def discover(files: DataFrame) -> DataFrame:
    """Manifest directories of a file table, each once."""
    manifests = files.filter(F.substring_index("path", "/", -1) == MANIFEST_NAME)
    directory = F.regexp_replace("path", f"/?{MANIFEST_NAME}$", "")
    return manifests.withColumn("dir", directory).groupBy("dir").agg(F.any_value("content").alias("content"))


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml

        load, errors = yaml.safe_load, (yaml.YAMLError, ValueError)
    except ImportError:  # JSON is the subset of YAML that needs no extra package
        load, errors = json.loads, (ValueError,)

    def convert(raw: bytes) -> tuple[str | None, str | None]:
        try:
            value = load(bytes(raw).decode("utf-8"))
        except errors as error:
            return None, f"invalid YAML: {type(error).__name__}"
        if not isinstance(value, dict):
            return None, "manifest must contain a mapping"
        return json.dumps(value, ensure_ascii=False, default=str), None

    for batch in batches:
        converted = [convert(raw) for raw in batch["content"]]
        yield pd.DataFrame({"dir": batch["dir"], "raw": [c[0] for c in converted], "problem": [c[1] for c in converted]})


def load_manifests(manifests: DataFrame) -> DataFrame:
    """Typed manifest rows with their JSON text, or why a manifest cannot be read."""
    converted = spread(manifests.select("dir", F.col("content").cast("binary").alias("content"))).mapInPandas(
        _yaml_to_json, "dir string, raw string, problem string"
    )
    return converted.withColumn("task", F.from_json("raw", TASK)).select("dir", "task.*", "raw", "problem")


def with_defaults(tasks: DataFrame) -> DataFrame:
    """Manifest rows with the documented defaults filled in."""
    def check(c: Column) -> Column:
        defaults = {
            "weight": F.lit(1.0), "check_timeout_s": F.lit(60), "allow": F.lit(0), "threshold": F.lit(10),
            "strict": F.lit(False),
            **{name: F.array().cast("array<string>") for name in ("args", "inject", "names", "forbid_in_globs", "forbid_changes")},
        }
        fields = TASK["checks"].dataType.elementType
        return F.struct(*[F.coalesce(c[f.name], defaults.get(f.name, F.lit(None).cast(f.dataType))).alias(f.name) for f in fields])

    limit_defaults = {"cpu_s": 300, "mem_mb": 2048, "nproc": 256, "fsize_mb": 256}
    return tasks.withColumns(
        {
            "timeout_s": F.coalesce("timeout_s", F.lit(300)),
            "editable_files": F.coalesce("editable_files", F.array().cast("array<string>")),
            "limits": F.struct(*[F.coalesce(F.col(f"limits.{n}"), F.lit(v)).alias(n) for n, v in limit_defaults.items()]),
            "checks": F.transform("checks", check),
        }
    )


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["task_id", "path", "is_dir", "mode", "size", "content"]
    for batch in batches:
        for task_id, raw in zip(batch["task_id"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as archive:
                entries = archive.infolist()
                for start in range(0, len(entries), 256):
                    rows = [
                        (task_id, e.filename, e.is_dir(), e.external_attr >> 16, e.file_size,
                         None if e.is_dir() else archive.read(e))
                        for e in entries[start : start + 256]
                    ]
                    yield pd.DataFrame(rows, columns=columns)


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per member of each archive (``task_id, content`` in, bytes read as a stream)."""
    key = archives.schema["task_id"].dataType.simpleString()
    return archives.select("task_id", "content").mapInPandas(
        _members, f"task_id {key}, path string, is_dir boolean, mode int, size bigint, content binary"
    )


def junit_reports(spark: SparkSession, path: str) -> DataFrame:
    """XML reports below a folder as (path, xml) text rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return found.select("path", F.decode("content", "UTF-8").alias("xml"))
