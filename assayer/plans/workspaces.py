"""Small derived workspaces, one per part, that the check queries judge."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import rules, snapshots, source_code
from assayer.plans.registry import derive
from assayer.schemas import CHECK_SPEC
from assayer.session import cut_lineage, store_table
from assayer.sources.trees import with_defaults

_NL = " || chr(10) || "

APP = f"""
CASE WHEN k % 19 = 0 THEN 'def broken(:' || chr(10) ELSE
'import json'{_NL}'from collections import deque, OrderedDict as D'{_NL}
CASE k % 3 WHEN 0 THEN 'from os import path' WHEN 1 THEN 'import os.path' ELSE 'from os.path import join' END{_NL}
'class Box:'{_NL}'    limit: int = 3'{_NL}'    def area(self, w: int, /, h: int = 2, *, deep = None) -> int:'{_NL}'        return w * h'{_NL}
CASE WHEN k % 8 = 0 THEN 'def solve(value, *rest, key=1, **kw) -> int:' ELSE 'def solve(value: int, *rest, key=1, **kw) -> int:' END{_NL}
'    return value' || chr(10) END"""
_TESTS = f"""
'def test_one():'{_NL}'    assert True' || chr(10) || CASE WHEN {{weak}} THEN '' ELSE
'async def test_two():'{_NL}'    assert 1'{_NL}'    assert 2' || chr(10) END"""

_PARTS = "(SELECT p_partkey AS k, p_size FROM {part})"
CURRENT = f"""
SELECT k, 'app.py' AS path, 'file' AS kind, {APP} AS text FROM {_PARTS}
UNION ALL SELECT k, 'lib/extra.py', 'file', CASE WHEN k % 6 = 0 THEN 'def solve(x):' || chr(10) || '    return x' || chr(10) ELSE 'X = 1' END FROM {_PARTS}
UNION ALL SELECT k, 'tests/test_a.py', 'file', {_TESTS.format(weak='k % 4 = 0')} FROM {_PARTS} WHERE k % 29 <> 0
UNION ALL SELECT k, 'pytest.ini', CASE WHEN k % 31 = 0 THEN 'symlink' ELSE 'file' END,
  CASE WHEN k % 31 = 0 THEN 'other.ini' WHEN k % 5 = 0 THEN '[pytest]' || chr(10) || 'ADDOPTS = -x' ELSE '[pytest]' END FROM {_PARTS} WHERE k % 2 = 0
UNION ALL SELECT k, 'notes.txt', 'file', CASE WHEN k % 13 = 0 THEN 'broken' WHEN k % 7 = 0 THEN 'secret inside' ELSE 'value = 42' END FROM {_PARTS} WHERE k % 17 <> 0"""
BASE = f"""
SELECT k, 'app.py' AS path, 'file' AS kind, CASE WHEN k % 3 = 0 THEN 'pass' ELSE {APP} END AS text FROM {_PARTS}
UNION ALL SELECT k, 'lib/extra.py', 'file', CASE WHEN k % 6 = 0 THEN 'def solve(x):' || chr(10) || '    return x' || chr(10) ELSE 'X = 1' END FROM {_PARTS}
UNION ALL SELECT k, 'tests/test_a.py', 'file', {_TESTS.format(weak='false')} FROM {_PARTS}
UNION ALL SELECT k, 'pytest.ini', 'file', '[pytest]' FROM {_PARTS} WHERE k % 2 = 0
UNION ALL SELECT k, 'notes.txt', 'file', 'value = 42' FROM {_PARTS}"""

OUTPUTS = """
SELECT p_partkey AS k, 'lint' AS name, CASE WHEN p_partkey % 37 = 0 THEN 'crashed' WHEN p_partkey % 6 = 0 THEN '[]'
       ELSE '[' || repeat('{{"code":"E5"}},', CAST(p_partkey % 6 - 1 AS INT)) || '{{"code":"F1"}}]' END AS stdout,
       CAST(p_partkey % 3 AS INT) AS exit_code, p_partkey % 11 = 0 AS timed_out, p_partkey % 41 = 0 AS check_timed_out, CAST(NULL AS STRING) AS junit FROM {part}
UNION ALL SELECT p_partkey, 'types', 'Found ' || CAST(p_partkey % 6 AS STRING) || ' errors in 1 file', CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END,
       false, false, CAST(NULL AS STRING) FROM {part}
UNION ALL SELECT p_partkey, 'tests', '', CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, false, false,
       '<testsuites><testsuite tests="' || CAST(p_partkey % 5 AS STRING) || '" failures="' || CASE WHEN p_partkey % 4 = 0 THEN '1' ELSE '0' END || '"/></testsuites>' FROM {part}"""

CHECKS = [
    {"name": "defines", "type": "ast_defines", "symbol": "solve", "kind": "function", "in_file": "app.py", "forbid_in_globs": ["lib/*.py"]},
    {"name": "signature", "type": "ast_signature", "symbol": "solve", "kind": "function", "in_file": "app.py",
     "signature": "(value: int, *rest, key = 1, **kw) -> int"},
    {"name": "no_import", "type": "ast_no_import", "module": "os", "names": ["path"]},
    {"name": "present", "type": "content_present", "path": "notes.txt", "pattern": "42"},
    {"name": "absent", "type": "content_absent", "path": "notes.txt", "pattern": "secret", "weight": 3.0},
    {"name": "exists", "type": "file_exists", "path": "tests"},
    {"name": "gone", "type": "file_absent", "path": "notes.txt"},
    {"name": "scope", "type": "diff_scope", "max_files_changed": 1, "forbid_changes": ["tests/*"]},
    {"name": "intact", "type": "integrity", "forbid_changes": ["*.txt", "lib/*"]},
    {"name": "tamper", "type": "no_test_tamper"},
    {"name": "lint", "type": "ruff", "allow": 2, "threshold": 4},
    {"name": "types", "type": "mypy", "threshold": 4},
    {"name": "tests", "type": "pytest", "weight": 2.0},
    {"name": "odd", "type": "custom_thing"},
]
REQUIRED = ["defines", "exists", "types"]


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (workspace, check); workspaces share three tasks."""
    trees = derive(spark, sf_dir, "SELECT p_partkey AS tree_id, 't' || CAST(p_size % 3 AS STRING) AS task_id FROM {part}")
    checks = F.from_json(F.lit(json.dumps(CHECKS)), f"array<{CHECK_SPEC.simpleString()}>")
    # stored, so that the planner knows how few the tasks are beside the trees
    tasks = store_table(trees.select("task_id").distinct(), "tasks").select(
        "task_id", F.array(*[F.lit(n) for n in REQUIRED]).alias("required_checks"), checks.alias("checks"),
        F.lit(60).alias("timeout_s"), F.array().cast("array<string>").alias("editable_files"),
        F.lit(None).cast("struct<cpu_s:int,mem_mb:int,nproc:int,fsize_mb:int>").alias("limits"),
    )
    return rules.expand_specs(with_defaults(tasks), trees)


def files(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Files of all workspaces; one kind of note is not UTF-8."""
    rows = derive(spark, sf_dir, text).withColumnRenamed("k", "tree_id")
    raw = F.encode("text", "UTF-8")
    return rows.withColumn("content", F.when(F.col("text") == "broken", F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw))


def parsed(rows: DataFrame) -> DataFrame:
    """Facts of the Python files among workspace files."""
    return source_code.parse_sources(rows.filter(F.col("path").endswith(".py") & (F.col("kind") == "file")))


def evidence(spark: SparkSession, sf_dir: str, store: bool = False) -> rules.Evidence:
    """All evidence tables; ``store`` writes those that several checks share once."""
    keep = cut_lineage if store else lambda df: df
    base, current = (keep(files(spark, sf_dir, text)) for text in (BASE, CURRENT))

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select("tree_id", "path", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("executable"))

    facts = keep(parsed(current))
    base_metrics = keep(source_code.test_metrics(parsed(base)))
    return rules.Evidence(
        files=current,
        changes=keep(snapshots.snapshot_diff(hashed(base), hashed(current))),
        base_metrics=base_metrics,
        metrics=source_code.test_metrics(facts, base_metrics),
        parsed=facts,
        outputs=derive(spark, sf_dir, OUTPUTS).withColumnRenamed("k", "tree_id"),
    )
