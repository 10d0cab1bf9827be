"""Facts about source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import source_code
from assayer.plans import workspaces
from assayer.plans.registry import query

_PARTS = "(SELECT p_partkey AS k FROM part)"
_SIGNATURE = "CASE WHEN k % 8 = 0 THEN '(value, *rest, key = 1, **kw) -> int' ELSE '(value: int, *rest, key = 1, **kw) -> int' END"
_AREA = "'(self, w: int, h: int = 2, deep = None) -> int'"

SYMBOLS_SQL = f"""
SELECT k AS tree_id, 'app.py' AS path, ord, kind, name, CASE name WHEN 'area' THEN {_AREA} WHEN 'solve' THEN {_SIGNATURE} END AS signature
FROM {_PARTS}, (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['class', 'method', 'function', 'function']) AS kind, unnest(['Box', 'area', 'solve', 'area']) AS name)
WHERE k % 19 <> 0
UNION ALL SELECT k, 'lib/extra.py', 0, 'function', 'solve', '(x)' FROM {_PARTS} WHERE k % 6 = 0
UNION ALL SELECT k, 'tests/test_a.py', 0, 'function', 'test_one', '()' FROM {_PARTS} WHERE k % 29 <> 0
UNION ALL SELECT k, 'tests/test_a.py', 1, 'function', 'test_two', '()' FROM {_PARTS} WHERE k % 29 <> 0 AND k % 4 <> 0"""

IMPORTS_SQL = f"""
SELECT k AS tree_id, 'app.py' AS path, ord, module, name FROM {_PARTS},
  (SELECT unnest([0, 1, 2]) AS ord, unnest(['json', 'collections', 'collections']) AS module, unnest([NULL, 'deque', 'OrderedDict']) AS name) WHERE k % 19 <> 0
UNION ALL SELECT k, 'app.py', 3, CASE k % 3 WHEN 0 THEN 'os' ELSE 'os.path' END, CASE k % 3 WHEN 0 THEN 'path' WHEN 2 THEN 'join' END FROM {_PARTS} WHERE k % 19 <> 0"""

METRICS_SQL = f"""
SELECT k AS tree_id, 'tests/test_a.py' AS path, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS test_functions,
       CASE WHEN k % 4 = 0 THEN 1 ELSE 3 END AS asserts FROM {_PARTS} WHERE k % 29 <> 0"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.parsed(workspaces.files(spark, sf_dir, workspaces.CURRENT))


@query("U01_symbols", SYMBOLS_SQL)
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.symbols(_facts(spark, sf_dir))


@query("U02_imports", IMPORTS_SQL)
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.imports(_facts(spark, sf_dir))


@query(
    "U03_file_metrics",
    f"""SELECT k AS tree_id, path, CASE path WHEN 'app.py' THEN k % 19 <> 0 ELSE true END AS parsed,
        CASE WHEN path = 'tests/test_a.py' THEN CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END ELSE 0 END AS test_functions,
        CASE WHEN path = 'tests/test_a.py' THEN CASE WHEN k % 4 = 0 THEN 1 ELSE 3 END ELSE 0 END AS asserts
        FROM {_PARTS}, (SELECT unnest(['app.py', 'lib/extra.py', 'tests/test_a.py']) AS path)
        WHERE path <> 'tests/test_a.py' OR k % 29 <> 0""",
)
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("tree_id", "path", "parsed", "test_functions", "asserts")


@query("A11_test_metrics", METRICS_SQL)
def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_code.test_metrics(_facts(spark, sf_dir))
