"""Rules over the derived workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import rules, scoring
from assayer.plans import workspaces
from assayer.plans.registry import query
from assayer.session import cut_lineage

_PARTS = "(SELECT p_partkey AS k, p_partkey AS tree_id FROM part)"
_APP, _TEST = "k % 3 = 0", "(k % 29 = 0 OR k % 4 = 0)"
_CONFIG, _NOTES = "(k % 2 = 0 AND (k % 5 = 0 OR k % 31 = 0))", "(k % 17 = 0 OR k % 7 = 0 OR k % 13 = 0)"
_CHANGED = " + ".join(f"CAST({c} AS INT)" for c in (_APP, _TEST, _CONFIG, _NOTES))
_WEAK = "CASE WHEN k % 29 = 0 THEN 1 WHEN k % 4 = 0 THEN 2 ELSE 0 END"
_NOTES_ERROR = "CASE WHEN k % 17 = 0 THEN 'check_crash' WHEN k % 13 = 0 THEN 'check_failed' ELSE 'none' END"
_CODE_ERROR = "CASE WHEN k % 19 = 0 THEN 'check_failed' ELSE 'none' END"
_LINT_ERROR = "CASE WHEN k % 41 = 0 THEN 'check_timeout' WHEN k % 37 = 0 THEN 'check_failed' ELSE 'none' END"
_TEST_ERROR = "CASE WHEN k % 5 = 0 THEN 'check_failed' ELSE 'none' END"
_RAN = "(k % 3 < 2 AND k % 11 <> 0)"

# Per check: when it passes, its score, its error kind; an error overrides both.
_EXPECTED: dict[str, tuple[str, str, str]] = {
    "defines": ("k % 6 <> 0", "", _CODE_ERROR),
    "signature": ("k % 8 <> 0", "", _CODE_ERROR),
    "no_import": ("k % 3 = 2", "", _CODE_ERROR),
    "present": ("k % 7 <> 0", "", _NOTES_ERROR),
    "absent": ("k % 7 <> 0", "", _NOTES_ERROR),
    "exists": ("k % 29 <> 0", "", "'none'"),
    "gone": ("k % 17 = 0", "", "'none'"),
    "scope": (f"({_CHANGED}) <= 1 AND NOT {_TEST}", "", "'none'"),
    "intact": (f"NOT {_NOTES}", "", "'none'"),
    "tamper": (f"{_WEAK} = 0 AND NOT {_CONFIG}", "", "'none'"),
    "lint": (f"{_RAN} AND k % 6 <= 2", f"CASE WHEN {_RAN} THEN greatest(0.0, 1 - (k % 6) / 4) ELSE 0.0 END", _LINT_ERROR),
    "types": ("k % 6 = 0", "greatest(0.0, 1 - (k % 6) / 4)", "'none'"),
    "tests": ("k % 4 <> 0", "(k % 5 - CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) / nullif(k % 5, 0)", _TEST_ERROR),
    "odd": ("false", "", "'check_failed'"),
}
_WEIGHTS = {check["name"]: check.get("weight", 1.0) for check in workspaces.CHECKS}


def _expected(name: str) -> str:
    passed, score, error = _EXPECTED[name]
    score = score or f"CASE WHEN {passed} THEN 1.0 ELSE 0.0 END"
    position = list(_EXPECTED).index(name)
    return f"""SELECT tree_id, {position} AS position, '{name}' AS name, {str(name in workspaces.REQUIRED).lower()} AS required,
        {error} = 'none' AND {passed} AS passed, CASE WHEN {error} = 'none' THEN round({score}, 10) ELSE 0.0 END AS score, {error} AS error_kind,
        CAST({_WEIGHTS[name]} AS DOUBLE) AS weight FROM {_PARTS}"""


ALL_SQL = " UNION ALL ".join(_expected(name) for name in _EXPECTED)
_OUT = ("tree_id", "name", "required", "passed", "score", "error_kind")


def _results(spark: SparkSession, sf_dir: str, *names: str, store: bool = False) -> DataFrame:
    """Results of the named checks of every workspace; ``store`` writes the evidence that they share once."""
    types = {check["name"]: check["type"] for check in workspaces.CHECKS}
    chosen = workspaces.specs(spark, sf_dir).filter(F.col("name").isin(*names))
    chosen = cut_lineage(chosen) if store else chosen
    evidence = workspaces.evidence(spark, sf_dir, store=store)
    found = rules.run_checks(chosen, evidence, tuple({types[n] for n in names}))
    return found.withColumn("score", F.round("score", 10))


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every check of every workspace."""
    return _results(spark, sf_dir, *_EXPECTED, store=True)


def _register(query_name: str, *names: str) -> None:
    sql = " UNION ALL ".join(f"SELECT {', '.join(_OUT)} FROM ({_expected(name)})" for name in names)

    @query(query_name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _results(spark, sf_dir, *names).select(*_OUT)


for _name, _checks in {
    "J04_integrity": ("intact",),
    "J05_diff_scope": ("scope",),
    "J06_content": ("present", "absent"),
    "J07_file_existence": ("exists", "gone"),
    "J18_ast_defines": ("defines",),
    "J19_ast_signature": ("signature",),
    "J20_ast_no_import": ("no_import",),
    "U04_tool_checks": ("lint", "types", "tests"),
    "U06_unregistered_check": ("odd",),
    "J14_J15_no_test_tamper": ("tamper",),
}.items():
    _register(_name, *_checks)


_VIOLATIONS = {
    "ast_defines": "SELECT tree_id, 'defines' AS name, 'lib/extra.py' AS violation FROM {p} WHERE k % 6 = 0",
    "ast_no_import": """SELECT tree_id, 'no_import' AS name, CASE k % 3 WHEN 0 THEN 'app.py:os.path' ELSE 'app.py:os.path' END AS violation
                        FROM {p} WHERE k % 3 < 2 AND k % 19 <> 0""",
    "integrity": "SELECT tree_id, 'intact' AS name, 'notes.txt' AS violation FROM {p} WHERE " + _NOTES,
    "diff_scope": f"""SELECT tree_id, 'scope' AS name, 'changed file count ' || n || ' exceeds 1' AS violation FROM (SELECT *, {_CHANGED} AS n FROM {{p}}) WHERE n > 1
                      UNION ALL SELECT tree_id, 'scope', 'forbidden path changed: tests/test_a.py' FROM {{p}} WHERE {_TEST}""",
    "no_test_tamper": """SELECT tree_id, 'tamper' AS name, violation FROM (
        SELECT tree_id, 'visible test removed: tests/test_a.py' AS violation FROM {p} WHERE k % 29 = 0
        UNION ALL SELECT tree_id, unnest(['test function count decreased: tests/test_a.py', 'assert count decreased: tests/test_a.py']) FROM {p} WHERE k % 4 = 0 AND k % 29 <> 0
        UNION ALL SELECT tree_id, 'unsafe test config path: pytest.ini' FROM {p} WHERE k % 2 = 0 AND k % 31 = 0
        UNION ALL SELECT tree_id, 'suspicious test config pattern addopts: pytest.ini' FROM {p} WHERE k % 2 = 0 AND k % 5 = 0 AND k % 31 <> 0)""",
}


@query("U05_check_violations", " UNION ALL ".join(sql.format(p=_PARTS) for sql in _VIOLATIONS.values()))
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = workspaces.evidence(spark, sf_dir, store=True)
    found = rules.check_violations(cut_lineage(workspaces.specs(spark, sf_dir)), evidence)
    return found.select("tree_id", "name", "violation")


@query("J14_weakened_tests", "SELECT tree_id, violation FROM (" + _VIOLATIONS["no_test_tamper"].format(p=_PARTS) + ") WHERE violation NOT LIKE '%pytest.ini'")
def weakened_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = workspaces.evidence(spark, sf_dir)
    return rules.weakened_tests(evidence.base_metrics, evidence.metrics)


@query("J15_suspicious_configs", "SELECT tree_id, violation FROM (" + _VIOLATIONS["no_test_tamper"].format(p=_PARTS) + ") WHERE violation LIKE '%pytest.ini'")
def suspicious_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.suspicious_configs(workspaces.files(spark, sf_dir, workspaces.CURRENT))


@query(
    "J08_required_flag",
    f"SELECT tree_id, position, name, name IN ('defines', 'exists', 'types') AS required FROM ({ALL_SQL})",
)
def required_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.specs(spark, sf_dir).select("tree_id", "position", "name", "required")


@query("U05_run_all_checks", f"SELECT {', '.join(_OUT)}, position FROM ({ALL_SQL})")
def run_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, *_EXPECTED, store=True).select(*_OUT, "position")


@query("E03_check_failures", f"SELECT name, error_kind, count(*) AS checks, max(score) AS best_score FROM ({ALL_SQL}) WHERE error_kind <> 'none' GROUP BY name, error_kind")
def check_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _results(spark, sf_dir, *_EXPECTED, store=True).filter("error_kind <> 'none'")
    return failed.groupBy("name", "error_kind").agg(F.count(F.lit(1)).alias("checks"), F.max("score").alias("best_score"))


@query(
    "A01_score_workspaces",
    f"""SELECT tree_id, coalesce(bool_and(passed) FILTER (WHERE required), true) AS passed,
        round(sum(weight * score) / sum(weight), 10) AS score, count(*) AS checks FROM ({ALL_SQL}) GROUP BY tree_id""",
)
def score_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_runs(_results(spark, sf_dir, *_EXPECTED, store=True), ["tree_id"])
    return scored.select("tree_id", "passed", F.round("score", 10).alias("score"), "checks")
