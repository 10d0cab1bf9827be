"""Manifests, archives and data-quality rules."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import quality, rules, scoring
from assayer.plans import inputs
from assayer.plans.registry import derive, plain, query
from assayer.schemas import TASK
from assayer.sources import trees

PREFIX = "held_out_"

_K = "p_partkey"


def _if(condition: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


# One manifest per part; each defect is set by a remainder of the part key.
_MANIFESTS = f"""
SELECT {_K}, '{{{{"id":"' || {_if(f"{_K} % 37 = 3", "'Bad_Id-'", "'task-'")} || CAST({_K} AS STRING) ||
  '","version":"' || {_if(f"{_K} % 41 = 4", "'1.0'", "'0.1.0'")} || '","tier":' || {_if(f"{_K} % 17 = 0", "'6'", "'3'")} ||
  ',"category":"' || {_if(f"{_K} % 19 = 0", "'misc'", "'backward_compat'")} ||
  '","description":"' || {_if(f"{_K} % 23 = 0", "'short'", "'A description that is long enough.'")} ||
  '","timeout_s":' || {_if(f"{_K} % 13 = 0", "'5'", "'120'")} ||
  ',"editable_files":["app.py","' || {_if(f"{_K} % 27 = 0", "'../x.py'", "'lib/x.py'")} ||
  '"],"limits":{{{{"cpu_s":' || {_if(f"{_K} % 53 = 0", "'4000'", "'60'")} || {_if(f"{_K} % 39 = 0", "',\"disk\":1'", "''")} ||
  '}}}},"required_checks":["c_one"' || {_if(f"{_K} % 7 = 0", "',\"ghost\"'", "''")} ||
  '],"checks":[{{{{"name":"c_one","type":"ast_defines","kind":"function","in_file":"app.py"' ||
  {_if(f"{_K} % 21 = 0", "''", "',\"symbol\":\"solve\"'")} || {_if(f"{_K} % 31 = 2", "',\"odd\":2'", "''")} ||
  '}}}},{{{{"name":"' || {_if(f"{_K} % 11 = 0", "'c_one'", "'c_two'")} || '","type":"diff_scope","weight":' ||
  {_if(f"{_K} % 59 = 0", "'0.0'", "'2.5'")} || ',"max_files_changed":1,"forbid_changes":["tests/*","' ||
  {_if(f"{_K} % 33 = 0", "'/abs'", "'*.md'")} || '"]}}}},{{{{"name":"' || {_if(f"{_K} % 43 = 5", "'X'", "'c_three'")} ||
  '","type":"ast_no_import","module":"' || {_if(f"{_K} % 47 = 6", "'a..b'", "'os.path'")} || '"}}}}]' ||
  {_if(f"{_K} % 29 = 1", "',\"extra\":1'", "''")} || '}}}}' AS raw
FROM {{part}}"""

_DEFECTS = {
    "V01": f"{_K} % 29 = 1 OR {_K} % 31 = 2 OR {_K} % 39 = 0",
    "V02": f"{_K} % 37 = 3 OR {_K} % 41 = 4 OR {_K} % 43 = 5 OR {_K} % 47 = 6",
    "V03": f"{_K} % 17 = 0 OR {_K} % 19 = 0",
    "V04": f"{_K} % 23 = 0",
    "V05": f"{_K} % 13 = 0 OR {_K} % 53 = 0 OR {_K} % 59 = 0",
    "V07": f"{_K} % 11 = 0",
    "V08": f"{_K} % 7 = 0",
    "V09": f"{_K} % 27 = 0",
    "V10": f"{_K} % 33 = 0",
    "V11": f"{_K} % 21 = 0",
}


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed manifests with their JSON text and a task id that is always present."""
    raw = derive(spark, sf_dir, _MANIFESTS)
    return raw.withColumn("task", F.from_json("raw", TASK)).select(_K, "raw", F.col(_K).alias("task_id"), "task.*")


def _register_rule(rule: str, condition: str) -> None:
    names = {
        "V01": "unknown_field", "V02": "name_patterns", "V03": "enumerations", "V04": "description_length",
        "V05": "number_bounds", "V07": "unique_check_names", "V08": "required_names", "V09": "relative_paths",
        "V10": "glob_safety", "V11": "check_arguments",
    }

    @query(f"{rule}_{names[rule]}", f"SELECT {_K}, '{rule}' AS rule_id FROM part WHERE {condition}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = manifests(spark, sf_dir)
        chosen = {rule: quality.manifest_rules(F.col("raw"))[rule]}
        return quality.validate(table, [_K], chosen).select(_K, "rule_id")


for _rule, _condition in _DEFECTS.items():
    _register_rule(_rule, _condition)


@query(
    "V06_check_counts",
    f"SELECT {_K}, 'V06' AS rule_id FROM part WHERE {_K} % 10 IN (0, 1, 2)",
)
def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = manifests(spark, sf_dir)
    few = F.slice("checks", F.lit(1), F.lit(0))
    many = F.flatten(F.array_repeat(F.col("checks"), 8))
    form = F.col(_K) % 10
    table = table.withColumns(
        {
            "checks": F.when(form == 0, few).when(form == 1, many).otherwise(F.col("checks")),
            "required_checks": F.when(form == 2, F.array().cast("array<string>")).otherwise(F.col("required_checks")),
        }
    )
    return quality.validate(table, [_K], {"V06": quality.manifest_rules()["V06"]}).select(_K, "rule_id")


@query(
    "V01_V11_first_error",
    f"SELECT {_K}, min(rule_id) AS rule_id FROM ("
    + " UNION ALL ".join(f"SELECT {_K}, '{rule}' AS rule_id FROM part WHERE {condition}" for rule, condition in _DEFECTS.items())
    + f") GROUP BY {_K}",
)
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.validate(manifests(spark, sf_dir), [_K], quality.manifest_rules(F.col("raw")))
    return quality.first_error(found, [_K]).select(_K, "rule_id")


_HIDDEN = f"""
SELECT p_partkey AS task_id, CASE WHEN p_partkey % 9 = 0 THEN 'sub/test_' ELSE 'sub/{PREFIX}' END || CAST(p_partkey AS STRING) || '.py' AS path
FROM {{part}}"""


@query(
    "V12_hidden_prefix",
    "SELECT p_partkey AS task_id, 'hidden file prefix missing: test_' || p_partkey || '.py' AS message FROM part WHERE p_partkey % 9 = 0",
)
def hidden_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.hidden_name_findings(derive(spark, sf_dir, _HIDDEN), PREFIX).select("task_id", "message")


_PROMPTS = """
SELECT doc_id AS task_id, text || CASE doc_id % 10 WHEN 0 THEN ' see the HIDDEN part' WHEN 1 THEN ' run Case_' || CAST(doc_id AS STRING) || ' first'
       WHEN 2 THEN ' not Held_Out_ either' ELSE '' END AS prompt
FROM {documents}"""
_PROMPT_FILES = """
SELECT doc_id AS task_id, 'case_' || CAST(doc_id AS STRING) || '.py' AS path FROM {documents}
UNION ALL SELECT doc_id AS task_id, 'x/never-there.txt' AS path FROM {documents}"""


@query(
    "V13_leaked_terms",
    """SELECT doc_id AS task_id, 'prompt mentions forbidden term: ' || CASE doc_id % 10 WHEN 0 THEN 'hidden' WHEN 1 THEN 'case_' || doc_id
       ELSE 'held_out_' END AS message FROM documents WHERE doc_id % 10 < 3""",
)
def leaked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.leaked_terms(derive(spark, sf_dir, _PROMPTS), derive(spark, sf_dir, _PROMPT_FILES), PREFIX)
    return found.select("task_id", "message")


_MEMBERS = """
SELECT p_partkey AS task_id, CASE p_partkey % 8 WHEN 0 THEN '/etc/' || p_name WHEN 1 THEN 'a/../' || p_name WHEN 2 THEN 'a' || chr(92) || p_name
       WHEN 3 THEN './' ELSE 'src/' || p_name END AS path,
       CASE p_partkey % 5 WHEN 0 THEN 41471 WHEN 1 THEN 4516 ELSE 33188 END AS mode
FROM {part}"""


@query(
    "V14_archive_members",
    f"""SELECT task_id, 'zip entry ' || CASE task_id % 8 WHEN 0 THEN 'absolute' WHEN 1 THEN 'escapes' WHEN 2 THEN 'backslash'
        ELSE CASE WHEN task_id % 5 < 2 THEN 'link' ELSE 'empty' END END || ': ' || path AS message
        FROM {plain(_MEMBERS)} WHERE task_id % 8 < 4 OR task_id % 5 < 2""",
)
def archive_member_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.member_findings(derive(spark, sf_dir, _MEMBERS)).select("task_id", "message")


_PLAIN_MEMBERS = """
SELECT p_partkey AS task_id, 'app.py' AS path FROM {part}
UNION ALL SELECT p_partkey AS task_id, 'lib/x.py' AS path FROM {part} WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey AS task_id, 'tests/test_a.py' AS path FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey AS task_id, 'tests/data.txt' AS path FROM {part}"""
_OFFERED = f"SELECT p_partkey AS task_id, '{PREFIX}a.py' AS path FROM {{part}} WHERE p_partkey % 6 <> 0"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with sane paths and a test check that injects files."""
    table = manifests(spark, sf_dir).select("task_id", "checks")
    inject = F.array(F.lit(f"{PREFIX}a.py"), F.when(F.col("task_id") % 5 == 0, "plain.py").otherwise(f"{PREFIX}a.py"))
    with_inject = F.transform("checks", lambda c: c.withField("inject", F.when(c["name"] == "c_three", F.array_distinct(inject))))
    return table.withColumns({"checks": with_inject, "editable_files": F.array(F.lit("app.py"), F.lit("lib/x.py"))})


@query(
    "V15_missing_files",
    f"""SELECT p_partkey AS task_id, 'editable file is absent: lib/x.py' AS message FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey, 'inject file is missing: {PREFIX}a.py' FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 43 <> 5
        UNION ALL SELECT p_partkey, 'inject file is missing: plain.py' FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 43 <> 5""",
)
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.missing_file_findings(
        _tasks(spark, sf_dir), derive(spark, sf_dir, _PLAIN_MEMBERS), derive(spark, sf_dir, _OFFERED)
    )
    return found.select("task_id", "message")


@query(
    "J21_injected_files",
    f"""SELECT p_partkey AS task_id, path, CASE WHEN path = 'plain.py' THEN 'hidden file prefix missing'
               WHEN p_partkey % 6 = 0 THEN 'hidden inject file missing' END AS problem
        FROM part, (SELECT unnest(['{PREFIX}a.py', 'plain.py']) AS path)
        WHERE p_partkey % 43 <> 5 AND (path <> 'plain.py' OR p_partkey % 5 = 0)""",
)
def injected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _tasks(spark, sf_dir).select("task_id", F.inline("checks")).filter("inject IS NOT NULL")
    return rules.injected_files(derive(spark, sf_dir, _OFFERED), specs, PREFIX).select("task_id", "path", "problem")


@query(
    "J17_protected_paths",
    """SELECT p_partkey AS task_id, path FROM part, (SELECT unnest(['app.py', 'lib/x.py', 'tests/test_a.py']) AS path)
       WHERE path = 'app.py' OR (path = 'lib/x.py' AND p_partkey % 4 <> 0) OR (path = 'tests/test_a.py' AND p_partkey % 3 = 0)""",
)
def protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.protected_paths(_tasks(spark, sf_dir), derive(spark, sf_dir, _PLAIN_MEMBERS))


_IDS = "SELECT p_partkey, 'task-' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) + p_size % 2 AS STRING) AS id FROM {part}"


@query(
    "V16_duplicate_ids",
    f"SELECT id, 'duplicate id used by ' || count(*) || ' manifests' AS message FROM {plain(_IDS)} GROUP BY id HAVING count(*) > 1",
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_ids(derive(spark, sf_dir, _IDS)).select("id", "message")


@query("A12_duplicates", f"SELECT id, count(*) AS uses FROM {plain(_IDS)} GROUP BY id HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = derive(spark, sf_dir, _IDS).groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    return counted.filter("uses > 1")


@query("O08_missing_required", f"SELECT {_K}, 'ghost' AS missing FROM part WHERE {_K} % 7 = 0")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.array_except("required_checks", F.transform("checks", lambda c: c["name"]))
    table = manifests(spark, sf_dir).select(_K, F.explode(gone).alias("missing"))
    return table


@query(
    "V17_glob_conflicts",
    f"""SELECT p_partkey AS task_id, 'forbidden change conflicts with editable file: ' || path AS message
        FROM part, (SELECT unnest(['docs/readme.md', 'tests/a/b.py', 'app.py']) AS path)
        WHERE (path = 'docs/readme.md' AND p_partkey % 33 <> 0) OR path = 'tests/a/b.py'""",
)
def glob_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = manifests(spark, sf_dir).withColumn(
        "editable_files", F.array(F.lit("docs/readme.md"), F.lit("tests/a/b.py"), F.lit("app.py"))
    )
    return quality.glob_conflicts(tasks).select("task_id", "message")


_PARTS = ("manifest", "prompt", "archive", "solution", "hidden")


@query(
    "V18_missing_parts",
    """SELECT p_partkey AS task_id, 'required part is missing: ' || concat_ws(', ', CASE WHEN p_partkey % 5 = 0 THEN 'prompt' END,
              CASE WHEN p_partkey % 7 = 0 THEN 'archive' END, CASE WHEN p_partkey % 11 = 0 THEN 'hidden' END) AS message
       FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""",
)
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derive(
        spark, sf_dir,
        """SELECT p_partkey AS task_id, true AS manifest, p_partkey % 5 <> 0 AS prompt, CASE WHEN p_partkey % 7 <> 0 THEN true END AS archive,
           true AS solution, p_partkey % 11 <> 0 AS hidden FROM {part}""",
    )
    return quality.missing_parts(parts, _PARTS).select("task_id", "message")


_GATE = """
SELECT l_orderkey AS task_id, CASE l_linenumber % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'oracle' ELSE 'oracle2' END AS variant,
       l_returnflag = 'R' AS required, l_quantity AS weight, l_linestatus = 'O' AS passed, 1 - 10 * l_discount AS score,
       CASE WHEN l_tax > 0.06 THEN 'check_crash' WHEN l_tax > 0.03 THEN 'check_failed' ELSE 'none' END AS error_kind
FROM {lineitem}"""


def _variant(name: str, column: str) -> str:
    return f"max(CASE WHEN variant = '{name}' THEN {column} END)"


@query(
    "V19_gate_verdicts",
    f"""WITH s AS (SELECT task_id, variant, coalesce(bool_and(passed) FILTER (WHERE required), true) AS passed,
                    round(least(1, greatest(0, sum(weight * score) / sum(weight))), 10) AS score FROM {plain(_GATE)} GROUP BY 1, 2),
             w AS (SELECT task_id, {_variant('base', 'passed')} AS bp, {_variant('oracle', 'passed')} AS op, {_variant('oracle', 'score')} AS os,
                    {_variant('oracle2', 'passed')} AS ap, {_variant('oracle2', 'score')} AS asc2 FROM s GROUP BY 1),
             u AS (SELECT task_id, count(*) AS n FROM {plain(_GATE)} WHERE variant = 'oracle' AND error_kind = 'check_crash' GROUP BY 1),
             e AS (SELECT w.task_id, bp, op, os, coalesce(n, 0) AS n, coalesce(bp, false) AS e1, coalesce(NOT op OR os < 0.99, false) AS e2,
                    op IS DISTINCT FROM ap OR os IS DISTINCT FROM asc2 AS e3 FROM w LEFT JOIN u ON w.task_id = u.task_id)
        SELECT task_id, NOT (e1 OR e2 OR e3 OR n > 0) AS valid, bp AS base_passed, op AS oracle_passed, os AS oracle_score,
               n AS unexpected_checks, CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT) + CAST(n > 0 AS INT) AS errors FROM e""",
)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = derive(spark, sf_dir, _GATE)
    scores = scoring.score_runs(checks, ["task_id", "variant"]).withColumn("score", F.round("score", 10))
    verdicts = quality.gate_verdicts(scores, checks.withColumn("name", F.lit("c")))
    return verdicts.withColumn("errors", F.size("errors"))


_BOUNDS = """
SELECT event_id, value / 400 AS score, 0 AS repeat, event_id AS seed, CASE WHEN user_id % 9 = 0 THEN -1.0 ELSE value END AS cost_usd,
       value AS duration_s, 1 AS tokens_in, CASE WHEN user_id % 8 = 0 THEN NULL ELSE 2 END AS tokens_out,
       CASE WHEN event_type = 'error' THEN 'weird' ELSE 'none' END AS error_kind
FROM {events}"""


@query(
    "V20_run_bounds",
    """SELECT event_id, CASE WHEN value / 400 > 1 THEN 'score out of range' WHEN user_id % 9 = 0 THEN 'cost_usd is negative'
       ELSE 'unknown error kind' END AS message FROM events WHERE value / 400 > 1 OR user_id % 9 = 0 OR event_type = 'error'""",
)
def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(derive(spark, sf_dir, _BOUNDS), ["event_id"], quality.run_rules()).select("event_id", "message")


_SUITES = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '1.0' ELSE '1.0.' || CAST(c_nationkey AS STRING) END AS version,
       CASE WHEN c_custkey % 7 = 0 THEN 'ABC' ELSE repeat('0a', 20) END AS corpus_git_sha,
       CASE WHEN c_custkey % 11 = 0 THEN 'svn' ELSE 'git' END AS corpus_ref_kind FROM {customer}"""


@query(
    "V20_suite_identity",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'invalid version: 1.0' WHEN c_custkey % 7 = 0 THEN 'invalid corpus sha: ABC'
       ELSE 'unknown corpus ref kind' END AS message FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
)
def suite_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(derive(spark, sf_dir, _SUITES), ["c_custkey"], quality.suite_rules()).select("c_custkey", "message")


_SETTINGS = """
SELECT c_custkey, c_custkey % 13 - 1 AS base_seed, c_custkey % 131 AS parallel, 1 + c_nationkey * 5 AS default_repeats, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey * 5000 END AS inline_diff_max_bytes,
       CASE WHEN c_custkey % 19 = 0 THEN 'vm' ELSE 'docker' END AS sandbox, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'host' END AS agent_env,
       array(named_struct('name', c_mktsegment, 'max_parallel', c_nationkey), named_struct('name', 'second', 'max_parallel', CAST(NULL AS INT)),
             named_struct('name', 'third', 'max_parallel', c_custkey % 113)) AS providers
FROM {customer}"""


@query(
    "V21_settings_bounds",
    """SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 - 1 < 0 THEN 'base_seed out of range' WHEN c_custkey % 131 NOT BETWEEN 1 AND 128 THEN 'parallel out of range'
       WHEN 1 + c_nationkey * 5 > 100 THEN 'default_repeats out of range' WHEN c_custkey % 17 = 0 OR c_custkey * 5000 > 1048576 THEN 'inline_diff_max_bytes out of range'
       WHEN c_custkey % 19 = 0 THEN 'unknown sandbox' WHEN c_custkey % 23 = 0 THEN 'unknown agent_env'
       WHEN c_nationkey < 1 THEN 'max_parallel out of range: ' || c_mktsegment WHEN c_custkey % 113 NOT BETWEEN 1 AND 100 THEN 'max_parallel out of range: third' END AS message
       FROM customer) WHERE message IS NOT NULL""",
)
def settings_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(derive(spark, sf_dir, _SETTINGS), ["c_custkey"], quality.settings_rules()).select("c_custkey", "message")


_TASK_FILES = """
SELECT 'tasks/t' || CAST(p_partkey AS STRING) || '/task.yaml' AS path, p_partkey,
       CASE p_partkey % 50 WHEN 0 THEN 'id: [unclosed' WHEN 1 THEN '- a' || chr(10) || '- b' ELSE
       'id: t-' || CAST(p_partkey AS STRING) || chr(10) || 'version: "0.1.0"' || chr(10) || 'tier: ' || CAST(1 + p_size % 5 AS STRING) || chr(10) ||
       'description: >-' || chr(10) || '  ' || p_name || chr(10) || '  and more' || chr(10) || 'editable_files:' || chr(10) || '  - app.py' || chr(10) ||
       'required_checks: [scope]' || chr(10) || 'checks:' || chr(10) || '  - name: scope' || chr(10) || '    type: diff_scope' || chr(10) ||
       '    max_files_changed: ' || CAST(p_size AS STRING) || chr(10) END AS text
FROM {part}
UNION ALL SELECT 'tasks/t' || CAST(p_partkey AS STRING) || '/prompt.md' AS path, p_partkey, p_name AS text FROM {part}
UNION ALL SELECT 'tasks/t' || CAST(p_partkey AS STRING) || '/task.yaml' AS path, p_partkey, 'id: [unclosed' AS text FROM {part} WHERE p_partkey % 50 = 0"""


def _task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _TASK_FILES).select("path", F.encode("text", "UTF-8").alias("content"))


@query("S05_discover_tasks", "SELECT 'tasks/t' || p_partkey AS dir FROM part ORDER BY dir")
def discover_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.discover(_task_files(spark, sf_dir)).select("dir").orderBy("dir")


@query(
    "S06_load_manifests",
    """SELECT 'tasks/t' || p_partkey AS dir, CASE WHEN p_partkey % 50 > 1 THEN 't-' || p_partkey END AS id,
       CASE WHEN p_partkey % 50 > 1 THEN 1 + p_size % 5 END AS tier, CASE WHEN p_partkey % 50 > 1 THEN p_name || ' and more' END AS description,
       CASE WHEN p_partkey % 50 > 1 THEN p_size END AS max_files_changed, p_partkey % 50 <= 1 AS unusable FROM part""",
)
def load_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = trees.with_defaults(trees.load_manifests(trees.discover(_task_files(spark, sf_dir))))
    return loaded.select(
        "dir", "id", "tier", "description", F.col("checks")[0]["max_files_changed"].alias("max_files_changed"),
        F.col("problem").isNotNull().alias("unusable"),
    )


def _zip_group(rows: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text, kind in sorted(zip(rows["path"], rows["text"], rows["kind"])):
            info = zipfile.ZipInfo(path)
            info.external_attr = (0o120777 if kind == "symlink" else 0o100644) << 16
            archive.writestr(info, text)
    return pd.DataFrame({"task_id": [rows["task_id"].iloc[0]], "content": [buffer.getvalue()]})


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of eight consecutive documents each."""
    members = derive(spark, sf_dir, inputs.FILES).withColumn("task_id", F.floor(F.col("doc_id") / 8))
    return members.select("task_id", "path", "text", "kind").groupBy("task_id").applyInPandas(
        _zip_group, "task_id bigint, content binary"
    )


@query(
    "S09_archive_members",
    f"""SELECT doc_id // 8 AS task_id, path, strlen(text) AS size, sha256(text) AS sha256,
        CASE WHEN kind = 'symlink' THEN 'link' END AS problem FROM {plain(inputs.FILES)}""",
)
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = trees.archive_members(_archives(spark, sf_dir))
    return members.select(
        "task_id", "path", "size", F.sha2("content", 256).alias("sha256"),
        quality.member_problem(F.col("path"), F.col("mode")).alias("problem"),
    )
