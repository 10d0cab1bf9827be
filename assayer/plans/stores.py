"""Stored runs and reports: scans, sinks, latest-wins tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import latest, planning, saved
from assayer.operators.ordered import running
from assayer.plans import inputs
from assayer.plans.registry import derive, plain, query
from assayer.plans.scoring import AGGREGATES_SQL, aggregates
from assayer.sources import reports
from assayer.session import shared_dir

_RUN_ID = "20240101T000000Z-00000000"
_FULL = f"""
SELECT '1.0.0' AS schema_version, '{_RUN_ID}' AS run_id, task_id, '0.1.0' AS task_version, agent, event_id AS seed,
       passed, CAST(score AS DOUBLE) AS score, error_kind, cost_usd, duration_s, event_id, finished_at
FROM ({inputs.RUNS})"""
_REPEAT = "CAST(row_number() OVER (PARTITION BY task_id, agent ORDER BY event_id) - 1 AS INT)"
_RUNS_SQL = f"(SELECT *, {_REPEAT} AS repeat FROM {plain(_FULL)})"


def full_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived runs in the shape of a stored run, with one check each."""
    rows = running(derive(spark, sf_dir, _FULL), ["task_id", "agent"], ["event_id"], number="repeat")
    null = F.lit(None)
    result = F.struct(
        F.col("agent"), null.cast("string").alias("agent_version"), F.lit(0).alias("exit_code"),
        (F.col("error_kind") == "timeout").alias("timed_out"), F.col("duration_s"), F.col("cost_usd"),
        null.cast("bigint").alias("tokens_in"), null.cast("bigint").alias("tokens_out"),
        F.lit("").alias("stdout_tail"), F.lit("").alias("stderr_tail"), F.col("error_kind"),
        null.cast("string").alias("error_detail"),
    )
    check = F.struct(
        F.lit("pytest_behavior").alias("name"), F.lit("pytest").alias("type"), F.lit(True).alias("required"),
        F.lit(1.0).alias("weight"), F.col("passed"), F.col("score"), F.lit("{}").alias("detail"),
        F.lit(0.5).alias("duration_s"), F.lit("none").alias("error_kind"), null.cast("string").alias("error_detail"),
    )
    stamp = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumns(
        {
            "repeat": (F.col("repeat") - 1).cast("int"), "agent_result": result, "checks": F.array(check),
            "started_at": stamp, "finished_at": stamp, "task_version_hash": F.sha2("task_id", 256),
            "env_manifest_hash": F.lit("env"),
        }
    )


_LIST_COLUMNS = "task_id, agent, repeat, seed, passed, round(score, 10) AS score"


def _brief(rows: DataFrame) -> DataFrame:
    return rows.select("task_id", "agent", "repeat", "seed", "passed", F.round("score", 10).alias("score"))


_DOC_ROWS = 50


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report document per block of 50 events, each a single JSON line."""
    runs = full_runs(spark, sf_dir)
    block = F.floor(F.col("event_id") / _DOC_ROWS)
    record = reports.run_record(runs.columns)
    documents = runs.groupBy(block.alias("block")).agg(F.collect_list(record).alias("runs"))
    suite = F.struct(
        F.lit("derived").alias("name"), F.lit("0.1.0").alias("version"), F.lit("0" * 40).alias("corpus_git_sha"),
        F.lit("git").alias("corpus_ref_kind"), F.lit(False).alias("corpus_dirty"),
        F.lit(None).cast("string").alias("calibration_date"), F.array().cast("array<string>").alias("calibration_agents"),
    )
    document = F.struct(
        F.lit("1.0.0").alias("schema_version"), F.col("block").cast("string").alias("run_id"),
        F.lit("2024-02-01T00:00:00Z").alias("generated_at"), suite.alias("suite"),
        F.create_map(F.lit("block"), F.col("block").cast("string")).alias("metadata"), F.col("runs"),
        F.array().cast("array<string>").alias("aggregates"),
    )
    return documents.select(F.to_json(document, reports.KEEP_NULLS).alias("value"))


@query(
    "S01_load_reports",
    f"SELECT CAST(seed // {_DOC_ROWS} AS VARCHAR) AS report_run_id, {_LIST_COLUMNS}, round(cost_usd, 10) AS cost_usd FROM {_RUNS_SQL}",
)
def load_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "reports")
    _documents(spark, sf_dir).write.text(path)
    loaded = reports.load_reports(spark, path, multi_line=False).withColumnRenamed("run_id", "report_run_id")
    rows = reports.report_runs(loaded, "report_run_id")
    return rows.select(
        "report_run_id", "task_id", "agent", "repeat", "seed", "passed", F.round("score", 10).alias("score"),
        F.round("agent_result.cost_usd", 10).alias("cost_usd"),
    )


@query("S02_list_runs", f"SELECT {_LIST_COLUMNS} FROM {_RUNS_SQL} ORDER BY task_id, agent, repeat")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_runs(_brief(full_runs(spark, sf_dir)))


@query("O03_runs_order", f"SELECT task_id, agent, repeat FROM {_RUNS_SQL} ORDER BY task_id, agent, repeat")
def runs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_runs(full_runs(spark, sf_dir).select("task_id", "agent", "repeat"))


@query("S03_list_aggregates", f"SELECT agent, task_id, repeats, successes, round(pass_at_1, 10) AS pass_at_1 FROM ({AGGREGATES_SQL}) ORDER BY agent, task_id")
def list_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = aggregates(spark, sf_dir).select("agent", "task_id", "repeats", "successes", F.round("pass_at_1", 10).alias("pass_at_1"))
    return reports.list_aggregates(table)


_KV = """
SELECT c_custkey AS suite, 'suite_name' AS key, c_name AS value, c_custkey % 2 AS version FROM {customer}
UNION ALL SELECT c_custkey, 'corpus_ref_kind', CASE WHEN c_nationkey % 2 = 0 THEN 'git' ELSE 'unknown' END, 0 FROM {customer}
UNION ALL SELECT c_custkey, 'skipped_adapters_json', c_mktsegment, 0 FROM {customer} WHERE c_custkey % 3 = 0"""
_KV_NEW = """
SELECT c_custkey AS suite, 'suite_name' AS key, c_name || ' renamed' AS value, 1 + c_custkey % 2 AS version FROM {customer} WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'shutdown_reason', 'budget_exceeded', 1 FROM {customer} WHERE c_custkey % 5 = 0"""


@query("S04_get_metadata", f"SELECT suite, value FROM {plain(_KV)} WHERE key = 'corpus_ref_kind'")
def get_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _KV).filter("key = 'corpus_ref_kind'").select("suite", "value")


_MAP_SQL = "'{' || string_agg('\"' || key || '\":\"' || value || '\"', ',' ORDER BY key) || '}'"


@query("S04_metadata_map", f"SELECT suite, {_MAP_SQL} AS metadata FROM {plain(_KV)} GROUP BY suite")
def metadata_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = latest.metadata_map(derive(spark, sf_dir, _KV), ["suite"])
    return table.select("suite", F.to_json("metadata").alias("metadata"))


@query("P09_public_metadata", f"SELECT suite, {_MAP_SQL} AS metadata FROM {plain(_KV)} WHERE key <> 'skipped_adapters_json' GROUP BY suite")
def public_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = latest.metadata_map(derive(spark, sf_dir, _KV), ["suite"])
    return table.select("suite", F.to_json(reports.public_metadata(F.col("metadata"))).alias("metadata"))


@query(
    "K04_set_metadata",
    f"""SELECT suite, key, arg_max(value, version) AS value FROM (SELECT * FROM {plain(_KV)} UNION ALL SELECT * FROM {plain(_KV_NEW)})
        GROUP BY suite, key""",
)
def set_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = latest.set_metadata(derive(spark, sf_dir, _KV), derive(spark, sf_dir, _KV_NEW), ["suite", "key"])
    return merged.select("suite", "key", "value")


# A customer is a suite run: its orders are the tasks, their priorities the agents.
_SUITE_RUNS = """
SELECT c_custkey AS suite, CASE WHEN c_custkey % 2 = 0 THEN 'isolated' ELSE 'host' END AS agent_env, c_custkey % 3 = 0 AS corpus_dirty, sha1(c_name) AS corpus_git_sha,
       'git' AS corpus_ref_kind, '2024-01-01T00:00:00Z' AS created_at, sha2(c_mktsegment, 256) AS env_manifest_hash, 1 + c_nationkey AS repeats, c_name AS run_id,
       CASE c_custkey % 3 WHEN 0 THEN 'process' WHEN 1 THEN 'bwrap' ELSE 'docker' END AS sandbox, '1.0.0' AS schema_version, c_mktsegment AS suite_name,
       '0.1.' || CAST(c_nationkey AS STRING) AS suite_version FROM {customer}"""
_SUITE_TASKS = """
SELECT o_custkey AS suite, 'o"' || CAST(o_orderkey AS STRING) AS task_id, sha2(CAST(o_orderkey AS STRING), 256) AS task_version_hash, o_orderkey AS position FROM {orders}"""
_SUITE_AGENTS = "SELECT o_custkey AS suite, o_orderpriority AS agent, min(o_orderkey) AS position FROM {orders} GROUP BY o_custkey, o_orderpriority"
_TASK_TEXT = """'"o\\"' || o_orderkey || '"'"""
_SUITE_KEYS_SQL = f"""
WITH t AS (SELECT o_custkey AS suite, '[' || string_agg({_TASK_TEXT}, ', ' ORDER BY o_orderkey) || ']' AS tasks,
                  '{{' || string_agg({_TASK_TEXT} || ': "' || sha256(CAST(o_orderkey AS VARCHAR)) || '"', ', ' ORDER BY 'o"' || o_orderkey) || '}}' AS hashes
           FROM orders GROUP BY o_custkey),
a AS (SELECT suite, '[' || string_agg('"' || agent || '"', ', ' ORDER BY position) || ']' AS agents
      FROM (SELECT o_custkey AS suite, o_orderpriority AS agent, min(o_orderkey) AS position FROM orders GROUP BY ALL) GROUP BY suite),
s AS (SELECT c_custkey AS suite, [coalesce(agents, '[]'), CASE WHEN c_custkey % 2 = 0 THEN 'isolated' ELSE 'host' END, CAST(c_custkey % 3 = 0 AS VARCHAR), sha1(c_name),
        'git', '2024-01-01T00:00:00Z', sha256(c_mktsegment), CAST(1 + c_nationkey AS VARCHAR), c_name,
        CASE c_custkey % 3 WHEN 0 THEN 'process' WHEN 1 THEN 'bwrap' ELSE 'docker' END, '1.0.0', c_mktsegment, '0.1.' || c_nationkey, coalesce(tasks, '[]'),
        coalesce(hashes, '{{}}')] AS texts
      FROM customer LEFT JOIN t ON t.suite = c_custkey LEFT JOIN a ON a.suite = c_custkey)
SELECT suite, unnest([{", ".join(f"'{key}'" for key in planning.SUITE_KEYS)}]) AS key, unnest(texts) AS value FROM s"""


def suite_run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suite, key, value) of all suite runs."""
    suites, tasks, agents = (derive(spark, sf_dir, text) for text in (_SUITE_RUNS, _SUITE_TASKS, _SUITE_AGENTS))
    return planning.build_metadata(suites, tasks, agents, ["suite"])


@query("K04_suite_metadata", _SUITE_KEYS_SQL)
def suite_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite_run_metadata(spark, sf_dir)


@query(
    "J12_resumed_suites",
    f"""SELECT suite, key, value AS stored_value, CASE WHEN key = 'repeats' THEN '3' ELSE 'process' END AS current_value FROM ({_SUITE_KEYS_SQL})
        WHERE (key = 'repeats' AND value <> '3') OR (key = 'sandbox' AND value <> 'process')""",
)
def resumed_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites that cannot be resumed with three repeats in a plain process, and why."""
    stored, other = suite_run_metadata(spark, sf_dir), derive(spark, sf_dir, _SUITE_RUNS).withColumns({"repeats": F.lit(3), "sandbox": F.lit("process"), "run_id": F.lit("new")})
    tasks, agents = derive(spark, sf_dir, _SUITE_TASKS), derive(spark, sf_dir, _SUITE_AGENTS)
    return planning.metadata_mismatch(stored, planning.build_metadata(other, tasks, agents, ["suite"]), ["suite"])


# Saved versions of cells: an order line is a save of its (order, line) cell on its ship date.
_SAVES = """
SELECT 'o' || CAST(l_orderkey AS STRING) AS task_id, 'a' || CAST(l_linenumber AS STRING) AS agent, 0 AS repeat, 7 AS seed, 'v' AS task_version_hash,
       'e' AS env_manifest_hash, l_partkey * 10000000 + l_suppkey * 1000 + l_quantity * 10 + l_tax * 100 AS created_at, l_extendedprice AS score, l_linestatus = 'O' AS passed
FROM {lineitem}"""
_NEWEST = "row_number() OVER (PARTITION BY task_id, agent, repeat ORDER BY created_at DESC, score DESC) = 1"


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.with_run_key(derive(spark, sf_dir, _SAVES))


@query("K01_save_run", f"SELECT task_id, agent, created_at, score FROM {plain(_SAVES)} QUALIFY {_NEWEST}")
def save_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, runs = shared_dir(spark, "saved-runs"), _saves(spark, sf_dir)
    for half in ("created_at % 20 < 10", "created_at % 20 >= 10"):
        saved.save_runs(runs.filter(half), path, ties=["score"])
    return saved.read_runs(spark, path, ties=["score"]).select("task_id", "agent", "created_at", "score")


@query("W01_latest_cell", f"SELECT task_id, agent, repeat, created_at, score FROM {plain(_SAVES)} QUALIFY {_NEWEST}")
def latest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_cell(_saves(spark, sf_dir)).select("task_id", "agent", "repeat", "created_at", "score")


@query(
    "K02_child_checks",
    f"""SELECT task_id, agent, unnest([0, 1]) AS position, unnest(['tests', 'scope']) AS name, unnest([passed, score > 1000]) AS passed
        FROM (SELECT * FROM {plain(_SAVES)} QUALIFY {_NEWEST})""",
)
def child_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.array(
        F.struct(F.lit("tests").alias("name"), F.col("passed").alias("passed")),
        F.struct(F.lit("scope").alias("name"), (F.col("score") > 1000).alias("passed")),
    )
    newest = latest.latest_cell(_saves(spark, sf_dir)).withColumn("checks", checks)
    return latest.child_checks(newest, "task_id", "agent").select("task_id", "agent", "position", "name", "passed")


@query(
    "O04_inspect_cell",
    f"""SELECT task_id, agent, repeat, created_at, score, 'tests' AS check_name, passed AS check_passed
        FROM (SELECT * FROM {plain(_SAVES)} QUALIFY {_NEWEST}) WHERE task_id = 'o7' AND agent IN ('a1', 'a2', 'a3', 'a4')""",
)
def inspect_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.array(F.struct(F.lit("tests").alias("name"), F.col("passed").alias("passed")))
    wanted = _saves(spark, sf_dir).filter((F.col("task_id") == "o7") & F.col("agent").isin("a1", "a2", "a3", "a4"))
    cell = latest.latest_cell(wanted.withColumn("checks", checks))
    return cell.select("task_id", "agent", "repeat", "created_at", "score", F.explode("checks").alias("c")).select(
        "task_id", "agent", "repeat", "created_at", "score", F.col("c.name").alias("check_name"), F.col("c.passed").alias("check_passed")
    )


@query("K03_replace_aggregates", f"SELECT agent, task_id, repeats, successes, round(mean_score, 10) AS mean_score FROM ({AGGREGATES_SQL})")
def replace_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "aggregates")
    table = aggregates(spark, sf_dir)
    reports.replace_aggregates(table.limit(0), path)
    reports.replace_aggregates(table, path)
    stored = spark.read.parquet(path)
    return stored.select("agent", "task_id", "repeats", "successes", F.round("mean_score", 10).alias("mean_score"))


@query(
    "K05_report_document",
    f"""SELECT 'run' AS kind, task_id, agent, CAST(repeat AS BIGINT) AS n, round(score, 10) AS value FROM {_RUNS_SQL}
        UNION ALL SELECT 'aggregate', task_id, agent, repeats, round(pass_at_1, 10) FROM ({AGGREGATES_SQL})""",
)
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = F.struct(
        F.lit("derived").alias("name"), F.lit("0.1.0").alias("version"), F.lit("0" * 40).alias("corpus_git_sha"),
        F.lit("git").alias("corpus_ref_kind"), F.lit(False).alias("corpus_dirty"),
        F.lit(None).cast("string").alias("calibration_date"), F.array(F.lit("oracle")).alias("calibration_agents"),
    )
    metadata = F.create_map(F.lit("repeats"), F.lit("3"), F.lit("skipped_adapters_json"), F.lit("{}"))
    lines = reports.report_document_lines(
        full_runs(spark, sf_dir), aggregates(spark, sf_dir), _RUN_ID, "2024-02-01T00:00:00Z", suite, metadata
    )
    path = shared_dir(spark, "document")
    reports.write_report_document(lines, path)
    loaded = reports.load_report_parts(spark, path)
    runs = loaded.runs.select(F.lit("run").alias("kind"), "task_id", "agent", F.col("repeat").cast("bigint").alias("n"), F.round("score", 10).alias("value"))
    return runs.union(loaded.aggregates.select(F.lit("aggregate").alias("kind"), "task_id", "agent", "repeats", F.round("pass_at_1", 10)))


@query(
    "K06_runs_jsonl",
    f"""SELECT task_id, agent, repeat, seed, error_kind, true AS keeps_null_fields FROM {_RUNS_SQL} ORDER BY task_id, agent, repeat""",
)
def runs_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports.runs_jsonl(full_runs(spark, sf_dir))
    fields = F.from_json("value", "task_id string, agent string, repeat int, seed bigint, error_kind string")
    return lines.select(fields.alias("r"), F.col("value").contains('"artifacts_dir":null').alias("keeps_null_fields")).select(
        "r.*", "keeps_null_fields"
    )


@query("K07_append_jsonl", f"SELECT task_id, agent, repeat, round(cost_usd, 10) AS cost_usd FROM {_RUNS_SQL}")
def append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "runs-jsonl")
    runs = full_runs(spark, sf_dir)
    for part in ("passed", "NOT passed"):
        reports.append_runs_jsonl(runs.filter(part), path)
    stored = spark.read.schema(reports.RUN).json(path)
    return stored.select("task_id", "agent", "repeat", F.round("agent_result.cost_usd", 10).alias("cost_usd"))


@query(
    "K08_runs_csv",
    f"""SELECT run_id, task_id, agent, CAST(repeat AS VARCHAR) AS repeat, CASE WHEN passed THEN 'True' ELSE 'False' END AS passed,
        printf('%.6f', score) AS score, printf('%.6f', duration_s) AS duration_s, CASE WHEN cost_usd IS NOT NULL THEN printf('%.6f', cost_usd) END AS cost_usd,
        error_kind FROM {_RUNS_SQL} ORDER BY task_id, agent, repeat""",
)
def runs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "runs-csv")
    runs = full_runs(spark, sf_dir)
    reports.write_csv(reports.runs_csv(runs), path)
    schema = ", ".join(f"{c} string" for c in reports.RUN_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "K09_aggregates_csv",
    f"""SELECT task_id, agent, CAST(repeats AS VARCHAR) AS repeats, CAST(successes AS VARCHAR) AS successes, printf('%.6f', pass_at_1) AS pass_at_1,
        printf('%.6f', mean_score) AS mean_score, printf('%.6f', mean_duration_s) AS mean_duration_s,
        CASE WHEN mean_cost_usd IS NOT NULL THEN printf('%.6f', mean_cost_usd) END AS mean_cost_usd
        FROM ({AGGREGATES_SQL})""",
)
def aggregates_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "aggregates-csv")
    reports.write_csv(reports.aggregates_csv(aggregates(spark, sf_dir)), path)
    schema = ", ".join(f"{c} string" for c in reports.AGGREGATE_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(path)
