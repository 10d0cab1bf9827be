"""From judged workspaces to runs, and from runs to a published report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.paths import is_core_dump
from assayer.functions.text import first_line_or_unknown, scrub, utf8_tail
from assayer.functions.usage import non_negative
from assayer.operators import latest, scoring, scrubbing, usage
from assayer.plans import checks, workspaces
from assayer.plans.registry import derive, query
from assayer.session import by_shuffle, cut_lineage, shared_dir
from assayer.sources import reports


def judge_runs(results: DataFrame, sessions: DataFrame, files: DataFrame, secrets: DataFrame | scrubbing.Registry | None = None) -> DataFrame:
    """Run rows of workspaces: scored checks, the agent's result with usage and scrubbed tails, and the final status.

    ``results`` come from ``rules.run_checks``, ``sessions(tree_id, task_id,
    agent, adapter, version_output, repeat, exit_code, timed_out, duration_s,
    stdout, stderr, crash_detail)`` from the captured agent sessions,
    ``files(tree_id, path)`` from the final trees, ``secrets(position, value,
    name)`` from the environment. A run that crashed has a placeholder for the
    agent's result.
    """
    registry = scrubbing.index_registry(secrets) if isinstance(secrets, DataFrame) else secrets
    spoken = ("stdout", "stderr", "crash_detail")
    clean = sessions
    for column in spoken:
        clean = clean.withColumn(column, scrub(F.col(column))) if registry is None else scrubbing.scrub_with_registry(clean, column, registry)
    used = usage.session_usage(sessions, ["tree_id"]).withColumn("__usage", non_negative(usage.as_struct())).select("tree_id", "__usage")
    scored = scoring.score_runs(results, ["tree_id"])
    dumps = files.filter(is_core_dump(F.col("path"))).groupBy("tree_id").agg(F.count(F.lit(1)).alias("core_files"))
    joined = clean.join(by_shuffle(used), "tree_id").join(by_shuffle(scored), "tree_id", "left").join(by_shuffle(dumps), "tree_id", "left")
    kind = scoring.agent_error_kind(F.col("timed_out"))
    status = scoring.run_status(F.col("passed"), kind, F.coalesce("core_files", F.lit(0)), F.col("crash_detail"))
    said = scoring.agent_error_detail(F.col("exit_code"))
    crashed = F.col("crash_detail").isNotNull()
    result = F.struct(
        "agent", first_line_or_unknown(F.col("version_output")).alias("agent_version"), F.col("exit_code").cast("int").alias("exit_code"), "timed_out",
        F.col("duration_s").cast("double").alias("duration_s"), "__usage.cost_usd", "__usage.tokens_in", "__usage.tokens_out",
        utf8_tail(F.col("stdout")).alias("stdout_tail"), utf8_tail(F.col("stderr")).alias("stderr_tail"), kind.alias("error_kind"), said.alias("error_detail"),
    )
    judged = joined.withColumns({"__status": status, "agent_result": F.when(crashed, scoring.crashed_agent_result(F.col("agent"), F.col("crash_detail"))).otherwise(result)})
    return judged.select(
        "tree_id", "task_id", "agent", "repeat", F.col("duration_s").cast("double").alias("duration_s"),
        F.col("__status.passed").alias("passed"),
        F.when(crashed, 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.col("__status.error_kind").alias("error_kind"), F.coalesce("crash_detail", said).alias("error_detail"),
        "agent_result", "agent_result.cost_usd", "agent_result.tokens_in", "agent_result.tokens_out", "agent_result.stdout_tail",
    )


def publish(runs: DataFrame, folder: str) -> DataFrame:
    """Writes the newest runs and their aggregates as Parquet and CSV; returns the aggregates.

    ``runs`` carry ``run_key`` and ``created_at``; replayed cells replace older ones.
    """
    current = cut_lineage(latest.latest_cell(runs))
    aggregates = scoring.aggregate_runs(current)
    reports.replace_aggregates(aggregates, f"{folder}/aggregates")
    stored = runs.sparkSession.read.parquet(f"{folder}/aggregates")
    reports.write_csv(reports.runs_csv(current), f"{folder}/report.csv")
    reports.write_csv(reports.aggregates_csv(stored), f"{folder}/aggregates.csv")
    return stored


_SESSIONS = """
SELECT p_partkey AS tree_id, 't' || CAST(p_size % 3 AS STRING) AS task_id, 'a' || CAST(p_partkey % 4 AS STRING) AS agent, 'codex' AS adapter,
       CAST(floor(p_partkey / 4) AS INT) AS repeat, CAST(p_partkey % 2 AS INT) AS exit_code, p_partkey % 43 = 0 AS timed_out, p_size * 1.5 AS duration_s,
       '{{"cost":' || CAST(p_partkey % 9 AS STRING) || ',"input_tokens":' || CAST(p_size AS STRING) || '}}' AS stdout,
       'used ' || p_brand || '/' || CAST(p_partkey AS STRING) || '; and ' || p_brand AS stderr, 'codex ' || CAST(p_size AS STRING) || chr(10) || 'built' AS version_output,
       CASE WHEN p_partkey % 47 = 0 THEN 'boom ' || p_brand || '/' || CAST(p_partkey AS STRING) || '; token=abcdefghijklmnop' END AS crash_detail
FROM {part}"""
_SECRETS = """
SELECT p_partkey AS position, p_brand || '/' || CAST(p_partkey AS STRING) || ';' AS value, 'K' || CAST(p_size AS STRING) AS name FROM {part} WHERE p_partkey % 2 = 1"""
_FINAL = """
SELECT p_partkey AS tree_id, 'app.py' AS path FROM {part}
UNION ALL SELECT p_partkey, 'sub/core.123' FROM {part} WHERE p_partkey % 53 = 0"""
_SCORES = f"""(SELECT tree_id AS k, coalesce(bool_and(passed) FILTER (WHERE required), true) AS ok, sum(weight * score) / sum(weight) AS s
              FROM ({checks.ALL_SQL}) GROUP BY tree_id)"""
_KIND = """CASE WHEN k % 47 = 0 THEN 'harness_crash' WHEN k % 53 = 0 THEN 'sandbox_error' WHEN k % 43 = 0 THEN 'timeout' ELSE 'none' END"""
_JUDGED_SQL = f"""
SELECT k AS tree_id, 't' || (p_size % 3) AS task_id, 'a' || (k % 4) AS agent, k // 4 AS repeat, ok AND {_KIND} = 'none' AS passed,
       CASE WHEN k % 47 = 0 THEN 0.0 ELSE s END AS score, {_KIND} AS error_kind,
       CASE WHEN k % 47 = 0 THEN 'boom ' || CASE WHEN k % 2 = 1 THEN '<K' || p_size || '>' ELSE p_brand || '/' || k || ';' END || ' <REDACTED>' WHEN k % 2 = 1 THEN 'agent exited with code 1' END AS error_detail,
       CASE WHEN k % 47 <> 0 THEN k % 9 END AS cost_usd, CASE WHEN k % 47 <> 0 THEN p_size END AS tokens_in, p_size * 1.5 AS duration_s,
       CASE WHEN k % 47 <> 0 THEN 'codex ' || p_size END AS agent_version, CASE WHEN k % 47 <> 0 THEN k % 2 END AS exit_code,
       CASE WHEN k % 47 = 0 THEN '' ELSE 'used ' || CASE WHEN k % 2 = 1 THEN '<K' || p_size || '>' ELSE p_brand || '/' || k || ';' END || ' and ' || p_brand END AS stderr_tail,
       CASE WHEN k % 47 = 0 THEN 'harness_crash' WHEN k % 43 = 0 THEN 'timeout' ELSE 'none' END AS agent_error_kind
FROM part JOIN {_SCORES} ON p_partkey = k"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = checks.all_results(spark, sf_dir)
    return judge_runs(results, derive(spark, sf_dir, _SESSIONS), derive(spark, sf_dir, _FINAL), derive(spark, sf_dir, _SECRETS))


@query(
    "E01_judge_runs",
    f"""SELECT tree_id, task_id, agent, repeat, passed, round(score, 10) AS score, error_kind, error_detail, cost_usd, tokens_in,
        agent_version, exit_code, stderr_tail, agent_error_kind FROM ({_JUDGED_SQL})""",
)
def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(
        "tree_id", "task_id", "agent", "repeat", "passed", F.round("score", 10).alias("score"), "error_kind", "error_detail",
        "cost_usd", "tokens_in", "agent_result.agent_version", "agent_result.exit_code", "agent_result.stderr_tail",
        F.col("agent_result.error_kind").alias("agent_error_kind"),
    )


@query(
    "A02_publish_judged_runs",
    f"""SELECT task_id, agent, count(*) AS repeats, count(*) FILTER (WHERE passed) AS successes, round(avg(score), 8) AS mean_score,
        round(avg(cost_usd), 8) AS mean_cost_usd, round(avg(duration_s), 8) AS mean_duration_s FROM ({_JUDGED_SQL}) GROUP BY task_id, agent""",
)
def publish_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _judged(spark, sf_dir).withColumns(
        {
            "run_id": F.lit("r"), "run_key": F.sha2(F.col("tree_id").cast("string"), 256), "created_at": F.lit("2024-01-01T00:00:00Z"),
        }
    )
    table = publish(runs, shared_dir(spark, "published"))
    means = [F.round(c, 8).alias(c) for c in ("mean_score", "mean_cost_usd", "mean_duration_s")]
    return table.select("task_id", "agent", "repeats", "successes", *means)
