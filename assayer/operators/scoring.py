"""Scores of runs and aggregates over repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.metrics import PUBLISHED_K, clamp01, k_map, pass_all_at_k, pass_at_k, wilson_ci


def score_runs(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass flag and weighted score per run.

    A run passes when every required check does. A weight sum that is not
    positive has no score; the row is kept and flagged.
    """
    weight, passed, required = F.col("weight"), F.col("passed"), F.col("required")
    total = F.sum(weight)
    score = clamp01(F.when(total > 0, F.try_divide(F.sum(weight * F.col("score")), total)))
    return checks.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(required, passed)), F.lit(True)).alias("passed"),
        score.alias("score"),
        (~F.coalesce(total > 0, F.lit(False))).alias("bad_weights"),
        F.count(F.lit(1)).alias("checks"),
    )


def count_runs(runs: DataFrame, keys: Sequence[str] = ("task_id", "agent")) -> DataFrame:
    """Mergeable counts and sums per group; the input of :func:`derive_metrics`."""
    score, cost, duration = F.col("score"), F.col("cost_usd"), F.col("duration_s")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repeats"),
        F.count_if(F.col("passed")).alias("successes"),
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("score_std_dev"),
        F.avg(cost).alias("mean_cost_usd"),
        F.avg(duration).alias("mean_duration_s"),
    )


def derive_metrics(counts: DataFrame, ks: Sequence[int] = PUBLISHED_K) -> DataFrame:
    """Adds pass rates, the Wilson interval and the cost per solved task to counts."""
    n, c = F.col("repeats"), F.col("successes")
    rate = F.try_divide(c.cast("double"), n.cast("double"))
    return counts.withColumns(
        {
            "pass_at_1": rate,
            "pass_at_k": k_map({k: pass_at_k(n, c, k) for k in ks}),
            "pass_all_at_k": k_map({k: pass_all_at_k(n, c, k) for k in ks}),
            "pass_at_1_ci95": wilson_ci(c, n),
            "dollars_per_solve": F.when(c > 0, F.try_divide(F.col("mean_cost_usd"), rate)),
        }
    )


def aggregate_runs(runs: DataFrame, keys: Sequence[str] = ("task_id", "agent")) -> DataFrame:
    """All metrics per (task, agent): one shuffle with map-side partial sums."""
    return derive_metrics(count_runs(runs, keys))


def aggregate_by_agent(aggregates: DataFrame) -> DataFrame:
    """Macro average over tasks; the interval is the mean of the tasks' bounds."""
    return aggregates.groupBy("agent").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg("pass_at_1").alias("pass_at_1"),
        F.avg("pass_at_1_ci95.low").alias("ci_mean_low"),
        F.avg("pass_at_1_ci95.high").alias("ci_mean_high"),
    )


def flaky(aggregates: DataFrame) -> DataFrame:
    """Groups whose repeats neither all passed nor all failed."""
    return aggregates.filter((F.col("successes") > 0) & (F.col("successes") < F.col("repeats")))


def known_spend(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the known costs and how many runs have none."""
    cost = F.col("cost_usd")
    return runs.groupBy(*keys).agg(
        F.coalesce(F.sum(cost), F.lit(0).cast(runs.schema["cost_usd"].dataType)).alias("known_spend_usd"),
        F.count_if(cost.isNull()).alias("unknown_cost_runs"),
    )


def agent_error_kind(timed_out: Column) -> Column:
    """An agent's own error kind; its exit code is never an error."""
    return F.when(timed_out, "timeout").otherwise("none")


def agent_error_detail(exit_code: Column) -> Column:
    """Message for an exit code other than 0."""
    return F.when(exit_code != 0, F.concat(F.lit("agent exited with code "), exit_code.cast("string")))


def run_status(
    scored_passed: Column, agent_kind: Column, core_files: Column, crash_detail: Column | None = None
) -> Column:
    """``struct(passed, error_kind)``: a crash first, then core files, then the agent's kind."""
    crashed = F.lit(False) if crash_detail is None else crash_detail.isNotNull()
    kind = F.coalesce(
        F.when(crashed, "harness_crash"),
        F.when(core_files > 0, "sandbox_error"),
        F.nullif(agent_kind, F.lit("none")),
        F.lit("none"),
    )
    return F.struct((F.coalesce(scored_passed, F.lit(False)) & (kind == "none")).alias("passed"), kind.alias("error_kind"))


def crashed_agent_result(agent: Column, detail: Column) -> Column:
    """Placeholder result of an agent whose run never finished."""
    null = F.lit(None)
    return F.struct(
        agent.alias("agent"), null.cast("string").alias("agent_version"), null.cast("int").alias("exit_code"),
        F.lit(False).alias("timed_out"), F.lit(0.0).alias("duration_s"), null.cast("double").alias("cost_usd"),
        null.cast("bigint").alias("tokens_in"), null.cast("bigint").alias("tokens_out"),
        F.lit("").alias("stdout_tail"), F.lit("").alias("stderr_tail"),
        F.lit("harness_crash").alias("error_kind"), detail.alias("error_detail"),
    )
