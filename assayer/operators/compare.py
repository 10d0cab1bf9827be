"""Leaderboards, heatmaps and the comparison of two result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import fixed
from assayer.operators.scoring import aggregate_by_agent


def leaderboard(aggregates: DataFrame) -> DataFrame:
    """Best pass rate first, then agent and task."""
    return aggregates.orderBy(F.desc("pass_at_1"), "agent", "task_id")


def leaderboard_lines(aggregates: DataFrame) -> DataFrame:
    """The leaderboard as tab-separated text lines, in order."""
    line = F.concat_ws(
        "\t", F.col("agent"), F.col("task_id"),
        F.concat(F.lit("pass@1="), fixed(F.col("pass_at_1"), 3)),
        F.concat(F.lit("ci95="), _interval(F.col("pass_at_1_ci95.low"), F.col("pass_at_1_ci95.high"))),
        F.concat(F.lit("score="), fixed(F.col("mean_score"), 3)),
    )
    return leaderboard(aggregates).select(line.alias("line"))


def _interval(low: Column, high: Column) -> Column:
    return F.concat(fixed(low, 3), F.lit(".."), fixed(high, 3))


def heatmap(aggregates: DataFrame, rows: str, columns: str) -> DataFrame:
    """The pass rate of every pair of a ``rows`` and a ``columns`` value in the data, a row each."""
    return aggregates.groupBy(rows, columns).agg(F.max("pass_at_1").alias("pass_at_1"))


def compare_agents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Agents of both sides with their macro pass rates, intervals and the difference."""
    def side(aggregates: DataFrame, name: str) -> DataFrame:
        table = aggregate_by_agent(aggregates)
        return table.select("agent", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "agent"])

    both = side(left, "left").join(side(right, "right"), "agent", "full_outer")
    delta = F.col("right_pass_at_1") - F.col("left_pass_at_1")
    return both.withColumns({"delta": delta, "missing_on_one_side": delta.isNull()})


def compare_tasks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(task, agent) pairs of both sides as missing, improved, regressed or unchanged."""
    def side(aggregates: DataFrame, name: str) -> DataFrame:
        return aggregates.select(
            "task_id", "agent",
            F.col("pass_at_1").alias(f"{name}_pass_at_1"),
            F.col("pass_at_1_ci95.low").alias(f"{name}_ci_low"),
            F.col("pass_at_1_ci95.high").alias(f"{name}_ci_high"),
        )

    both = side(left, "left").join(side(right, "right"), ["task_id", "agent"], "full_outer")
    before, after = F.col("left_pass_at_1"), F.col("right_pass_at_1")
    status = (
        F.when(before.isNull() | after.isNull(), "missing")
        .when(after > before, "improved")
        .when(after < before, "regressed")
        .otherwise("unchanged")
    )
    return both.withColumn("status", status)


def compare_agent_lines(compared: DataFrame) -> DataFrame:
    """Text form of :func:`compare_agents`, ordered by agent.

    The last bits of a mean depend on the order of its sum, so a difference below 1e-10 has no sign.
    """
    detail = F.concat(
        F.lit("pass_at_1 "), fixed(F.col("left_pass_at_1"), 3), F.lit(" ci95="),
        _interval(F.col("left_ci_mean_low"), F.col("left_ci_mean_high")), F.lit(" -> "),
        fixed(F.col("right_pass_at_1"), 3), F.lit(" ci95="),
        _interval(F.col("right_ci_mean_low"), F.col("right_ci_mean_high")),
        F.lit(" (delta "), fixed(F.round("delta", 10) + 0.0, 3, signed=True), F.lit(")"),
    )
    text = F.when(F.col("missing_on_one_side"), "missing on one side").otherwise(detail)
    return compared.orderBy("agent").select(F.concat_ws(": ", F.col("agent"), text).alias("line"))


def compare_task_lines(compared: DataFrame) -> DataFrame:
    """Text form of :func:`compare_tasks`, ordered by task and agent."""
    detail = F.concat(
        F.lit(" pass_at_1 "), fixed(F.col("left_pass_at_1"), 3), F.lit(" ci95="),
        _interval(F.col("left_ci_low"), F.col("left_ci_high")), F.lit(" -> "),
        fixed(F.col("right_pass_at_1"), 3), F.lit(" ci95="),
        _interval(F.col("right_ci_low"), F.col("right_ci_high")),
    )
    head = F.concat(F.col("task_id"), F.lit(" "), F.col("agent"), F.lit(": "), F.col("status"))
    line = F.concat(head, F.when(F.col("status") == "missing", "").otherwise(detail))
    return compared.orderBy("task_id", "agent").select(line.alias("line"))


def comparability_warnings(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Why two reports may not be comparable: one row per warning.

    ``pairs`` holds one row per pair of reports with a struct per side of
    ``schema_version`` and the suite's identity, plus any key columns.
    """
    def field(name: str) -> tuple[Column, Column]:
        return F.col(f"{left}.{name}"), F.col(f"{right}.{name}")

    def differs(name: str) -> Column:
        a, b = field(name)
        return ~a.eqNullSafe(b)

    def text(label: str, name: str) -> Column:
        a, b = field(name)
        return F.concat(F.lit(f"{label} differs: "), F.coalesce(a, F.lit("")), F.lit(" != "), F.coalesce(b, F.lit("")))

    kinds, dirty = field("corpus_ref_kind"), field("corpus_dirty")
    messages = F.array(
        F.when(differs("schema_version"), text("schema_version", "schema_version")),
        F.when(differs("version"), text("suite.version", "version")),
        F.when(differs("corpus_git_sha"), "corpus_git_sha differs"),
        F.when(
            reduce(lambda a, b: a | b, [kind == "unknown" for kind in kinds]),
            "corpus_ref_kind is unknown; strict reproducibility is not proven",
        ),
        F.when(dirty[0] | dirty[1], "at least one corpus is dirty; strict benchmark comparison is not proven"),
    )
    keys = [c for c in pairs.columns if c not in (left, right)]
    found = F.filter(messages, lambda message: message.isNotNull())
    return pairs.select(*keys, F.posexplode(found).alias("position", "warning"))
