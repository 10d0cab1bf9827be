"""Scoring, aggregation, leaderboards and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.metrics import PUBLISHED_K, Z_95, clamp01, pass_all_at_k, pass_at_k, wilson_ci
from assayer.operators import compare, scoring
from assayer.operators.ordered import running
from assayer.plans import inputs
from assayer.plans.registry import derive, plain, query


_RUNS = plain(inputs.RUNS)


def _product(favourable: str, k: int) -> str:
    factors = " * ".join(f"(greatest({favourable} - {j}, 0) / nullif(n - {j}, 0))" for j in range(k))
    return f"({factors})"


def _metrics_sql(runs: str, keys: str = "task_id, agent") -> str:
    """All metrics per group, unrounded."""
    at_k = ",\n".join(f"CASE WHEN n >= {k} THEN 1 - {_product('n - c', k)} END AS pass_at_{k}" for k in PUBLISHED_K)
    all_k = ",\n".join(f"CASE WHEN n >= {k} THEN {_product('c', k)} END AS pass_all_at_{k}" for k in PUBLISHED_K)
    z = Z_95
    half = f"{z} * sqrt((p * (1 - p) + {z * z} / (4.0 * n)) / n) / (1 + {z * z} / n)"
    middle = f"(p + {z * z} / (2.0 * n)) / (1 + {z * z} / n)"
    return f"""
    SELECT {keys}, n AS repeats, c AS successes, {at_k}, {all_k},
           greatest(0.0, {middle} - {half}) AS ci_low, least(1.0, {middle} + {half}) AS ci_high,
           mean_score, score_std_dev, mean_cost_usd,
           CASE WHEN c > 0 THEN mean_cost_usd / p END AS dollars_per_solve, mean_duration_s
    FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE passed) AS c,
                 count(*) FILTER (WHERE passed) / count(*) AS p,
                 avg(score) AS mean_score, stddev_samp(score) AS score_std_dev, avg(cost_usd) AS mean_cost_usd,
                 avg(duration_s) AS mean_duration_s
          FROM {runs} GROUP BY {keys})"""


METRIC_COLUMNS = (
    *(f"pass_at_{k}" for k in PUBLISHED_K), *(f"pass_all_at_{k}" for k in PUBLISHED_K), "ci_low", "ci_high",
    "mean_score", "score_std_dev", "mean_cost_usd", "dollars_per_solve", "mean_duration_s",
)


def _rounded_sql(columns: tuple[str, ...], digits: int = 10) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _rounded(df: DataFrame, *columns: str, digits: int = 10) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def aggregates(spark: SparkSession, sf_dir: str, text: str = inputs.RUNS) -> DataFrame:
    """Aggregates of the derived runs."""
    return scoring.aggregate_runs(derive(spark, sf_dir, text))


def flat(table: DataFrame) -> DataFrame:
    """Aggregates with one column per k and bound; the maps are pruned from the plan."""
    n, c = F.col("repeats"), F.col("successes")
    columns = {f"pass_at_{k}": pass_at_k(n, c, k) for k in PUBLISHED_K}
    columns |= {f"pass_all_at_{k}": pass_all_at_k(n, c, k) for k in PUBLISHED_K}
    columns |= {"ci_low": F.col("pass_at_1_ci95.low"), "ci_high": F.col("pass_at_1_ci95.high")}
    return table.withColumns(columns).select("task_id", "agent", "repeats", "successes", *METRIC_COLUMNS)


AGGREGATES_SQL = _metrics_sql(_RUNS)


@query(
    "A01_score_run",
    f"""SELECT run, coalesce(bool_and(passed) FILTER (WHERE required), true) AS passed,
        round(least(1, greatest(0, sum(weight * score) / sum(weight))), 10) AS score,
        NOT coalesce(sum(weight) > 0, false) AS bad_weights, count(*) AS checks
        FROM {plain(inputs.CHECKS)} GROUP BY run""",
)
def score_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.score_runs(derive(spark, sf_dir, inputs.CHECKS), ["run"]), "score")


@query("A02_aggregate_runs", f"SELECT task_id, agent, repeats, successes, {_rounded_sql(METRIC_COLUMNS)} FROM ({AGGREGATES_SQL})")
def aggregate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flat(aggregates(spark, sf_dir)), *METRIC_COLUMNS)


_COUNTS = "SELECT user_id AS agent, count(*) AS n, count(*) FILTER (WHERE value > 10) AS c FROM events GROUP BY user_id"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    counted = runs.groupBy(F.col("agent").cast("bigint").alias("agent")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c")
    )
    return counted


@query(
    "A03_pass_at_k",
    "SELECT agent, n, c, "
    + ", ".join(f"round(CASE WHEN n >= {k} THEN 1 - {_product('n - c', k)} END, 10) AS pass_at_{k}" for k in PUBLISHED_K)
    + f" FROM ({_COUNTS})",
)
def pass_at_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [F.round(pass_at_k(F.col("n"), F.col("c"), k), 10).alias(f"pass_at_{k}") for k in PUBLISHED_K]
    return _counts(spark, sf_dir).select("agent", "n", "c", *rates)


@query(
    "A04_pass_all_at_k",
    "SELECT agent, n, c, "
    + ", ".join(f"round(CASE WHEN n >= {k} THEN {_product('c', k)} END, 10) AS pass_all_at_{k}" for k in PUBLISHED_K)
    + f" FROM ({_COUNTS})",
)
def pass_all_at_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [F.round(pass_all_at_k(F.col("n"), F.col("c"), k), 10).alias(f"pass_all_at_{k}") for k in PUBLISHED_K]
    return _counts(spark, sf_dir).select("agent", "n", "c", *rates)


@query(
    "A05_wilson_ci",
    f"""SELECT agent, n, c, round(greatest(0.0, m - h), 10) AS ci_low, round(least(1.0, m + h), 10) AS ci_high
        FROM (SELECT *, (p + {Z_95 ** 2} / (2.0 * n)) / (1 + {Z_95 ** 2} / n) AS m,
                     {Z_95} * sqrt((p * (1 - p) + {Z_95 ** 2} / (4.0 * n)) / n) / (1 + {Z_95 ** 2} / n) AS h
              FROM (SELECT *, c / n AS p FROM ({_COUNTS})))""",
)
def wilson_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = wilson_ci(F.col("c"), F.col("n"))
    return _counts(spark, sf_dir).select(
        "agent", "n", "c", F.round(ci["low"], 10).alias("ci_low"), F.round(ci["high"], 10).alias("ci_high")
    )


_MEANS = ("mean_score", "score_std_dev", "mean_cost_usd", "dollars_per_solve", "mean_duration_s")


@query("A06_mean_metrics", f"SELECT task_id, agent, {_rounded_sql(_MEANS)} FROM ({AGGREGATES_SQL})")
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregates(spark, sf_dir).select("task_id", "agent", *_MEANS), *_MEANS)


def _by_agent_sql(source: str) -> str:
    return f"""SELECT agent, count(*) AS tasks, avg(pass_at_1) AS pass_at_1, avg(ci_low) AS ci_mean_low,
               avg(ci_high) AS ci_mean_high FROM ({source}) GROUP BY agent"""


@query(
    "A07_macro_by_agent",
    f"""SELECT agent, tasks, {_rounded_sql(('pass_at_1', 'ci_mean_low', 'ci_mean_high'))}
        FROM ({_by_agent_sql(AGGREGATES_SQL)})""",
)
def macro_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scoring.aggregate_by_agent(aggregates(spark, sf_dir))
    return _rounded(table, "pass_at_1", "ci_mean_low", "ci_mean_high")


@query(
    "A18_heatmap",
    f"SELECT agent, task_id, round(max(pass_at_1), 10) AS pass_at_1 FROM ({AGGREGATES_SQL}) GROUP BY agent, task_id",
)
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.heatmap(aggregates(spark, sf_dir), "agent", "task_id"), "pass_at_1")


@query(
    "A19_flaky_tasks",
    f"SELECT task_id, agent, repeats, successes FROM ({AGGREGATES_SQL}) WHERE successes > 0 AND successes < repeats",
)
def flaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flaky(aggregates(spark, sf_dir)).select("task_id", "agent", "repeats", "successes")


@query(
    "A20_known_spend",
    f"""SELECT agent, coalesce(CAST(sum(CAST(cost_usd AS DECIMAL(18, 6))) AS DOUBLE), 0) AS known_spend_usd,
        count(*) FILTER (WHERE cost_usd IS NULL) AS unknown_cost_runs FROM {_RUNS} GROUP BY agent""",
)
def known_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS).withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)"))
    return scoring.known_spend(runs, ["agent"]).withColumn("known_spend_usd", F.col("known_spend_usd").cast("double"))


@query(
    "O01_leaderboard",
    f"""SELECT agent, task_id, repeats, successes,
        {_rounded_sql(('pass_at_1', 'pass_at_5', 'ci_low', 'ci_high', 'mean_score'))}
        FROM ({AGGREGATES_SQL}) ORDER BY pass_at_1 DESC, agent, task_id""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = compare.leaderboard(flat(aggregates(spark, sf_dir)))
    rounded = ("pass_at_1", "pass_at_5", "ci_low", "ci_high", "mean_score")
    return _rounded(board.select("agent", "task_id", "repeats", "successes", *rounded), *rounded)


def _text_sql(*parts: str) -> str:
    """Parts joined to a text line; a part ``name:format`` is a number with three decimals."""
    return " || ".join(f"format('{{:{p.split(':')[1]}}}', {p.split(':')[0]})" if ":" in p else p for p in parts)


_THREE = ".3f"


def _interval_sql(low: str, high: str) -> tuple[str, ...]:
    return f"{low}:{_THREE}", "'..'", f"{high}:{_THREE}"


@query(
    "O01_leaderboard_lines",
    f"""SELECT {_text_sql("agent", "chr(9)", "task_id", "chr(9)", "'pass@1='", f"pass_at_1:{_THREE}", "chr(9)", "'ci95='",
                          *_interval_sql("ci_low", "ci_high"), "chr(9)", "'score='", f"mean_score:{_THREE}")} AS line
        FROM ({AGGREGATES_SQL}) ORDER BY pass_at_1 DESC, agent, task_id""",
)
def leaderboard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.leaderboard_lines(aggregates(spark, sf_dir))


@query(
    "O02_index_order",
    f"SELECT agent, task_id, round(pass_at_1, 10) AS pass_at_1 FROM ({AGGREGATES_SQL}) ORDER BY pass_at_1 DESC, agent, task_id",
)
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.leaderboard(aggregates(spark, sf_dir)).select("agent", "task_id", "pass_at_1"), "pass_at_1")


_LEFT, _RIGHT = _metrics_sql(plain(inputs.LEFT_RUNS)), _metrics_sql(plain(inputs.RIGHT_RUNS))
_SIDES = ("tasks", "pass_at_1", "ci_mean_low", "ci_mean_high")


@query(
    "J09_compare_agents",
    f"""SELECT coalesce(l.agent, r.agent) AS agent,
        {', '.join(f'round({s[0]}.{c}, 10) AS {s}_{c}' for s in ('left', 'right') for c in _SIDES)},
        round(r.pass_at_1 - l.pass_at_1, 10) AS delta,
        l.agent IS NULL OR r.agent IS NULL AS missing_on_one_side
        FROM ({_by_agent_sql(_LEFT)}) l FULL JOIN ({_by_agent_sql(_RIGHT)}) r ON l.agent = r.agent""",
)
def compare_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (aggregates(spark, sf_dir, text) for text in (inputs.LEFT_RUNS, inputs.RIGHT_RUNS))
    table = compare.compare_agents(left, right)
    return _rounded(table, *[c for c in table.columns if c.startswith(("left_", "right_", "delta"))])


@query(
    "J10_compare_tasks",
    f"""SELECT coalesce(l.task_id, r.task_id) AS task_id, coalesce(l.agent, r.agent) AS agent,
        round(l.pass_at_1, 10) AS left_pass_at_1, round(l.ci_low, 10) AS left_ci_low, round(l.ci_high, 10) AS left_ci_high,
        round(r.pass_at_1, 10) AS right_pass_at_1, round(r.ci_low, 10) AS right_ci_low, round(r.ci_high, 10) AS right_ci_high,
        CASE WHEN l.agent IS NULL OR r.agent IS NULL THEN 'missing' WHEN r.pass_at_1 > l.pass_at_1 THEN 'improved'
             WHEN r.pass_at_1 < l.pass_at_1 THEN 'regressed' ELSE 'unchanged' END AS status
        FROM ({_LEFT}) l FULL JOIN ({_RIGHT}) r ON l.agent = r.agent AND l.task_id = r.task_id""",
)
def compare_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (aggregates(spark, sf_dir, text) for text in (inputs.LEFT_RUNS, inputs.RIGHT_RUNS))
    table = compare.compare_tasks(left, right)
    return _rounded(table, *[c for c in table.columns if c.startswith(("left_", "right_"))])


@query(
    "J09_compare_agent_lines",
    f"""SELECT coalesce(l.agent, r.agent) || ': ' || CASE WHEN l.agent IS NULL OR r.agent IS NULL THEN 'missing on one side' ELSE
               {_text_sql("'pass_at_1 '", f"l.pass_at_1:{_THREE}", "' ci95='", *_interval_sql("l.ci_mean_low", "l.ci_mean_high"),
                          "' -> '", f"r.pass_at_1:{_THREE}", "' ci95='", *_interval_sql("r.ci_mean_low", "r.ci_mean_high"),
                          "' (delta '", f"(round(r.pass_at_1 - l.pass_at_1, 10) + 0.0):+{_THREE}", "')'")} END AS line
        FROM ({_by_agent_sql(_LEFT)}) l FULL JOIN ({_by_agent_sql(_RIGHT)}) r ON l.agent = r.agent""",
)
def compare_agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (aggregates(spark, sf_dir, text) for text in (inputs.LEFT_RUNS, inputs.RIGHT_RUNS))
    return compare.compare_agent_lines(compare.compare_agents(left, right))


@query(
    "J10_compare_task_lines",
    f"""SELECT coalesce(l.task_id, r.task_id) || ' ' || coalesce(l.agent, r.agent) || ': ' ||
               CASE WHEN l.agent IS NULL OR r.agent IS NULL THEN 'missing' ELSE
               CASE WHEN r.pass_at_1 > l.pass_at_1 THEN 'improved' WHEN r.pass_at_1 < l.pass_at_1 THEN 'regressed' ELSE 'unchanged' END ||
               {_text_sql("' pass_at_1 '", f"l.pass_at_1:{_THREE}", "' ci95='", *_interval_sql("l.ci_low", "l.ci_high"),
                          "' -> '", f"r.pass_at_1:{_THREE}", "' ci95='", *_interval_sql("r.ci_low", "r.ci_high"))} END AS line
        FROM ({_LEFT}) l FULL JOIN ({_RIGHT}) r ON l.agent = r.agent AND l.task_id = r.task_id""",
)
def compare_task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (aggregates(spark, sf_dir, text) for text in (inputs.LEFT_RUNS, inputs.RIGHT_RUNS))
    return compare.compare_task_lines(compare.compare_tasks(left, right))


@query(
    "O07_union_of_keys",
    f"""SELECT task_id, agent, bool_or(side = 'left') AS in_left, bool_or(side = 'right') AS in_right FROM (
          SELECT task_id, agent, 'left' AS side FROM {plain(inputs.LEFT_RUNS)} UNION ALL
          SELECT task_id, agent, 'right' FROM {plain(inputs.RIGHT_RUNS)}) GROUP BY task_id, agent""",
)
def union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (aggregates(spark, sf_dir, text) for text in (inputs.LEFT_RUNS, inputs.RIGHT_RUNS))
    both = compare.compare_tasks(left, right)
    sides = {f"in_{side}": F.col(f"{side}_pass_at_1").isNotNull() for side in ("left", "right")}
    return both.select("task_id", "agent", *[flag.alias(name) for name, flag in sides.items()])


_SUITES = """
SELECT c_custkey AS pair, CASE WHEN c_custkey % {k} = 0 THEN '1.0.0' ELSE '1.1.0' END AS schema_version,
       '0.' || CAST(c_custkey % {k} AS STRING) || '.0' AS version, c_mktsegment AS corpus_git_sha,
       CASE WHEN c_custkey % {m} = 0 THEN 'unknown' ELSE 'git' END AS corpus_ref_kind, c_acctbal < {d} AS corpus_dirty
FROM {{customer}}"""
_SUITE_LEFT, _SUITE_RIGHT = _SUITES.format(k=2, m=5, d=0), _SUITES.format(k=3, m=7, d=-500)


@query(
    "J11_comparability_warnings",
    f"""WITH p AS (SELECT l.pair, l.schema_version AS ls, r.schema_version AS rs, l.version AS lv, r.version AS rv,
               l.corpus_git_sha AS lg, r.corpus_git_sha AS rg, l.corpus_ref_kind AS lk, r.corpus_ref_kind AS rk,
               l.corpus_dirty AS ld, r.corpus_dirty AS rd
          FROM {plain(_SUITE_LEFT)} l JOIN {plain(_SUITE_RIGHT)} r ON l.pair = r.pair)
        SELECT pair, 'schema_version differs: ' || ls || ' != ' || rs AS warning FROM p WHERE ls <> rs
        UNION ALL SELECT pair, 'suite.version differs: ' || lv || ' != ' || rv FROM p WHERE lv <> rv
        UNION ALL SELECT pair, 'corpus_git_sha differs' FROM p WHERE lg <> rg
        UNION ALL SELECT pair, 'corpus_ref_kind is unknown; strict reproducibility is not proven' FROM p
                  WHERE lk = 'unknown' OR rk = 'unknown'
        UNION ALL SELECT pair, 'at least one corpus is dirty; strict benchmark comparison is not proven' FROM p
                  WHERE ld OR rd""",
)
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(text: str, name: str) -> DataFrame:
        rows = derive(spark, sf_dir, text)
        return rows.select("pair", F.struct(*[c for c in rows.columns if c != "pair"]).alias(name))

    pairs = side(_SUITE_LEFT, "left").join(side(_SUITE_RIGHT, "right"), "pair")
    return compare.comparability_warnings(pairs).select("pair", "warning")


@query(
    "W03_repeat_index",
    f"""SELECT event_id, task_id, agent, row_number() OVER (PARTITION BY task_id, agent ORDER BY event_id) - 1 AS repeat
        FROM {_RUNS}""",
)
def repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS).select("event_id", "task_id", "agent")
    numbered = running(runs, ["task_id", "agent"], ["event_id"], number="repeat")
    return numbered.withColumn("repeat", F.col("repeat") - 1)


@query(
    "E01_run_status",
    """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'harness_crash' WHEN event_id % 17 = 0 THEN 'sandbox_error'
              WHEN event_type = 'error' THEN 'timeout' ELSE 'none' END AS error_kind,
       value > 10 AND event_id % 31 <> 0 AND event_id % 17 <> 0 AND event_type <> 'error' AS passed,
       round(least(1.0, greatest(0.0, value / 100)), 10) AS score FROM events""",
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    status = scoring.run_status(
        F.col("passed"),
        scoring.agent_error_kind(F.col("task_id") == "error"),
        F.when(F.col("event_id") % 17 == 0, 1).otherwise(0),
        F.when(F.col("event_id") % 31 == 0, F.lit("boom")),
    )
    return runs.select("event_id", status.alias("s"), F.round(clamp01(F.col("score")), 10).alias("score")).select(
        "event_id", "s.error_kind", "s.passed", "score"
    )


@query(
    "E02_agent_error",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'none' END AS error_kind,
       CASE WHEN user_id % 4 <> 0 THEN 'agent exited with code ' || CAST(user_id % 4 AS VARCHAR) END AS error_detail FROM events""",
)
def agent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    code = F.col("agent").cast("bigint") % 4
    return runs.select(
        "event_id", scoring.agent_error_kind(F.col("task_id") == "error").alias("error_kind"),
        scoring.agent_error_detail(code).alias("error_detail"),
    )


@query(
    "N11_clamp_score",
    "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 1.5 - 20 * l_discount)), 10) AS score FROM lineitem",
)
def clamp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_discount FROM {lineitem}")
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(clamp01(1.5 - 20 * F.col("l_discount")), 10).alias("score")
    )
