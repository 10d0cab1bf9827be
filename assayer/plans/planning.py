"""Planning, resuming and budgeting of work; keys and seeds; agent selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import keys
from assayer.functions.text import is_secret_name, iso_utc
from assayer.operators import planning
from assayer.operators.ordered import running
from assayer.plans import inputs
from assayer.plans.registry import derive, plain, query

AGENTS = ("codex", "aider", "claude")
REPEATS = 3
SEED = 42

_TASKS = "SELECT 't-' || CAST(p_partkey AS STRING) AS task_id, 10 + p_size AS timeout_s FROM {part}"


def _seed_sql(payload: str) -> str:
    return f"(('0x' || right(sha256({payload}), 8))::BIGINT + {SEED}) % 2147483648"


_MATRIX_SQL = f"""
(SELECT task_id, timeout_s, agent, CAST(repeat AS INT) AS repeat,
        {_seed_sql(f"'{SEED}:' || task_id || ':' || agent || ':' || repeat")} AS seed
 FROM {plain(_TASKS)}, (SELECT unnest({list(AGENTS)}) AS agent), (SELECT unnest(range({REPEATS})) AS repeat))"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the derived tasks."""
    return planning.build_matrix(derive(spark, sf_dir, _TASKS), AGENTS, REPEATS, SEED)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with both content hashes and their key."""
    hashed = matrix(spark, sf_dir).withColumns(
        {"task_version_hash": F.sha2(F.concat(F.lit("v1 "), "task_id"), 256), "env_manifest_hash": F.lit("env")}
    )
    return planning.with_cell_key(hashed)


_CELLS_SQL = f"""
(SELECT *, sha256('{{"agent":"' || agent || '","env_manifest_hash":"env","repeat":' || repeat || ',"seed":' || seed ||
        ',"task_id":"' || task_id || '","task_version_hash":"' || sha256('v1 ' || task_id) || '"}}') AS run_key
 FROM {_MATRIX_SQL})"""

_DONE = "timeout_s % 3 = 0 OR (timeout_s % 3 = 1 AND repeat = 0)"
_CRASHED = "timeout_s % 5 = 0"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that were saved before: some of the cells, some of them crashed."""
    kind = F.when(F.expr(_CRASHED), "harness_crash").otherwise("none")
    return cells(spark, sf_dir).filter(_DONE).select("run_key", kind.alias("error_kind"))


@query("J01_build_matrix", f"SELECT task_id, agent, repeat, seed FROM {_MATRIX_SQL} ORDER BY task_id, agent, repeat")
def build_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("task_id", "agent", "repeat", "seed").orderBy("task_id", "agent", "repeat")


@query("J03_resume_hits", f"SELECT task_id, agent, repeat FROM {_MATRIX_SQL} WHERE {_DONE}")
def resume_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = planning.completed(cells(spark, sf_dir), stored(spark, sf_dir))
    return hits.select("task_id", "agent", "repeat")


@query("J03_pending_cells", f"SELECT task_id, agent, repeat FROM {_MATRIX_SQL} WHERE NOT ({_DONE})")
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_cells = planning.pending(cells(spark, sf_dir), stored(spark, sf_dir))
    return open_cells.select("task_id", "agent", "repeat")


@query("J03_pending_with_retry", f"SELECT task_id, agent, repeat FROM {_MATRIX_SQL} WHERE NOT (({_DONE}) AND NOT ({_CRASHED}))")
def pending_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_cells = planning.pending(cells(spark, sf_dir), stored(spark, sf_dir), retry_errors=True)
    return open_cells.select("task_id", "agent", "repeat")


_METADATA = """
SELECT c_custkey AS suite, 'repeats' AS key, CAST(c_nationkey % {d} AS STRING) AS value FROM {{customer}}
UNION ALL SELECT c_custkey, 'sandbox', CASE WHEN c_custkey % {d} = 0 THEN 'bwrap' ELSE 'process' END FROM {{customer}}
UNION ALL SELECT c_custkey, 'run_id', c_name || '-{d}' FROM {{customer}}
UNION ALL SELECT c_custkey, 'agent_env', 'isolated' FROM {{customer}} WHERE c_custkey % 2 = 0"""
_META_OLD, _META_NEW = _METADATA.format(d=5), _METADATA.format(d=4)


@query(
    "J12_metadata_mismatch",
    f"""SELECT o.suite, o.key, o.value AS stored_value, n.value AS current_value FROM {plain(_META_OLD)} o
        JOIN {plain(_META_NEW)} n ON o.suite = n.suite AND o.key = n.key
        WHERE o.value <> n.value AND o.key <> 'run_id'""",
)
def metadata_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.metadata_mismatch(derive(spark, sf_dir, _META_OLD), derive(spark, sf_dir, _META_NEW), ["suite"])


@query("P12_runnable_cells", f"SELECT task_id, agent, repeat FROM {_MATRIX_SQL} WHERE agent <> 'aider'")
def runnable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = matrix(spark, sf_dir)
    skipped = planned.filter("agent = 'aider'").select("agent").distinct()
    return planning.runnable(planned, skipped).select("task_id", "agent", "repeat")


@query(
    "A13_plan_summary",
    f"""SELECT count(*) AS planned_cells, count(*) FILTER (WHERE {_DONE}) AS resume_hits,
        count(*) FILTER (WHERE NOT ({_DONE})) AS pending_cells,
        count(*) FILTER (WHERE NOT ({_DONE}) AND agent <> 'aider') AS runnable_cells,
        CAST(sum(timeout_s) AS BIGINT) AS timeout_ceiling_s FROM {_MATRIX_SQL}""",
)
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = cells(spark, sf_dir)
    skipped = planned.filter("agent = 'aider'").select("agent")
    return planning.plan_summary(planned, stored(spark, sf_dir), skipped)


@query("A14_timeout_ceiling", f"SELECT CAST(sum(timeout_s) AS BIGINT) AS timeout_ceiling_s FROM {_MATRIX_SQL}")
def timeout_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.timeout_ceiling(matrix(spark, sf_dir), derive(spark, sf_dir, _TASKS))


_CAP = 25.0


@query(
    "W02_budget_cutoff",
    f"""SELECT event_id, task_id, CAST(spent AS DOUBLE) AS spent_before, spent < {_CAP} AS admitted,
        CASE WHEN NOT (spent < {_CAP}) THEN 'budget_exceeded' END AS shutdown_reason
        FROM (SELECT *, coalesce(sum(coalesce(CAST(cost_usd AS DECIMAL(18, 6)), 0)) OVER (
                PARTITION BY task_id ORDER BY finished_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
              FROM {plain(inputs.RUNS)})""",
)
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    judged = planning.admit_within_budget(runs, _CAP, ["task_id"], ["finished_at", "event_id"])
    return judged.select("event_id", "task_id", F.col("spent_before").cast("double"), "admitted", "shutdown_reason")


@query(
    "A20_running_spend",
    f"""SELECT event_id, CAST(sum(coalesce(CAST(cost_usd AS DECIMAL(18, 6)), 0)) OVER (ORDER BY finished_at, event_id
          ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS known_spend FROM {plain(inputs.RUNS)}""",
)
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    cost = F.coalesce(F.col("cost_usd").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    total = running(
        runs.select("event_id", "finished_at", cost.alias("cost")), [], ["finished_at", "event_id"],
        sums={"known_spend": "cost"},
    )
    return total.select("event_id", F.col("known_spend").cast("double"))


@query(
    "H01_canonical_json",
    """SELECT doc_id, '{"agent":' || to_json(lang) || ',"env":null,"repeat":' || doc_id % 7 || ',"task_id":' || to_json(source || ' "é"') || '}' AS payload
       FROM documents""",
)
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, "SELECT doc_id, lang, source FROM {documents}")
    payload = keys.canonical_json(
        task_id=F.concat("source", F.lit(' "é"')), agent=F.col("lang"), repeat=F.col("doc_id") % 7,
        env=F.lit(None).cast("string"),
    )
    return rows.select("doc_id", payload.alias("payload"))


@query("H02_run_seed", f"SELECT task_id, agent, repeat, seed FROM {_MATRIX_SQL}")
def run_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("task_id", "agent", "repeat", "seed")


_CHECK_SEED = f"'{SEED}:' || task_id || ':checks'"


@query("H03_check_seed", f"SELECT task_id, {_seed_sql(_CHECK_SEED)} AS seed FROM {plain(_TASKS)}")
def check_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _TASKS).select("task_id", keys.check_seed(F.lit(SEED), F.col("task_id")).alias("seed"))


@query("H04_run_key", f"SELECT task_id, agent, repeat, run_key FROM {_CELLS_SQL}")
def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("task_id", "agent", "repeat", "run_key")


@query(
    "H05_aggregate_key",
    """SELECT DISTINCT event_type AS task_id, CAST(user_id AS VARCHAR) AS agent,
       sha256('{"agent":"' || user_id || '","task_id":"' || event_type || '"}') AS aggregate_key FROM events""",
)
def aggregate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = derive(spark, sf_dir, inputs.RUNS).select("task_id", "agent").distinct()
    return pairs.withColumn("aggregate_key", keys.aggregate_key(F.col("task_id"), F.col("agent")))


@query(
    "H07_env_manifest_hash",
    """SELECT c_custkey, sha256('{"nation":"' || c_nationkey || '","os":"' || c_mktsegment || '","python":"' || c_name || '"}') AS env_manifest_hash
       FROM customer""",
)
def env_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM {customer}")
    manifest = F.create_map(
        F.lit("python"), F.col("c_name"), F.lit("os"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")
    )
    return rows.select("c_custkey", keys.env_manifest_hash(manifest).alias("env_manifest_hash"))


@query(
    "H08_run_id",
    """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(sha256('{"agents":["' || user_id || '"],"pid":7,"repeats":2,"sandbox":"process","sequence":'
         || event_id || ',"tasks":["' || event_type || '"],"timestamp":"' || strftime(ts, '%Y%m%dT%H%M%SZ') || '"}'), 8) AS run_id FROM events""",
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derive(spark, sf_dir, inputs.RUNS)
    run_id = keys.run_id(
        F.col("finished_at"), F.array("agent"), F.array("task_id"), F.lit(2), F.lit("process"), F.lit(7), F.col("event_id")
    )
    return runs.select("event_id", run_id.alias("run_id"))


@query("H09_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS finished_at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, inputs.RUNS).select("event_id", iso_utc(F.col("finished_at")).alias("finished_at"))


_NAMES = """SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 6 WHEN 0 THEN '_api_key' WHEN 1 THEN '_Token'
            WHEN 2 THEN '_HOME' WHEN 3 THEN '_PassWord' WHEN 4 THEN '_author' ELSE '_path' END AS name FROM {part}"""


@query(
    "P08_secret_names",
    f"SELECT p_partkey, name, regexp_matches(upper(name), 'KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|AUTH') AS secret FROM {plain(_NAMES)}",
)
def secret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _NAMES).select("p_partkey", "name", is_secret_name(F.col("name")).alias("secret"))


_LISTS = "SELECT p_partkey, ' ' || replace(p_name, ' ', ' , ,') || ',' || p_brand || ', ' AS agents FROM {part}"


@query(
    "P10_parse_agents",
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(agents, ','), lambda a: trim(a)), lambda a: a <> ''), '|') AS agents
        FROM {plain(_LISTS)}""",
)
def parse_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _LISTS).select(
        "p_partkey", F.array_join(planning.parse_agents(F.col("agents")), "|").alias("agents")
    )


_REQUESTED = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'codex' WHEN 1 THEN 'codex:gpt:' || CAST(p_size AS STRING) WHEN 2 THEN 'pi:'
                WHEN 3 THEN 'fast' WHEN 4 THEN 'aider:x' WHEN 5 THEN 'other' WHEN 6 THEN 'claude' ELSE 'slow' END AS agent FROM {part}"""
_ALIASES = """SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'fast' ELSE 'slow' END AS agent,
              CASE WHEN p_size % 2 = 0 THEN 'opencode:small' ELSE 'oracle' END AS target FROM {part}"""


@query(
    "P11_resolve_agents",
    """SELECT p_partkey,
       CASE k WHEN 0 THEN 'codex' WHEN 1 THEN 'codex' WHEN 2 THEN 'pi' WHEN 3 THEN 'opencode' WHEN 4 THEN 'aider' WHEN 5 THEN 'other' WHEN 6 THEN 'claude' ELSE 'oracle' END AS adapter,
       CASE k WHEN 1 THEN 'gpt:' || p_size WHEN 2 THEN '' WHEN 3 THEN 'small' WHEN 4 THEN 'x' END AS model,
       CASE k WHEN 2 THEN 'invalid agent mapping' WHEN 4 THEN 'adapter does not support model override' WHEN 5 THEN 'unknown adapter' END AS error
       FROM (SELECT *, p_partkey % 8 AS k FROM part)""",
)
def resolve_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = planning.resolve_agents(derive(spark, sf_dir, _REQUESTED), derive(spark, sf_dir, _ALIASES))
    return resolved.select("p_partkey", "adapter", "model", "error")
