"""Planning and resuming work: matrix, anti-joins, budgets, agent selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.keys import run_key, run_seed
from assayer.functions.text import strip
from assayer.operators.ordered import running
from assayer.operators.quality import check_settings
from assayer.session import by_shuffle, spread

# Adapter names and which of them accept a model, metadata keys that
# must not change between a run and its resumption, the keys of a suite run.
ADAPTERS = {"oracle": False, "codex": True, "aider": False, "claude": False, "opencode": True, "pi": True}
RESUME_KEYS = (
    "env_manifest_hash", "task_selection", "task_version_hashes_json", "agent_selection",
    "agent_env", "repeats", "sandbox",
)
SUITE_KEYS = (
    "agent_selection", "agent_env", "corpus_dirty", "corpus_git_sha", "corpus_ref_kind", "created_at", "env_manifest_hash", "repeats", "run_id",
    "sandbox", "schema_version", "suite_name", "suite_version", "task_selection", "task_version_hashes_json",
)
CELL_KEY = ("task_id", "agent", "repeat", "seed", "task_version_hash", "env_manifest_hash")


def build_matrix(tasks: DataFrame, agents: Sequence[str], repeats: int, base_seed: int = 42) -> DataFrame:
    """One cell per (task, agent, repeat) with its seed.

    Agents and repeats are parameters, so each task row is expanded in place and
    nothing is joined. Extra task columns are kept. ``repeats`` has the bounds of rule V21. A small task table is dealt
    out first, because the expansion and its hashing stay in the row's partition.
    """
    check_settings(repeats=repeats)
    cells = spread(tasks).withColumn("agent", F.explode(F.array(*[F.lit(a) for a in sorted(agents)]))).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    seed = run_seed(F.lit(base_seed), F.col("task_id"), F.col("agent"), F.col("repeat"))
    return cells.withColumn("seed", seed)


def with_cell_key(cells: DataFrame) -> DataFrame:
    """Adds ``run_key`` to cells that carry both content hashes."""
    return cells.withColumn("run_key", run_key(**{name: F.col(name) for name in CELL_KEY}))


def completed(cells: DataFrame, runs: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Cells whose exact key is already stored; crashed runs count unless retried."""
    done = runs.filter(F.col("error_kind") == "none") if retry_errors else runs
    return cells.join(by_shuffle(done.select("run_key")), "run_key", "left_semi")


def pending(cells: DataFrame, runs: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Cells still to run."""
    done = runs.filter(F.col("error_kind") == "none") if retry_errors else runs
    return cells.join(by_shuffle(done.select("run_key")), "run_key", "left_anti")


def runnable(cells: DataFrame, skipped: DataFrame) -> DataFrame:
    """Cells of agents that were not skipped."""
    return cells.join(skipped.select("agent"), "agent", "left_anti")


def plan_summary(cells: DataFrame, runs: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Planned, resumed and pending cells and the sum of their timeouts, in one row."""
    marked = cells.join(
        by_shuffle(runs.select("run_key").distinct().withColumn("__done", F.lit(True))), "run_key", "left"
    )
    if skipped is None:
        marked = marked.withColumn("__skip", F.lit(False))
    else:
        names = skipped.select("agent").distinct().withColumn("__skipped", F.lit(True))
        marked = marked.join(names, "agent", "left").withColumn("__skip", F.coalesce("__skipped", F.lit(False)))
    done = F.coalesce(F.col("__done"), F.lit(False))
    timeout = F.col("timeout_s") if "timeout_s" in cells.columns else F.lit(0)
    return marked.agg(
        F.count(F.lit(1)).alias("planned_cells"),
        F.count_if(done).alias("resume_hits"),
        F.count_if(~done).alias("pending_cells"),
        F.count_if(~done & ~F.col("__skip")).alias("runnable_cells"),
        F.coalesce(F.sum(timeout), F.lit(0)).cast("bigint").alias("timeout_ceiling_s"),
    )


def timeout_ceiling(cells: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sum of the task timeouts over all cells."""
    per_task = cells.groupBy("task_id").agg(F.count(F.lit(1)).alias("cells"))
    return per_task.join(tasks.select("task_id", "timeout_s"), "task_id").agg(
        F.coalesce(F.sum(F.col("cells") * F.col("timeout_s")), F.lit(0)).cast("bigint").alias("timeout_ceiling_s")
    )


def admit_within_budget(runs: DataFrame, cap: float, suite: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Marks the runs started while the known spend was still below ``cap``.

    Costs are summed as decimals so the cut-off does not depend on the order of
    additions. A run of unknown cost adds nothing.
    """
    known = runs.withColumn("__cost", F.coalesce(F.col("cost_usd").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")))
    spent = running(known, suite, order, sums={"spent_before": "__cost"}, inclusive=False)
    admitted = F.col("spent_before") < F.lit(str(cap)).cast("decimal(18,6)")
    return spent.drop("__cost").withColumns(
        {"admitted": admitted, "shutdown_reason": F.when(~admitted, "budget_exceeded")}
    )


def metadata_mismatch(stored: DataFrame, current: DataFrame, suite: Sequence[str] = ()) -> DataFrame:
    """Guarded keys whose stored value differs from the current one."""
    old = stored.select(*suite, "key", F.col("value").alias("stored_value"))
    new = current.select(*suite, "key", F.col("value").alias("current_value"))
    return old.filter(F.col("key").isin(*RESUME_KEYS)).join(new, [*suite, "key"]).filter(
        F.col("stored_value") != F.col("current_value")
    )


def suite_metadata(suites: DataFrame, suite: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Key-value rows describing each suite run, one row per key."""
    pairs = F.array(
        *[F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")) for key, value in sorted(values.items())]
    )
    return suites.select(*suite, F.inline(pairs))


def selection_metadata(tasks: DataFrame, agents: DataFrame, suite: Sequence[str]) -> DataFrame:
    """What each suite run selects, as the JSON texts that its metadata hold.

    ``tasks(suite, task_id, task_version_hash, position)`` and ``agents(suite,
    agent, position)`` in the order of the selection. Quoting is done per row, so
    a suite's lists are only joined.
    """
    def quoted(name: str) -> Column:
        return F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")

    def listed(pieces: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.struct("position", pieces.alias("text"))))["text"], ", "), F.lit("]"))

    hashed = F.struct("task_id", F.concat(quoted("task_id"), F.lit(": "), quoted("task_version_hash")).alias("text"))
    by_task = tasks.groupBy(*suite).agg(
        listed(quoted("task_id")).alias("task_selection"),
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set(hashed))["text"], ", "), F.lit("}")).alias("task_version_hashes_json"),
    )
    by_agent = agents.groupBy(*suite).agg(listed(quoted("agent")).alias("agent_selection"))
    return by_task.join(by_agent, list(suite), "full_outer")


def build_metadata(suites: DataFrame, tasks: DataFrame, agents: DataFrame, suite: Sequence[str]) -> DataFrame:
    """The metadata rows of new suite runs: every key of ``SUITE_KEYS``, one row each.

    ``suites`` has the suite columns and those keys that are not selections;
    flags become ``true`` or ``false``, times are given as text. A suite without
    tasks or agents selects none.
    """
    chosen = suites.join(selection_metadata(tasks, agents, suite), list(suite), "left")
    none = {"task_selection": "[]", "agent_selection": "[]", "task_version_hashes_json": "{}"}
    values = {key: F.coalesce(key, F.lit(none[key])) if key in none else F.col(key) for key in SUITE_KEYS}
    return suite_metadata(chosen, suite, values)


def parse_agents(text: Column) -> Column:
    """Names of a comma-separated list, trimmed, without empties; null when none is left."""
    names = F.filter(F.transform(F.split(text, ","), strip), lambda name: name != "")
    return F.when(F.size(names) > 0, names)


def resolve_agents(requested: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adapter and model of each requested agent name, or why it is invalid.

    ``aliases`` maps ``agent`` to ``target``; a target is ``adapter`` or
    ``adapter:model``, split at the first colon.
    """
    named = requested if aliases is None else requested.join(aliases.select("agent", "target"), "agent", "left")
    target = F.col("agent") if aliases is None else F.coalesce("target", "agent")
    named = named.withColumn("target", target)
    has_model = F.contains("target", F.lit(":"))
    adapter = F.substring_index("target", ":", 1)
    model = F.when(has_model, F.expr("substring(target, locate(':', target) + 1)"))
    known = F.create_map(*[F.lit(x) for pair in ADAPTERS.items() for x in pair])
    takes_model = F.try_element_at(known, adapter)
    error = (
        F.when(has_model & ((adapter == "") | (model == "")), "invalid agent mapping")
        .when(takes_model.isNull(), "unknown adapter")
        .when(has_model & ~takes_model, "adapter does not support model override")
    )
    return named.withColumns({"adapter": adapter, "model": model, "error": error})
