"""Fixed record schemas of the data model (never inferred)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

SCHEMA_VERSION = "1.0.0"

# The domains of the enumerated columns.
ERROR_KINDS = (
    "none", "agent_not_found", "agent_smoke_failed", "timeout", "oom", "sandbox_error",
    "check_timeout", "check_failed", "check_crash", "harness_crash", "interrupted",
    "schema_error", "egress_error", "budget_exceeded",
)
CHECK_TYPES = (
    "ruff", "mypy", "pytest", "ast_defines", "ast_signature", "ast_no_import",
    "content_present", "content_absent", "file_exists", "file_absent", "diff_scope",
    "integrity", "no_test_tamper",
)
CATEGORIES = (
    "single_file_bugfix", "cross_file_refactor", "api_preserving_rewrite",
    "concurrency_correctness", "performance_bound", "property_spec_impl",
    "dependency_surgery", "backward_compat", "adversarial_decoy", "subtle_semantics",
)
SYMBOL_KINDS = ("function", "class", "method")
SANDBOXES = ("process", "bwrap", "docker")
ENV_MODES = ("isolated", "host")


def _fields(spec: dict) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in spec.items()])


_TEXT, _INT, _LONG, _REAL, _FLAG = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
_TEXTS = ArrayType(_TEXT)

AGENT_RESULT = _fields({
    "agent": _TEXT, "agent_version": _TEXT, "exit_code": _INT, "timed_out": _FLAG,
    "duration_s": _REAL, "cost_usd": _REAL, "tokens_in": _LONG, "tokens_out": _LONG,
    "stdout_tail": _TEXT, "stderr_tail": _TEXT, "error_kind": _TEXT, "error_detail": _TEXT,
})

CHECK_RESULT = _fields({
    "name": _TEXT, "type": _TEXT, "required": _FLAG, "weight": _REAL, "passed": _FLAG,
    "score": _REAL, "detail": _TEXT, "duration_s": _REAL, "error_kind": _TEXT,
    "error_detail": _TEXT,
})

RUN = _fields({
    "schema_version": _TEXT, "run_id": _TEXT, "task_id": _TEXT, "task_version": _TEXT,
    "agent": _TEXT, "repeat": _INT, "seed": _LONG, "agent_result": AGENT_RESULT,
    "checks": ArrayType(CHECK_RESULT), "passed": _FLAG, "score": _REAL, "error_kind": _TEXT,
    "error_detail": _TEXT, "started_at": _TEXT, "finished_at": _TEXT, "artifacts_dir": _TEXT,
    "task_version_hash": _TEXT, "env_manifest_hash": _TEXT,
})

AGGREGATE = _fields({
    "task_id": _TEXT, "agent": _TEXT, "repeats": _LONG, "successes": _LONG, "pass_at_1": _REAL,
    "pass_at_k": MapType(_TEXT, _REAL), "pass_all_at_k": MapType(_TEXT, _REAL),
    "pass_at_1_ci95": ArrayType(_REAL), "mean_score": _REAL, "score_std_dev": _REAL,
    "mean_cost_usd": _REAL, "dollars_per_solve": _REAL, "mean_duration_s": _REAL,
})

SUITE = _fields({
    "name": _TEXT, "version": _TEXT, "corpus_git_sha": _TEXT, "corpus_ref_kind": _TEXT,
    "corpus_dirty": _FLAG, "calibration_date": _TEXT, "calibration_agents": _TEXTS,
})

REPORT = _fields({
    "schema_version": _TEXT, "run_id": _TEXT, "generated_at": _TEXT, "suite": SUITE,
    "metadata": MapType(_TEXT, _TEXT), "runs": ArrayType(RUN), "aggregates": ArrayType(AGGREGATE),
})

LIMITS = _fields({"cpu_s": _INT, "mem_mb": _INT, "nproc": _INT, "fsize_mb": _INT})

CHECK_SPEC = _fields({
    "name": _TEXT, "type": _TEXT, "weight": _REAL, "check_timeout_s": _INT, "args": _TEXTS,
    "inject": _TEXTS, "strict": _FLAG, "allow": _INT, "threshold": _INT, "symbol": _TEXT,
    "kind": _TEXT, "in_file": _TEXT, "signature": _TEXT, "module": _TEXT, "names": _TEXTS,
    "forbid_in_globs": _TEXTS, "path": _TEXT, "pattern": _TEXT, "max_files_changed": _INT,
    "forbid_changes": _TEXTS,
})

TASK = _fields({
    "id": _TEXT, "version": _TEXT, "tier": _INT, "category": _TEXT, "description": _TEXT,
    "timeout_s": _INT, "editable_files": _TEXTS, "limits": LIMITS, "required_checks": _TEXTS,
    "checks": ArrayType(CHECK_SPEC),
})

FILE = _fields({
    "tree_id": _TEXT, "path": _TEXT, "kind": _TEXT, "sha256": _TEXT, "size": _LONG,
    "executable": _FLAG, "content": BinaryType(),
})
