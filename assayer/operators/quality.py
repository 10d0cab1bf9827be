"""Data-quality rules over manifests, archives and run tables.

A rule is a column that is null when the row is fine and says what is wrong
otherwise. All rules of one table are evaluated in one pass and every finding
is reported; the first one per row is a partial minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.paths import basename, name_globs_to_regex, stem, unsafe_glob_reason, unsafe_reason
from assayer.schemas import CATEGORIES, CHECK_SPEC, CHECK_TYPES, ENV_MODES, ERROR_KINDS, LIMITS, SANDBOXES, SYMBOL_KINDS, TASK

# Name patterns, length and number bounds, archive entry kinds.
ID_PATTERN = r"^[a-z0-9][a-z0-9-]{2,79}\z"
VERSION_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+\z"
CHECK_NAME_PATTERN = r"^[a-z][a-z0-9_]{2,79}\z"
MODULE_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\z"
SHA_PATTERN = r"^[0-9a-f]{40}\z"
DESCRIPTION_LENGTH = (20, 500)
MAX_CHECKS = 20
TASK_BOUNDS = {"timeout_s": (10, 3600)}
LIMIT_BOUNDS = {"cpu_s": (1, 3600), "mem_mb": (128, 65536), "nproc": (16, 4096), "fsize_mb": (16, 8192)}
CHECK_BOUNDS = {
    "check_timeout_s": (1, 1800), "allow": (0, 100000), "threshold": (1, 100000), "max_files_changed": (0, 100),
}
LINK_MODES = (0o120000, 0o10000)
FORMAT_BITS = 0o170000
PASS_SCORE = 0.99


def validate(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule_id, message) for every rule that finds something."""
    found = F.array(*[F.struct(F.lit(rule).alias("rule_id"), text.alias("message")) for rule, text in rules.items()])
    return df.select(*key, F.inline(F.filter(found, lambda f: f["message"].isNotNull())))


def first_error(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only the first finding per key, by rule and message."""
    return findings.groupBy(*key).agg(F.min(F.struct("rule_id", "message")).alias("first")).select(*key, "first.*")


def _each(items: Column, problem: Callable[[Column], Column]) -> Column:
    """First problem among the items of an array, null when there is none."""
    found = F.filter(F.transform(items, lambda item: problem(item)), lambda message: message.isNotNull())
    return F.try_element_at(found, F.lit(1))


def _each_check(problem: Callable[[Column], Column]) -> Column:
    return _each(F.col("checks"), problem)


def _check_bound(name: str, bounds: tuple) -> Column:
    return _each_check(lambda check: _outside(check[name], bounds, name))


def _outside(value: Column, bounds: tuple, label: str) -> Column:
    return F.when(~value.between(*bounds), F.concat(F.lit(f"{label} out of range: "), value.cast("string")))


def _unknown_fields(raw: Column) -> Column:
    """Names a manifest, its limits or one of its checks should not have."""
    parts = F.from_json(raw, "struct<limits:map<string,string>,checks:array<map<string,string>>>")

    def extra(names: Column, schema) -> Column:
        return F.array_except(names, F.array(*[F.lit(f) for f in schema.fieldNames()]))

    none = F.array().cast("array<string>")
    check_keys = F.flatten(F.transform(parts["checks"], F.map_keys))
    unknown = F.concat(
        F.coalesce(extra(F.json_object_keys(raw), TASK), none),
        F.coalesce(extra(F.map_keys(parts["limits"]), LIMITS), none),
        F.coalesce(extra(check_keys, CHECK_SPEC), none),
    )
    return F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(F.array_sort(F.array_distinct(unknown)), ", ")))


def _check_arguments(check: Column) -> Column:
    """What a check of its type needs but does not have."""
    kind = check["type"]
    needs = {
        "ast_defines": ("symbol", "kind", "in_file"), "ast_signature": ("symbol", "kind", "signature", "in_file"),
        "ast_no_import": ("module",), "content_present": ("path", "pattern"), "content_absent": ("path", "pattern"),
        "file_exists": ("path",), "file_absent": ("path",),
    }
    branches = [
        F.when((kind == name) & reduce(lambda a, b: a | b, [check[f].isNull() for f in fields]),
               F.concat(check["name"], F.lit(f": {name} needs {', '.join(fields)}")))
        for name, fields in needs.items()
    ]
    return F.coalesce(*branches)


def _bad_pattern(value: Column, pattern: str, label: str) -> Column:
    return F.when(~value.rlike(pattern), F.concat(F.lit(f"invalid {label}: "), value))


def manifest_rules(raw: Column | None = None) -> dict[str, Column]:
    """Row rules of a manifest table in the shape of ``schemas.TASK``.

    With ``raw``, the manifest as JSON text, unknown fields are found as well.
    """
    names = F.transform("checks", lambda c: c["name"])
    missing = F.array_except(F.col("required_checks"), names)

    def relative(path: Column) -> Column:
        return F.when(unsafe_reason(path).isNotNull(), F.concat(F.lit("unsafe path: "), path))

    def glob(text: Column) -> Column:
        return F.when(unsafe_glob_reason(text).isNotNull(), F.concat(F.lit("unsafe glob: "), text))

    rules = {
        "V02": F.coalesce(
            _bad_pattern(F.col("id"), ID_PATTERN, "id"),
            _bad_pattern(F.col("version"), VERSION_PATTERN, "version"),
            _each_check(lambda c: _bad_pattern(c["name"], CHECK_NAME_PATTERN, "check name")),
            _each_check(lambda c: _bad_pattern(c["module"], MODULE_PATTERN, "module")),
        ),
        "V03": F.coalesce(
            F.when(~F.coalesce(F.col("tier").between(1, 5), F.lit(False)), "unknown tier"),
            F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category"),
            _each_check(lambda c: F.when(~c["type"].isin(*CHECK_TYPES), F.concat(F.lit("unknown check type: "), c["type"]))),
            _each_check(lambda c: F.when(~c["kind"].isin(*SYMBOL_KINDS), F.concat(F.lit("unknown symbol kind: "), c["kind"]))),
        ),
        "V04": F.when(
            ~F.coalesce(F.length("description").between(*DESCRIPTION_LENGTH), F.lit(False)), "description length out of range"
        ),
        "V05": F.coalesce(
            *[_outside(F.col(name), bounds, name) for name, bounds in TASK_BOUNDS.items()],
            *[_outside(F.col(f"limits.{name}"), bounds, name) for name, bounds in LIMIT_BOUNDS.items()],
            *[_check_bound(name, bounds) for name, bounds in CHECK_BOUNDS.items()],
            _each_check(lambda c: F.when(~((c["weight"] > 0) & (c["weight"] <= 100)), F.lit("weight out of range"))),
        ),
        "V06": F.coalesce(
            F.when(~F.coalesce(F.size("checks").between(1, MAX_CHECKS), F.lit(False)), "number of checks out of range"),
            F.when(F.coalesce(F.size("required_checks"), F.lit(0)) < 1, "no required check"),
        ),
        "V07": F.when(F.size(F.array_distinct(names)) < F.size(names), "check names must be unique"),
        "V08": F.when(
            F.size(missing) > 0, F.concat(F.lit("required checks are missing: "), F.array_join(F.array_sort(missing), ", "))
        ),
        "V09": F.coalesce(
            _each(F.col("editable_files"), relative),
            _each_check(lambda c: F.coalesce(relative(c["in_file"]), relative(c["path"]))),
            _each(F.flatten(F.transform("checks", lambda c: F.coalesce(c["inject"], F.array().cast("array<string>")))), relative),
        ),
        "V10": _each(
            F.flatten(
                F.transform(
                    "checks",
                    lambda c: F.concat(
                        F.coalesce(c["forbid_changes"], F.array().cast("array<string>")),
                        F.coalesce(c["forbid_in_globs"], F.array().cast("array<string>")),
                    ),
                )
            ),
            glob,
        ),
        "V11": _each_check(_check_arguments),
    }
    return rules if raw is None else {"V01": _unknown_fields(raw), **rules}


def hidden_name_findings(hidden: DataFrame, prefix: str) -> DataFrame:
    """V12: hidden files whose name lacks the prefix."""
    text = F.when(~basename(F.col("path")).startswith(prefix), F.concat(F.lit("hidden file prefix missing: "), basename(F.col("path"))))
    return validate(hidden, ["task_id"], {"V12": text})


def leaked_terms(prompts: DataFrame, hidden: DataFrame, prefix: str) -> DataFrame:
    """V13: prompts that mention hidden material by name.

    Two fixed terms are tested in place; the stems of a task's hidden files
    come as one list, so a prompt is never copied for them.
    """
    prompt = F.lower("prompt")

    def message(term: Column) -> Column:
        return F.when(F.contains(prompt, F.lower(term)), F.concat(F.lit("prompt mentions forbidden term: "), term))

    fixed_terms = validate(prompts, ["task_id"], {"V13": F.coalesce(message(F.lit("hidden")), message(F.lit(prefix)))})
    stems = hidden.groupBy("task_id").agg(F.collect_set(stem(F.col("path"))).alias("__terms"))
    said = prompts.join(stems, "task_id").select(
        "task_id", F.explode(F.filter("__terms", lambda term: F.contains(prompt, F.lower(term)))).alias("__term")
    )
    by_stem = validate(said, ["task_id"], {"V13": F.concat(F.lit("prompt mentions forbidden term: "), "__term")})
    return fixed_terms.unionByName(by_stem).distinct()


def member_problem(name: Column, mode: Column) -> Column:
    """Why an archive member is unsafe; ``mode`` are the Unix mode bits."""
    parts = F.filter(F.split(name, "/"), lambda part: ~part.isin("", "."))
    return (
        F.when(name.contains("\\"), "backslash")
        .when(name.startswith("/"), "absolute")
        .when(F.array_contains(parts, ".."), "escapes")
        .when(mode.bitwiseAND(FORMAT_BITS).isin(*LINK_MODES), "link")
        .when(F.size(parts) == 0, "empty")
    )


def member_findings(members: DataFrame) -> DataFrame:
    """V14: unsafe archive members."""
    text = F.concat(F.lit("zip entry "), member_problem(F.col("path"), F.col("mode")), F.lit(": "), F.col("path"))
    return validate(members, ["task_id"], {"V14": text})


def missing_file_findings(tasks: DataFrame, members: DataFrame, hidden: DataFrame) -> DataFrame:
    """V15: editable files absent from the archive, injected files that do not exist."""
    editable = tasks.select("task_id", F.explode("editable_files").alias("path")).join(
        members.select("task_id", "path"), ["task_id", "path"], "left_anti"
    )
    asked = F.flatten(F.transform("checks", lambda c: F.coalesce(c["inject"], F.array().cast("array<string>"))))
    injected = tasks.select("task_id", F.explode(asked).alias("path")).join(
        hidden.select("task_id", "path"), ["task_id", "path"], "left_anti"
    )
    def finding(df: DataFrame, text: str) -> DataFrame:
        return df.select("task_id", F.lit("V15").alias("rule_id"), F.concat(F.lit(text), "path").alias("message"))

    return finding(editable, "editable file is absent: ").unionByName(finding(injected, "inject file is missing: "))


def duplicate_ids(manifests: DataFrame, id_column: str = "id") -> DataFrame:
    """V16: ids used by more than one manifest."""
    counted = manifests.groupBy(id_column).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    return counted.select(
        id_column, F.lit("V16").alias("rule_id"), F.concat(F.lit("duplicate id used by "), "uses", F.lit(" manifests")).alias("message")
    )


def glob_conflicts(tasks: DataFrame) -> DataFrame:
    """V17: editable files that a check of the same task forbids to change."""
    rules = tasks.select("task_id", "editable_files", F.explode("checks").alias("check")).filter(
        F.size("check.forbid_changes") > 0
    ).withColumn("__regex", name_globs_to_regex("check.forbid_changes"))
    hit = F.filter("editable_files", lambda path: F.rlike(path, F.col("__regex")))
    return rules.select("task_id", F.explode(hit).alias("path")).distinct().select(
        "task_id", F.lit("V17").alias("rule_id"),
        F.concat(F.lit("forbidden change conflicts with editable file: "), "path").alias("message"),
    )


def missing_parts(parts: DataFrame, required: Sequence[str]) -> DataFrame:
    """V18: required parts a task does not have; ``parts`` holds one flag column per part."""
    gone = [F.when(~F.coalesce(F.col(name), F.lit(False)), F.lit(name)) for name in required]
    names = F.array_join(F.filter(F.array(*gone), lambda n: n.isNotNull()), ", ")
    return validate(parts, ["task_id"], {"V18": F.when(names != "", F.concat(F.lit("required part is missing: "), names))})


def gate_verdicts(scores: DataFrame, checks: DataFrame) -> DataFrame:
    """V19: the base state must fail and the reference solution pass, twice alike.

    ``scores(task_id, variant, passed, score)`` for the variants ``base``,
    ``oracle`` and ``oracle2``; ``checks(task_id, variant, name, error_kind)``.
    """
    def of(variant: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    wide = scores.groupBy("task_id").agg(
        of("base", "passed").alias("base_passed"),
        of("oracle", "passed").alias("oracle_passed"), of("oracle", "score").alias("oracle_score"),
        of("oracle2", "passed").alias("again_passed"), of("oracle2", "score").alias("again_score"),
    )
    unexpected = checks.filter((F.col("variant") == "oracle") & ~F.col("error_kind").isin("none", "check_failed"))
    odd = unexpected.groupBy("task_id").agg(F.count(F.lit(1)).alias("unexpected_checks"))
    judged = wide.join(odd, "task_id", "left").withColumn("unexpected_checks", F.coalesce("unexpected_checks", F.lit(0)))
    errors = F.array(
        F.when(F.col("base_passed"), "base state passes all required checks"),
        F.when(~F.col("oracle_passed") | (F.col("oracle_score") < PASS_SCORE), "oracle does not pass all checks with score >= 0.99"),
        F.when(
            ~F.col("oracle_passed").eqNullSafe(F.col("again_passed")) | ~F.col("oracle_score").eqNullSafe(F.col("again_score")),
            "oracle checks are not deterministic",
        ),
        F.when(F.col("unexpected_checks") > 0, "checks returned unexpected error kinds"),
    )
    errors = F.filter(errors, lambda e: e.isNotNull())
    return judged.select(
        "task_id", (F.size(errors) == 0).alias("valid"), "base_passed", "oracle_passed", "oracle_score",
        "unexpected_checks", errors.alias("errors"),
    )


def run_rules() -> dict[str, Column]:
    """V20: bounds of run rows."""
    negative = [
        F.when(F.col(name) < 0, F.lit(f"{name} is negative"))
        for name in ("repeat", "seed", "duration_s", "cost_usd", "tokens_in", "tokens_out")
    ]
    return {
        "V20": F.coalesce(
            F.when(~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)), "score out of range"),
            *negative,
            F.when(~F.coalesce(F.col("error_kind").isin(*ERROR_KINDS), F.lit(False)), "unknown error kind"),
        )
    }


def suite_rules() -> dict[str, Column]:
    """V20: identity of a suite."""
    return {
        "V20": F.coalesce(
            _bad_pattern(F.col("version"), VERSION_PATTERN, "version"),
            _bad_pattern(F.col("corpus_git_sha"), SHA_PATTERN, "corpus sha"),
            F.when(~F.col("corpus_ref_kind").isin("git", "unknown"), "unknown corpus ref kind"),
        )
    }


# The settings' bounds.
SETTING_BOUNDS = {
    "base_seed": (0, None), "parallel": (1, 128), "default_repeats": (1, 100), "inline_diff_max_bytes": (0, 1048576),
}
PROVIDER_PARALLEL = (1, 100)


def settings_rules() -> dict[str, Column]:
    """V21: settings rows with the columns of ``SETTING_BOUNDS``, ``sandbox``, ``agent_env`` and ``providers(name, max_parallel)``."""
    def bound(name: str, low: int, high: int | None) -> Column:
        value = F.col(name)
        return F.when(value.isNull() | (value < low) | (F.lit(False) if high is None else value > high), F.lit(f"{name} out of range"))

    def provider(item: Column) -> Column:
        return F.when(~item["max_parallel"].between(*PROVIDER_PARALLEL), F.concat(F.lit("max_parallel out of range: "), item["name"]))

    known = {"sandbox": SANDBOXES, "agent_env": ENV_MODES}
    return {
        "V21": F.coalesce(
            *[bound(name, *bounds) for name, bounds in SETTING_BOUNDS.items()],
            *[F.when(~F.coalesce(F.col(name).isin(*kinds), F.lit(False)), F.lit(f"unknown {name}")) for name, kinds in known.items()],
            _each(F.col("providers"), provider),
        )
    }


def check_settings(parallel: int = 4, repeats: int = 1, inline_diff_max_bytes: int = 65536) -> None:
    """V21: bounds of the parameters callers pass."""
    for name, value, low, high in (
        ("parallel", parallel, 1, 128), ("repeats", repeats, 1, 100),
        ("inline_diff_max_bytes", inline_diff_max_bytes, 0, 1048576),
    ):
        if not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")
