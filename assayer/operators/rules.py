"""Checks over file trees as joins: specifications on one side, evidence on the other.

Every check function takes ``specs`` (one row per tree and check) and
:class:`Evidence` and returns rows of one shared shape. Lists of findings stay
in long form (:func:`check_violations`); a result row carries their number, so
no row grows with the size of a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.metrics import clamp01
from assayer.functions.paths import (
    TEST_CONFIG_NAMES,
    ancestors,
    basename,
    glob_head,
    has_excluded_segment,
    inside_path,
    is_python_source,
    module_and_parents,
    name_globs_to_regex,
    tree_glob_normal,
    tree_globs_to_regex,
)
from assayer.operators.source_code import symbols
from assayer.operators.tool_output import junit_totals, mypy_outcome, pytest_outcome, ruff_outcome
from assayer.session import by_shuffle

# Text that weakens a test configuration.
SABOTAGE_PATTERNS = ("addopts", "--ignore", "python_files =", "testpaths =", "filterwarnings")

HEAD = ("tree_id", "position", "name", "type", "required", "weight")


@dataclass(frozen=True)
class Evidence:
    """Tables the checks look at; a check only needs those of its own kind.

    ``files(tree_id, path, kind, content)`` current files, ``changes(tree_id,
    path, change)``, ``base_metrics`` / ``metrics(tree_id, path, test_functions,
    asserts)``, ``parsed`` facts of source files, ``outputs(tree_id, name,
    stdout, exit_code, timed_out, check_timed_out, junit)``. When several checks
    run together, store what they share first (``session.cut_lineage``): source
    facts cost a Python pass and the changes a full outer join.
    """

    files: DataFrame | None = None
    changes: DataFrame | None = None
    base_metrics: DataFrame | None = None
    metrics: DataFrame | None = None
    parsed: DataFrame | None = None
    outputs: DataFrame | None = None


def expand_specs(tasks: DataFrame, trees: DataFrame) -> DataFrame:
    """One row per (tree, check) in manifest order with the ``required`` flag.

    ``tasks(task_id, required_checks, checks)``, ``trees(tree_id, task_id)``.
    """
    per_task = tasks.select("task_id", "required_checks", F.posexplode("checks").alias("position", "check"))
    required = F.array_contains("required_checks", F.col("check.name"))
    specs = per_task.select("task_id", "position", required.alias("required"), "check.*")
    return trees.select("tree_id", "task_id").join(specs, "task_id")


def _result(
    df: DataFrame, passed: Column, score: Column, detail: Column,
    failed: Column | None = None, crashed: Column | None = None, timed_out: Column | None = None,
) -> DataFrame:
    """Shared output shape; a message in ``failed`` or ``crashed`` replaces the outcome."""
    none = F.lit(None).cast("string")
    failed, crashed = (none if m is None else m for m in (failed, crashed))
    late = F.lit(False) if timed_out is None else F.coalesce(timed_out, F.lit(False))
    kind = (
        F.when(late, "check_timeout").when(failed.isNotNull(), "check_failed")
        .when(crashed.isNotNull(), "check_crash").otherwise("none")
    )
    message = F.when(late, "check timed out").otherwise(
        F.coalesce(failed, F.concat(F.lit("check crashed: "), crashed))
    )
    ok = kind == "none"
    return df.select(
        *HEAD,
        (ok & F.coalesce(passed, F.lit(False))).alias("passed"),
        F.when(ok, F.coalesce(clamp01(score), F.lit(0.0))).otherwise(0.0).alias("score"),
        F.when(ok, detail).otherwise("{}").alias("detail"),
        kind.alias("error_kind"),
        message.alias("error_detail"),
    )


def _flag_result(df: DataFrame, passed: Column, detail: Column, **errors: Column) -> DataFrame:
    return _result(df, passed, passed.cast("double"), detail, **errors)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _path_problem(path: Column, resolved: Column) -> Column:
    """Why a manifest path cannot be used; ``resolved`` is its form in the file tables."""
    return F.when(path.isNull(), "check path is required").when(
        resolved.isNull(), F.concat(F.lit("path escapes workspace: "), path)
    )


def _look_up(specs: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of specs to the evidence they ask for; both have rows for every tree, so neither is broadcast."""
    return specs.join(by_shuffle(table), keys, "left")


def _with_counts(specs: DataFrame, violations: DataFrame) -> DataFrame:
    counts = violations.groupBy("tree_id", "position").agg(F.count(F.lit(1)).alias("found"))
    return specs.join(by_shuffle(counts), ["tree_id", "position"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def _reached(rows: DataFrame, rules: DataFrame, globs: Column, to_regex: Callable[[str], Column]) -> DataFrame:
    """Rules with the ``path`` of each row that one of their globs reaches, once per rule and path.

    A glob is keyed by the directory it names before its first wildcard, a path by
    the directories it lies in, so a rule on one directory never meets the rest of
    a tree. Of each rule's globs with one directory there is one regex.
    """
    keyed = rules.select("tree_id", "position", F.explode(globs).alias("__glob")).withColumn("__head", glob_head(F.col("__glob")))
    heads = keyed.groupBy("tree_id", "position", "__head").agg(F.collect_list("__glob").alias("__globs")).select(
        "tree_id", "position", "__head", to_regex("__globs").alias("__regex")
    )
    placed = rows.select("tree_id", "path", F.explode(ancestors(F.col("path"))).alias("__head"))
    hits = placed.join(by_shuffle(heads), ["tree_id", "__head"]).filter(F.rlike("path", F.col("__regex"))).select("tree_id", "position", "path").distinct()
    return hits.join(by_shuffle(rules), ["tree_id", "position"])


def _forbidden_changes(specs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed paths that a check forbids."""
    rules = specs.filter(F.size("forbid_changes") > 0).select(*HEAD, "forbid_changes")
    return _reached(changes, rules, F.col("forbid_changes"), name_globs_to_regex)


def integrity_violations(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Forbidden paths that were added, removed or modified."""
    hits = _forbidden_changes(specs, evidence.changes)
    return hits.select(*HEAD[:3], F.col("path").alias("violation"))


def diff_scope_violations(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Too many changed files, and each changed path that is out of scope."""
    counts = evidence.changes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("changed"))
    too_many = specs.join(by_shuffle(counts), "tree_id").filter(F.col("changed") > F.col("max_files_changed")).select(
        *HEAD[:3],
        F.concat(F.lit("changed file count "), F.col("changed"), F.lit(" exceeds "), F.col("max_files_changed")).alias("violation"),
    )
    hits = _forbidden_changes(specs, evidence.changes).select(
        *HEAD[:3], F.concat(F.lit("forbidden path changed: "), F.col("path")).alias("violation")
    )
    return too_many.unionByName(hits)


def weakened_tests(base: DataFrame, current: DataFrame) -> DataFrame:
    """Visible tests that disappeared or lost test functions or asserts."""
    now = current.select(
        "tree_id", "path", F.col("test_functions").alias("now_tests"), F.col("asserts").alias("now_asserts")
    )
    paired = base.join(by_shuffle(now), ["tree_id", "path"], "left")
    gone = F.col("now_tests").isNull()
    messages = F.array(
        F.when(gone, "visible test removed: "),
        F.when(~gone & (F.col("now_tests") < F.col("test_functions")), "test function count decreased: "),
        F.when(~gone & (F.col("now_asserts") < F.col("asserts")), "assert count decreased: "),
    )
    found = F.explode(F.filter(messages, lambda m: m.isNotNull()))
    return paired.select("tree_id", "path", found.alias("message")).select(
        "tree_id", F.concat("message", "path").alias("violation")
    )


def suspicious_configs(files: DataFrame, base_files: DataFrame | None = None, limit_bytes: int | None = None) -> DataFrame:
    """Test configuration that is unsafe, unreadable or holds a weakening pattern.

    Structural problems end the look at a file. With ``base_files`` only
    patterns that the base version of the file did not have are reported. A
    file above ``limit_bytes``, if set, is itself a finding and is not searched.
    """
    def findings(table: DataFrame) -> DataFrame:
        size, raw = F.octet_length("content"), F.col("content").cast("string")
        structural = (
            F.when(F.col("kind") != "file", "unsafe test config path")
            .when(F.lit(False) if limit_bytes is None else size > limit_bytes, "test config is too large")
            .when(~F.is_valid_utf8(raw), "cannot read test config")
        )
        text = F.lower(F.when(structural.isNull(), raw))
        patterns = F.array(
            *[F.when(text.contains(p), F.lit(f"suspicious test config pattern {p}")) for p in SABOTAGE_PATTERNS]
        )
        messages = F.when(structural.isNotNull(), F.array(structural)).otherwise(
            F.filter(patterns, lambda p: p.isNotNull())
        )
        configs = table.filter(basename(F.col("path")).isin(*TEST_CONFIG_NAMES))
        return configs.select("tree_id", "path", F.explode(messages).alias("message"))

    found = findings(files)
    if base_files is not None:
        known = findings(base_files).filter(F.col("message").startswith("suspicious"))
        found = found.join(by_shuffle(known), ["tree_id", "path", "message"], "left_anti")
    return found.select("tree_id", F.concat("message", F.lit(": "), "path").alias("violation"))


def no_test_tamper_violations(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Weakened tests and suspicious test configuration of each tree."""
    found = weakened_tests(evidence.base_metrics, evidence.metrics).unionByName(suspicious_configs(evidence.files))
    return found.join(by_shuffle(specs.select(*HEAD[:3])), "tree_id").select(*HEAD[:3], "violation")


def _parse_state(specs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Specs with ``in_path`` and whether that file parsed."""
    state = parsed.select("tree_id", F.col("path").alias("in_path"), F.col("parsed").alias("in_parsed"))
    return _look_up(specs.withColumn("in_path", inside_path(F.col("in_file"))), state, ["tree_id", "in_path"])


def _unparsed(path: Column, parsed: Column) -> Column:
    return F.when(~F.coalesce(parsed, F.lit(False)), F.concat(F.lit("cannot parse Python file: "), path))


def _glob_candidates(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Files other than ``in_file`` that a check's forbidden globs reach."""
    rules = specs.filter(F.size("forbid_in_globs") > 0).select(
        "tree_id", "position", "name", "symbol", F.col("kind").alias("symbol_kind"),
        inside_path(F.col("in_file")).alias("in_path"), F.transform("forbid_in_globs", tree_glob_normal).alias("globs"),
    )
    plain = evidence.files.filter((F.col("kind") == "file") & ~has_excluded_segment(F.col("path"))).select("tree_id", "path")
    return _reached(plain, rules, F.col("globs"), tree_globs_to_regex).filter(~F.col("path").eqNullSafe(F.col("in_path")))


def ast_defines_violations(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Files in forbidden places that define the symbol too."""
    defined = symbols(evidence.parsed).withColumnsRenamed({"kind": "symbol_kind", "name": "symbol"})
    hits = _glob_candidates(specs, evidence).join(
        by_shuffle(defined), ["tree_id", "path", "symbol", "symbol_kind"], "left_semi"
    )
    return hits.select(*HEAD[:3], F.col("path").alias("violation"))


def _definitions(parsed: DataFrame) -> DataFrame:
    return symbols(parsed).select(
        "tree_id", F.col("path").alias("in_path"), "kind", F.col("name").alias("symbol"), F.col("signature").alias("actual")
    )


def ast_defines(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The symbol is defined in the expected file and in no forbidden one."""
    here = _definitions(evidence.parsed).withColumn("defined", F.lit(True)).drop("actual")
    states = evidence.parsed.select("tree_id", "path", "parsed")
    broken = (
        _glob_candidates(specs, evidence).join(by_shuffle(states), ["tree_id", "path"], "left")
        .filter(~F.coalesce("parsed", F.lit(False)))
        .groupBy("tree_id", "position").agg(F.min("path").alias("broken_path"))
    )
    judged = _with_counts(_parse_state(specs, evidence.parsed), ast_defines_violations(specs, evidence))
    judged = _look_up(judged, here, ["tree_id", "in_path", "kind", "symbol"]).join(
        by_shuffle(broken), ["tree_id", "position"], "left"
    )
    problem = F.coalesce(
        F.when(F.col("symbol").isNull() | F.col("kind").isNull(), "symbol and kind are required"),
        _path_problem(F.col("in_file"), F.col("in_path")),
        _unparsed(F.col("in_file"), F.col("in_parsed")),
        F.concat(F.lit("cannot parse Python file: "), F.col("broken_path")),
    )
    passed = F.coalesce("defined", F.lit(False)) & (F.col("found") == 0)
    return _flag_result(judged, passed, _json(forbidden_hits=F.col("found")), failed=problem)


def ast_signature(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The first definition of the symbol has exactly the expected signature."""
    judged = _look_up(
        _parse_state(specs, evidence.parsed), _definitions(evidence.parsed), ["tree_id", "in_path", "kind", "symbol"]
    )
    problem = F.coalesce(
        F.when(
            F.col("symbol").isNull() | F.col("kind").isNull() | F.col("signature").isNull(),
            "symbol, kind and signature are required",
        ),
        _path_problem(F.col("in_file"), F.col("in_path")),
        _unparsed(F.col("in_file"), F.col("in_parsed")),
    )
    detail = F.when(F.col("actual").isNull(), _json(found=F.lit(False))).otherwise(_json(actual=F.col("actual")))
    return _flag_result(judged, F.col("actual") == F.col("signature"), detail, failed=problem)


def import_violates(module: Column, name: Column, forbidden: Column, names: Column) -> Column:
    """Whether an import breaks a rule on a module, optionally limited to some names."""
    below = F.startswith(module, F.concat(forbidden, F.lit(".")))
    first_below = F.substring_index(F.substr(module, F.length(forbidden) + 2), ".", 1)
    return (
        F.when(F.size(names) <= 0, (module == forbidden) | below)
        .when(name.isNotNull(), (module == forbidden) & F.array_contains(names, name))
        .otherwise(below & F.array_contains(names, first_below))
    )


def _import_scope(specs: DataFrame, evidence: Evidence) -> tuple[DataFrame, DataFrame]:
    """Checks limited to one file, and checks over every source file of the tree."""
    wanted = specs.filter(F.col("module").isNotNull()).select(
        *HEAD[:3], "module", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "in_file"
    )
    return wanted.filter("in_file is not null"), wanted.filter("in_file is null")


def ast_no_import_violations(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Each forbidden import as ``path:module`` or ``path:module.name``."""
    one, all_files = _import_scope(specs, evidence)
    # a rule on a module is met by the module and those below it, so imports are keyed by their module and its parents
    imports = evidence.parsed.select("tree_id", "path", F.inline("imports").alias("ord", "imported", "imported_name"))
    found = imports.withColumn("module", F.explode(module_and_parents(F.col("imported"))))
    rule = import_violates(F.col("imported"), F.col("imported_name"), F.col("module"), F.col("names"))
    text = F.concat(
        "path", F.lit(":"), "imported",
        F.when(F.col("imported_name").isNotNull(), F.concat(F.lit("."), F.col("imported_name"))).otherwise(""),
    )
    sources = evidence.files.filter(is_python_source(F.col("path"), F.col("kind"))).select("tree_id", "path")
    in_one = found.join(by_shuffle(one.withColumn("path", inside_path(F.col("in_file")))), ["tree_id", "path", "module"])
    in_all = found.join(by_shuffle(all_files), ["tree_id", "module"]).join(by_shuffle(sources), ["tree_id", "path"], "left_semi")
    return in_one.unionByName(in_all, allowMissingColumns=True).filter(rule).select(
        *HEAD[:3], text.alias("violation")
    )


def ast_no_import(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """No forbidden import in the given file, or in any source file of the tree."""
    states = evidence.parsed.select("tree_id", "path", "parsed")
    sources = evidence.files.filter(is_python_source(F.col("path"), F.col("kind"))).select("tree_id", "path")
    broken = (
        sources.join(by_shuffle(states), ["tree_id", "path"], "left").filter(~F.coalesce("parsed", F.lit(False)))
        .groupBy("tree_id").agg(F.min("path").alias("broken_path"))
    )
    judged = _with_counts(_parse_state(specs, evidence.parsed), ast_no_import_violations(specs, evidence))
    judged = judged.join(by_shuffle(broken), "tree_id", "left")
    problem = F.coalesce(
        F.when(F.col("module").isNull(), "module is required"),
        F.when(F.col("in_file").isNotNull(), F.coalesce(_path_problem(F.col("in_file"), F.col("in_path")), _unparsed(F.col("in_file"), F.col("in_parsed"))))
        .otherwise(F.concat(F.lit("cannot parse Python file: "), F.col("broken_path"))),
    )
    return _flag_result(judged, F.col("found") == 0, _json(violations=F.col("found")), failed=problem)


def _content(specs: DataFrame, evidence: Evidence, wanted: bool) -> DataFrame:
    files = evidence.files.select("tree_id", F.col("path").alias("__path"), F.col("content").alias("__content"))
    judged = _look_up(specs.withColumn("__path", inside_path(F.col("path"))), files, ["tree_id", "__path"])
    text = F.col("__content").cast("string")
    problem = F.coalesce(
        _path_problem(F.col("path"), F.col("__path")),
        F.when(F.col("pattern").isNull(), "pattern is required"),
        F.when(~F.is_valid_utf8(text), F.concat(F.lit("cannot decode file as UTF-8: "), F.col("path"))),
    )
    crash = F.when(problem.isNull() & F.col("__content").isNull(), F.concat(F.lit("no such file: "), F.col("path")))
    present = F.contains(text, F.col("pattern"))
    return _flag_result(
        judged, present if wanted else ~present, _json(path=basename(F.col("path"))), failed=problem, crashed=crash
    )


def content_present(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The file contains the literal pattern."""
    return _content(specs, evidence, wanted=True)


def content_absent(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The file does not contain the literal pattern."""
    return _content(specs, evidence, wanted=False)


def _existence(specs: DataFrame, evidence: Evidence, wanted: bool) -> DataFrame:
    """A path exists as a file, or as a directory above one."""
    asked = specs.withColumn("__path", inside_path(F.col("path")))
    there = evidence.files.select("tree_id", F.explode(ancestors(F.col("path"))).alias("__path"))
    found = there.join(by_shuffle(asked.select("tree_id", "__path")), ["tree_id", "__path"], "left_semi").distinct()
    judged = asked.join(by_shuffle(found.withColumn("__there", F.lit(True))), ["tree_id", "__path"], "left")
    exists = F.coalesce("__there", F.lit(False))
    return _flag_result(
        judged, exists if wanted else ~exists, _json(path=F.coalesce("path", F.lit(""))),
        failed=_path_problem(F.col("path"), F.col("__path")),
    )


def file_exists(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The path exists in the tree."""
    return _existence(specs, evidence, wanted=True)


def file_absent(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """The path does not exist in the tree."""
    return _existence(specs, evidence, wanted=False)


def integrity(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """No forbidden path changed."""
    judged = _with_counts(specs, integrity_violations(specs, evidence))
    return _flag_result(judged, F.col("found") == 0, _json(forbidden_changed=F.col("found")))


def diff_scope(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Few enough changed files, none of them forbidden."""
    kinds = ("added", "removed", "modified")
    counts = evidence.changes.groupBy("tree_id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    judged = _with_counts(specs, diff_scope_violations(specs, evidence)).join(by_shuffle(counts), "tree_id", "left")
    detail = _json(**{k: F.coalesce(k, F.lit(0)) for k in kinds}, violations=F.col("found"))
    return _flag_result(judged, F.col("found") == 0, detail)


def no_test_tamper(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Visible tests and their configuration were not weakened."""
    judged = _with_counts(specs, no_test_tamper_violations(specs, evidence))
    return _flag_result(judged, F.col("found") == 0, _json(violations=F.col("found")))


def _outputs(specs: DataFrame, evidence: Evidence) -> DataFrame:
    return _look_up(specs, evidence.outputs, ["tree_id", "name"])


def ruff(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Linter findings within the allowance."""
    found = _outputs(specs, evidence).withColumn("o", ruff_outcome(*map(F.col, ("stdout", "exit_code", "timed_out", "allow", "threshold"))))
    problem = F.when(F.col("o.found").isNull(), "ruff did not return a JSON list")
    detail = _json(violations=F.col("o.found"), exit_code=F.col("exit_code"))
    return _result(found, F.col("o.passed"), F.col("o.score"), detail, failed=problem, timed_out=F.col("check_timed_out"))


def mypy(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Type checker finished without errors."""
    found = _outputs(specs, evidence).withColumn("o", mypy_outcome(*map(F.col, ("stdout", "exit_code", "timed_out", "threshold"))))
    detail = _json(errors=F.col("o.found"), exit_code=F.col("exit_code"))
    return _result(found, F.col("o.passed"), F.col("o.score"), detail, timed_out=F.col("check_timed_out"))


def pytest(specs: DataFrame, evidence: Evidence) -> DataFrame:
    """Every collected test passed."""
    totals = _outputs(specs, evidence).withColumn("t", junit_totals(F.col("junit")))
    found = totals.withColumn("o", pytest_outcome(F.col("t"), F.col("exit_code"), F.col("timed_out")))
    problem = F.coalesce(F.col("t.problem"), F.when(F.col("t.tests") == 0, "pytest collected zero tests"))
    detail = _json(
        total_tests=F.col("o.total"), passed_tests=F.col("o.passed_tests"), failures=F.col("t.failures"),
        errors=F.col("t.errors"), skipped=F.col("t.skipped"), exit_code=F.col("exit_code"),
    )
    return _result(found, F.col("o.passed"), F.col("o.score"), detail, failed=problem, timed_out=F.col("check_timed_out"))


Check = Callable[[DataFrame, Evidence], DataFrame]

REGISTRY: dict[str, Check] = {
    "ruff": ruff, "mypy": mypy, "pytest": pytest, "ast_defines": ast_defines, "ast_signature": ast_signature,
    "ast_no_import": ast_no_import, "content_present": content_present, "content_absent": content_absent,
    "file_exists": file_exists, "file_absent": file_absent, "diff_scope": diff_scope, "integrity": integrity,
    "no_test_tamper": no_test_tamper,
}

VIOLATIONS: dict[str, Check] = {
    "ast_defines": ast_defines_violations, "ast_no_import": ast_no_import_violations,
    "diff_scope": diff_scope_violations, "integrity": integrity_violations,
    "no_test_tamper": no_test_tamper_violations,
}


def run_checks(
    specs: DataFrame, evidence: Evidence, types: tuple[str, ...] | None = None, registry: Mapping[str, Check] = REGISTRY
) -> DataFrame:
    """Results of all checks; a type without an implementation fails.

    ``types`` limits the plan to the kinds that occur. A caller may register
    functions of its own for further types.
    """
    chosen = tuple(registry) if types is None else tuple(t for t in types if t in registry)
    results = [registry[t](specs.filter(F.col("type") == t), evidence) for t in chosen]
    unknown = specs.filter(~F.col("type").isin(*registry))
    results.append(
        _flag_result(unknown, F.lit(False), F.lit("{}"), failed=F.concat(F.lit("check type is not registered: "), F.col("type")))
    )
    return reduce(DataFrame.unionByName, results)


def check_violations(specs: DataFrame, evidence: Evidence, types: tuple[str, ...] | None = None) -> DataFrame:
    """Every single finding of the checks that list findings."""
    chosen = [t for t in VIOLATIONS if types is None or t in types]
    return reduce(
        DataFrame.unionByName, [VIOLATIONS[t](specs.filter(F.col("type") == t), evidence) for t in chosen]
    )


def protected_paths(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """Python files of a task's archive that are editable or that a glob protects.

    ``tasks(task_id, editable_files, checks)``, ``members(task_id, path)``.
    """
    python = members.filter(F.col("path").endswith(".py"))
    editable = tasks.select("task_id", F.explode("editable_files").alias("path")).distinct()
    globs = F.flatten(F.transform("checks", lambda c: F.coalesce(c["forbid_changes"], F.array().cast("array<string>"))))
    rules = tasks.select("task_id", globs.alias("globs")).filter(F.size("globs") > 0).select(
        "task_id", name_globs_to_regex("globs").alias("__regex")
    )
    by_glob = python.join(rules, "task_id").filter(F.rlike("path", F.col("__regex"))).select("task_id", "path")
    return python.join(editable, ["task_id", "path"], "left_semi").select("task_id", "path").union(by_glob).distinct()


def injected_files(hidden: DataFrame, specs: DataFrame, prefix: str) -> DataFrame:
    """Files a check lays over its tree, each with the reason it may not be used.

    ``hidden(task_id, path)`` are the files on offer, ``specs(task_id, name,
    inject)`` the requests; names must start with ``prefix``.
    """
    asked = specs.select("task_id", "name", F.explode("inject").alias("path"))
    offered = hidden.select("task_id", "path").withColumn("__there", F.lit(True))
    problem = F.when(~basename(F.col("path")).startswith(prefix), "hidden file prefix missing").when(
        F.col("__there").isNull(), "hidden inject file missing"
    )
    return asked.join(offered, ["task_id", "path"], "left").select("task_id", "name", "path", problem.alias("problem"))
