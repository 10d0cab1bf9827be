"""Counts from the captured output of linters, type checkers and test runners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.binding import let
from assayer.functions.metrics import threshold_score
from assayer.functions.text import lines_of, strip

_SUITE = "_tests:string,_failures:string,_errors:string,_skipped:string"
_JUNIT = f"{_SUITE.replace(':', ' ')}, testsuite array<struct<{_SUITE}>>, bad string"
_COUNTS = ("tests", "failures", "errors", "skipped")


def ruff_count(stdout: Column) -> Column:
    """Findings in a linter's JSON list; blank output is none, anything else is null."""
    return F.when(strip(stdout) == "", F.lit(0)).otherwise(F.json_array_length(stdout))


def mypy_count(stdout: Column) -> Column:
    """Errors a type checker reports: its summary, else the lines marked as errors."""
    stated = F.nullif(F.regexp_extract(stdout, r"Found\s+([0-9]+)\s+errors?", 1), F.lit(""))
    marked = F.size(F.filter(lines_of(stdout), lambda line: line.contains(": error:")))
    return (
        F.when(stated.isNotNull(), stated.try_cast("int"))
        .when(stdout.contains("Success: no issues found"), 0)
        .otherwise(marked)
    )


def junit_totals(xml: Column, limit_bytes: int | None = None) -> Column:
    """``struct(tests, failures, errors, skipped, problem)`` over the direct suites.

    A missing report counts as one error. ``problem`` says why a report cannot
    be used; its counts are then null. Reports of any size are read unless the
    caller sets ``limit_bytes``.
    """
    size_ok = F.lit(True) if limit_bytes is None else F.octet_length(xml) <= limit_bytes
    parsed = F.from_xml(F.when(size_ok, xml), _JUNIT, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    root = F.regexp_extract(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<([A-Za-z_][\w:.-]*)", 1)
    missing = [F.lit(1 if name == "errors" else 0).alias(name) for name in _COUNTS]
    found = let(F.struct(parsed.alias("doc"), root.alias("root")), lambda report: _totals(report, size_ok))
    return F.when(
        xml.isNull(), F.struct(*missing, F.lit(None).cast("string").alias("problem"))
    ).otherwise(found)


def _totals(report: Column, size_ok: Column) -> Column:
    doc, root = report["doc"], report["root"]
    own = F.array(F.struct(*[doc[f"_{name}"].alias(f"_{name}") for name in _COUNTS]))
    none = F.array().cast(f"array<struct<{_SUITE}>>")
    suites = F.when(root == "testsuite", own).otherwise(F.coalesce(doc["testsuite"], none))
    broken = F.when(~size_ok, "junit.xml exceeds size limit").when(
        doc["bad"].isNotNull() | (root == ""), "junit.xml is malformed"
    )

    def summed(rows: Column) -> Column:
        def total(name: str) -> Column:
            return F.aggregate(
                rows, F.lit(0), lambda acc, suite: acc + F.coalesce(suite[f"_{name}"].try_cast("int"), F.lit(0))
            )

        def unreadable(name: str) -> Column:
            return F.exists(rows, lambda s: s[f"_{name}"].isNotNull() & s[f"_{name}"].try_cast("int").isNull())

        odd = [F.when(unreadable(name), f"junit.xml contains non-integer {name}") for name in _COUNTS]
        return let(
            F.coalesce(broken, *odd),
            lambda problem: F.struct(
                *[F.when(problem.isNull(), total(name)).alias(name) for name in _COUNTS], problem.alias("problem")
            ),
        )

    return let(suites, summed)


def ruff_outcome(stdout: Column, exit_code: Column, timed_out: Column, allow: Column, threshold: Column) -> Column:
    """``struct(found, passed, score)`` of a linter run; passing and scoring use different limits."""
    ran = exit_code.isin(0, 1) & ~timed_out
    return let(
        ruff_count(stdout),
        lambda found: F.struct(
            found.alias("found"),
            (ran & (found <= allow)).alias("passed"),
            F.when(ran, threshold_score(found, threshold)).otherwise(F.lit(0.0)).alias("score"),
        ),
    )


def mypy_outcome(stdout: Column, exit_code: Column, timed_out: Column, threshold: Column) -> Column:
    """``struct(found, passed, score)`` of a type-checker run; it passes by its exit code."""
    return let(
        mypy_count(stdout),
        lambda found: F.struct(
            found.alias("found"),
            ((exit_code == 0) & ~timed_out).alias("passed"),
            threshold_score(found, threshold).alias("score"),
        ),
    )


def pytest_outcome(totals: Column, exit_code: Column, timed_out: Column) -> Column:
    """``struct(total, passed_tests, passed, score)``; no collected test is a failure."""
    return let(totals, lambda bound: _outcome(bound, exit_code, timed_out))


def _outcome(totals: Column, exit_code: Column, timed_out: Column) -> Column:
    total, failures, errors, skipped = (totals[name] for name in _COUNTS)
    good = F.greatest(F.lit(0), total - failures - errors - skipped)
    clean = (failures == 0) & (errors == 0) & (skipped == 0) & (exit_code == 0) & ~timed_out
    return F.struct(
        total.alias("total"),
        good.alias("passed_tests"),
        (clean & (total > 0)).alias("passed"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(good.cast("double"), total.cast("double"))).alias("score"),
    )
