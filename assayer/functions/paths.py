"""Path predicates, path normalising and the two glob dialects."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names that results must agree on.
EXCLUDED_DIRS = (".git", ".hypothesis", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__")
TEST_CONFIG_NAMES = ("conftest.py", "pytest.ini", "pyproject.toml")


def basename(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Last segment without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(basename(path), r"(?s)(?<=.)\.[^.]+\z", "")


def has_excluded_segment(path: Column, excluded: Iterable[str] = EXCLUDED_DIRS) -> Column:
    """True when any segment of the path is an excluded directory name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(name) for name in excluded]))


def is_visible_test(path: Column) -> Column:
    """True for paths that count as visible tests or test configuration."""
    name = basename(path)
    return (
        path.startswith("tests/")
        | name.startswith("test_")
        | name.endswith("_test.py")
        | name.isin(*TEST_CONFIG_NAMES)
    )


def is_core_dump(path: Column) -> Column:
    """True for ``core``, ``core.*`` and ``*.core``."""
    name = basename(path)
    return (name == "core") | name.startswith("core.") | name.endswith(".core")


def is_python_source(path: Column, kind: Column) -> Column:
    """``*.py``, outside excluded directories, not a link."""
    return path.endswith(".py") & ~has_excluded_segment(path) & (kind != "symlink")


def unsafe_reason(path: Column) -> Column:
    """Why a relative POSIX path is unsafe, null when it is fine."""
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    return (
        F.when(path.startswith("/"), "absolute")
        .when(F.array_contains(parts, ".."), "parent segment")
        .when(path.contains("\\"), "backslash")
        .when(F.size(parts) == 0, "empty")
    )


def unsafe_glob_reason(pattern: Column) -> Column:
    """Why a glob is unsafe, null when it is fine; an empty glob is fine."""
    return (
        F.when(pattern.startswith("/"), "absolute")
        .when(pattern.contains("\\"), "backslash")
        .when(F.array_contains(F.split(pattern, "/"), ".."), "parent segment")
    )


def normalize_path(path: Column) -> Column:
    """Absolute path without ``.`` and empty segments; ``..`` never leaves the root."""
    empty = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), stack)
            .when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
        )

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def inside_path(path: Column) -> Column:
    """A relative path in normal form; null when it is absolute or climbs out of its root."""
    empty = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(stack.isNull() | part.isin("", "."), stack)
            .when(part != "..", F.concat(stack, F.array(part)))
            .when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.size(stack) - 1))
        )

    resolved = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(~path.startswith("/"), resolved)


def stays_inside(root: Column, relative: Column) -> Column:
    """True when ``relative``, resolved below ``root``, does not leave ``root``."""
    base = normalize_path(root)
    target = F.when(relative.startswith("/"), normalize_path(relative)).otherwise(
        normalize_path(F.concat_ws("/", base, relative))
    )
    prefix = F.when(base == "/", base).otherwise(F.concat(base, F.lit("/")))
    return (target == base) | F.startswith(target, prefix)


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, shortest first; '' is the root."""
    parts = F.split(path, "/")
    return F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    )


def module_and_parents(module: Column) -> Column:
    """A dotted module name and every package above it."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def glob_head(pattern: Column) -> Column:
    """Directory that everything a glob matches lies below: what it names before its first wildcard; '' is the root."""
    return F.regexp_extract(F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0), r"(?s)^(.*)/", 1)


def tree_glob_normal(pattern: Column) -> Column:
    """A tree glob without the empty and ``.`` segments that its matching ignores."""
    return F.array_join(F.filter(F.split(pattern, "/"), lambda part: ~part.isin("", ".")), "/")


def name_glob_regex(pattern: str) -> str:
    """Java regex of a glob whose ``*`` also crosses ``/`` (shell name matching)."""
    return r"\A" + re.sub(r"\\Z\Z", r"\\z", fnmatch.translate(pattern))


def _segment_regex(segment: str) -> str:
    pieces = re.findall(r"\[!?\]?[^\]]*\]|.", segment, flags=re.DOTALL)
    out = []
    for piece in pieces:
        if piece == "*":
            out.append("[^/]*")
        elif piece == "?":
            out.append("[^/]")
        elif len(piece) > 2:
            body = piece[1:-1]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[1:] if negated else body)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
        else:
            out.append(re.escape(piece))
    return "".join(out)


def tree_glob_regex(pattern: str) -> str:
    """Java regex of a glob over a tree: ``*`` stays in its segment, ``**`` spans any number."""
    segments = [part for part in pattern.split("/") if part not in ("", ".")]
    out = ""
    for index, segment in enumerate(segments):
        last = index == len(segments) - 1
        if segment == "**":
            out += ".+" if last else "(?:[^/]+/)*"
        else:
            out += _segment_regex(segment) + ("" if last else "/")
    return rf"(?s)\A{out}\z"


def any_of_regex(regexes: Iterable[str]) -> str:
    """One regex that matches when any of the given ones does; none matches nothing."""
    return "|".join(f"(?:{regex})" for regex in regexes) or r"(?!)"


def matches_name_globs(path: Column, patterns: Iterable[str]) -> Column:
    """Shell name matching of a path against a caller's globs, as one regex."""
    return path.rlike(any_of_regex(name_glob_regex(p) for p in patterns))


@F.pandas_udf(StringType())
def name_globs_to_regex(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Glob arrays of a rules table -> one regex per row (the rules side only, never the data)."""
    for batch in patterns:
        yield batch.map(lambda globs: any_of_regex(map(name_glob_regex, globs if globs is not None else ())))


@F.pandas_udf(StringType())
def tree_globs_to_regex(patterns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Like :func:`name_globs_to_regex` for tree globs."""
    for batch in patterns:
        yield batch.map(lambda globs: any_of_regex(map(tree_glob_regex, globs if globs is not None else ())))
