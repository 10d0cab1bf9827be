"""Facts about Python source files: symbols, imports and test counts.

Parsing needs Python workers. It happens once per file; every rule after it is
a join on the resulting tables.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.paths import is_visible_test
from assayer.session import by_shuffle, spread

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

FACTS = (
    "parsed boolean, test_functions int, asserts int, "
    "symbols array<struct<ord:int,kind:string,name:string,"
    "parameters:array<struct<mark:string,name:string,annotation:string,value:string>>,returns:string>>, "
    "imports array<struct<ord:int,module:string,name:string>>"
)


def _text(node: ast.expr | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _header(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[list[dict], str | None]:
    """A function's parameters in order, one row each, and its return annotation."""
    spec = node.args
    listed = [*spec.posonlyargs, *spec.args]
    values = {a.arg: d for a, d in [*zip(reversed(listed), reversed(spec.defaults)), *zip(spec.kwonlyargs, spec.kw_defaults)]}
    marked = [("", a) for a in listed] + [("*", spec.vararg)] + [("", a) for a in spec.kwonlyargs] + [("**", spec.kwarg)]
    rows = [
        {"mark": mark, "name": a.arg, "annotation": _text(a.annotation), "value": _text(values.get(a.arg))}
        for mark, a in marked if a is not None
    ]
    return rows, _text(node.returns)


def signature(parameters: Column, returns: Column) -> Column:
    """``(a: int, *rest, key = 1) -> int`` from parameter rows and a return annotation; null without rows."""
    shown = F.transform(
        parameters,
        lambda p: F.concat(
            p["mark"], p["name"], F.coalesce(F.concat(F.lit(": "), p["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["value"]), F.lit(""))
        ),
    )
    return F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))


def _facts(text: str | None) -> tuple:
    """(parsed, test functions, asserts, symbols, imports) of one source text."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, TypeError, RecursionError):
        return False, 0, 0, [], []
    found: dict[tuple[str, str], tuple] = {}

    def note(kind: str, node: ast.AST, header: tuple = (None, None)) -> None:
        found.setdefault((kind, node.name), (len(found), kind, node.name, *header))

    imports, tests, asserts = [], 0, 0
    for node in nodes:
        if isinstance(node, _FUNCTIONS):
            note("function", node, _header(node))
            tests += node.name.startswith("test_")
        elif isinstance(node, ast.ClassDef):
            note("class", node)
            for member in node.body:
                if isinstance(member, _FUNCTIONS):
                    note("method", member, _header(member))
        elif isinstance(node, ast.Assert):
            asserts += 1
        elif isinstance(node, ast.Import):
            imports += [(alias.name, None) for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [(node.module or "", alias.name) for alias in node.names]
    return True, tests, asserts, list(found.values()), [(i, *pair) for i, pair in enumerate(imports)]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["parsed", "test_functions", "asserts", "symbols", "imports"]
    names = {"symbols": ("ord", "kind", "name", "parameters", "returns"), "imports": ("ord", "module", "name")}
    for batch in batches:
        known = {text: _facts(text) for text in batch["text"].unique()}  # trees share most of their files
        facts = pd.DataFrame([known[text] for text in batch["text"]], columns=columns, index=batch.index)
        for column, keys in names.items():
            facts[column] = facts[column].map(lambda rows, keys=keys: [dict(zip(keys, row)) for row in rows])
        yield pd.concat([batch[["tree_id", "path"]], facts], axis=1)


def parse_sources(files: DataFrame) -> DataFrame:
    """One row of facts per (tree_id, path, text); text that does not parse is kept as such."""
    key = files.schema["tree_id"].dataType.simpleString()
    return spread(files.select("tree_id", "path", "text")).mapInPandas(_parse_batches, f"tree_id {key}, path string, {FACTS}")


def symbols(parsed: DataFrame) -> DataFrame:
    """First definition of each (kind, name) per file, numbered in walk order."""
    found = parsed.select("tree_id", "path", F.inline("symbols"))
    return found.select("tree_id", "path", "ord", "kind", "name", signature(F.col("parameters"), F.col("returns")).alias("signature"))


def imports(parsed: DataFrame) -> DataFrame:
    """Imported modules and names; ``import a.b`` has no name."""
    return parsed.select("tree_id", "path", F.inline("imports"))


def test_metrics(parsed: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Test functions and asserts of the visible Python tests and of the forced paths."""
    python = parsed.filter(F.col("path").endswith(".py"))
    wanted = is_visible_test(F.col("path"))
    if forced is not None:
        marked = forced.select("tree_id", "path").distinct().withColumn("__forced", F.lit(True))
        python = python.join(by_shuffle(marked), ["tree_id", "path"], "left")
        wanted = wanted | F.coalesce(F.col("__forced"), F.lit(False))
    return python.filter(wanted).select("tree_id", "path", "test_functions", "asserts")
