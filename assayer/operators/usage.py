"""Cost and token usage of captured outputs, line by line.

A line is parsed once, to a VARIANT; what is read from it are plain typed projections, one per name a tool may
use. Outputs are cut into rows of lines, so none of the work is done inside a row's lambdas, and the sums per
output are partial before the small shuffle: all lines of an output are in one task, so one row of it leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import usage
from assayer.functions.text import LINE_BREAK, strip
from assayer.session import spread

FIELDS = {"cost_usd": "double", "tokens_in": "bigint", "tokens_out": "bigint"}


def with_line_usage(df: DataFrame, column: str) -> DataFrame:
    """Adds the usage that one JSON line states; every field is null for anything but an object."""
    payload, container = F.col("__payload"), F.col("__container")
    parsed = df.withColumn("__payload", F.when(F.ltrim(F.col(column)).startswith("{"), F.try_parse_json(F.col(column))))
    placed = parsed.withColumn("__container", usage.usage_container(payload))
    return placed.withColumns(
        {
            "cost_usd": F.coalesce(usage.number_member(payload), usage.number_member(container)),
            "tokens_in": usage.count_member(container, usage.TOKENS_IN_KEYS),
            "tokens_out": usage.count_member(container, usage.TOKENS_OUT_KEYS),
        }
    ).drop("__payload", "__container")


def _sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(name).cast(kind).alias(name) for name, kind in FIELDS.items()])


def json_usage(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, cost_usd, tokens_in, tokens_out): sums over the JSON lines of each output; a field no line states is null.

    ``keys`` name an output; rows that share them are one output. Outputs without usage stay, with nulls.
    """
    lines = spread(df.select(*keys, column)).select(*keys, F.explode_outer(F.split(F.col(column), LINE_BREAK)).alias("__line"))
    return _sums(with_line_usage(lines.withColumn("__line", strip(F.col("__line"))), "__line"), keys)


def session_usage(df: DataFrame, keys: Sequence[str], adapter: str = "adapter", stdout: str = "stdout", stderr: str = "stderr") -> DataFrame:
    """(keys, cost_usd, tokens_in, tokens_out) by the way each tool reports it; both captured streams are read."""
    text = F.concat_ws("\n", F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))
    formed = spread(df.select(*keys, usage.usage_format(F.col(adapter)).alias("__form"), text.alias("__text")))
    # prose is read whole, JSON a line at a time, and the rest not at all
    pieces = F.when(F.col("__form") == "json", F.split("__text", LINE_BREAK)).when(F.col("__form") == "text", F.array("__text"))
    lines = formed.select(*keys, "__form", F.explode_outer(pieces).alias("__line"))
    is_json, is_text = F.col("__form") == "json", F.col("__form") == "text"
    lines = lines.withColumns({"__prose": F.when(is_text, F.col("__line")), "__line": F.when(is_json, strip(F.col("__line")))})
    stated = with_line_usage(lines, "__line").withColumn("__said", F.when(is_text, usage.text_usage(F.col("__prose"))))
    chosen = {
        name: F.coalesce(F.col(name), F.col(f"__said.{name}"), F.when(F.col("__form") == "zero", F.lit(0).cast(kind))) for name, kind in FIELDS.items()
    }
    return _sums(stated.withColumns(chosen), keys)


def as_struct() -> Column:
    """The usage columns as one value, as the checks on usage take it."""
    return F.struct(*FIELDS)
