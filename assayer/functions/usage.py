"""Cost and token usage from captured tool output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field names and phrases the tools print, in order of preference.
COST_KEYS = ("cost_usd", "total_cost_usd", "cost")
TOKENS_IN_KEYS = ("tokens_in", "input_tokens", "prompt_tokens")
TOKENS_OUT_KEYS = ("tokens_out", "output_tokens", "completion_tokens")
TEXT_COST = r"(?iu)(?:cost|cost_usd|total)[^\p{Nd}]+\$?([0-9]+(?:\.[0-9]+)?)"
TEXT_TOKENS_IN = r"(?iuU)([0-9][0-9,]*)\s+(?:input|prompt|sent|tokens in)"
TEXT_TOKENS_OUT = r"(?iuU)([0-9][0-9,]*)\s+(?:output|completion|received|tokens out)"
USAGE_FORMATS = {
    "aider": "text", "claude": "json", "codex": "json", "opencode": "json", "pi": "json",
    "oracle": "zero",
}


def _usage(cost: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return F.struct(
        cost.cast("double").alias("cost_usd"),
        tokens_in.cast("bigint").alias("tokens_in"),
        tokens_out.cast("bigint").alias("tokens_out"),
    )


def _member(container: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(container, f"$.{key}", kind)


def _number(container: Column, key: str) -> Column:
    """A number, or text that reads as one after an optional ``$``; booleans, lists and objects do not read as one."""
    return F.regexp_replace(_member(container, key, "string"), r"^\$", "").try_cast("double")


def _count(container: Column, key: str) -> Column:
    """An integer, or text that reads as one without its commas; other numbers are no counts."""
    digits = F.replace(_member(container, key, "string"), F.lit(","), F.lit(""))
    counts = F.schema_of_variant(_member(container, key)).isin("BIGINT", "STRING") & digits.rlike(r"^\s*[+-]?[0-9]+\s*\z")
    return F.when(counts, digits.try_cast("bigint"))


def number_member(container: Column, keys: tuple[str, ...] = COST_KEYS) -> Column:
    """First key holding a number, or text that reads as one after an optional ``$``."""
    return F.coalesce(*[_number(container, key) for key in keys])


def count_member(container: Column, keys: tuple[str, ...]) -> Column:
    """First key holding an integer, or text that reads as one without its commas."""
    return F.coalesce(*[_count(container, key) for key in keys])


def usage_container(payload: Column) -> Column:
    """Where the counts are: ``message.usage``, else ``usage``, else the payload itself."""
    in_message = F.when(_member(payload, "message", "map<string,variant>").isNotNull(), _member(payload, "message.usage"))
    return F.coalesce(in_message, _member(payload, "usage"), payload)


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def text_usage(text: Column) -> Column:
    """Usage from prose such as ``Cost: $0.034`` or ``1,200 sent``; first match wins."""
    def count(pattern: str) -> Column:
        return F.replace(_first_group(text, pattern), F.lit(","), F.lit("")).try_cast("bigint")

    return _usage(_first_group(text, TEXT_COST).try_cast("double"), count(TEXT_TOKENS_IN), count(TEXT_TOKENS_OUT))


def usage_format(adapter: Column) -> Column:
    """``text``, ``json`` or ``zero`` for a known tool name; null otherwise."""
    branches = [F.when(adapter == name, F.lit(form)) for name, form in USAGE_FORMATS.items()]
    return F.coalesce(*branches)


def non_negative(usage: Column) -> Column:
    """Usage with negative fields turned to null (they are reported by rule V20)."""
    def keep(field: str) -> Column:
        return F.when(usage[field] >= 0, usage[field])

    return _usage(keep("cost_usd"), keep("tokens_in"), keep("tokens_out"))


def any_negative(usage: Column) -> Column:
    """True when any usage field is negative."""
    checks = [F.coalesce(usage[f] < 0, F.lit(False)) for f in ("cost_usd", "tokens_in", "tokens_out")]
    return reduce(lambda a, b: a | b, checks)
