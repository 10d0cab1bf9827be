"""Text columns: scrubbing, tails, normalising, timestamps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.binding import let

# Placeholders, key patterns and line breaks that results must agree on.
REDACTED = "<REDACTED>"
REDACTED_BINARY = "<REDACTED_BINARY_CHUNK>"
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"(?iu)(api[_-]?key|token|secret)[=:][A-Za-z0-9_./+=-]{12,}",
)
SECRET_NAME_PARTS = ("KEY", "TOKEN", "SECRET", "PASSWORD", "CREDENTIAL", "AUTH")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TAIL_BYTES = 4000
UNKNOWN_VERSION = "version_unknown"

# Java's \s leaves out the information separators that Python's str.strip drops.
_EDGE_SPACE = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z"


def strip(text: Column) -> Column:
    """Drops white space of every kind at both ends (``trim`` drops blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def normalize(text: Column) -> Column:
    """Stripped and lower-cased text."""
    return F.lower(strip(text))


def lines_of(text: Column) -> Column:
    """Lines of a text without a trailing empty line."""
    return let(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def registry_literal(secrets: Mapping[str, str]) -> Column:
    """A caller's ``{value: name}`` as the array that :func:`scrub` folds over."""
    entries = [
        F.struct(F.lit(-len(value)).alias("rank"), F.lit(value).alias("value"),
                 F.lit(f"<{name}>").alias("placeholder"))
        for value, name in sorted(secrets.items(), key=lambda item: (-len(item[0]), item[0]))
        if value
    ]
    if not entries:
        return F.array().cast("array<struct<rank:int,value:string,placeholder:string>>")
    return F.array(*entries)


def replace_registered(text: Column, registry: Column) -> Column:
    """Replaces registered secrets; ``registry`` is ordered longest value first."""
    return F.aggregate(registry, text, lambda acc, s: F.replace(acc, s["value"], s["placeholder"]))


def redact_patterns(text: Column) -> Column:
    """Redacts everything that looks like a key, token or secret assignment."""
    return reduce(lambda acc, pattern: F.regexp_replace(acc, pattern, REDACTED), SECRET_PATTERNS, text)


def scrub(text: Column, registry: Column | None = None) -> Column:
    """Registered secrets first, then the key patterns."""
    return redact_patterns(text if registry is None else replace_registered(text, registry))


def scrub_bytes(chunk: Column, registry: Column | None = None) -> Column:
    """Scrubbed text of a byte chunk; a chunk that is not UTF-8 is redacted whole."""
    valid = F.is_valid_utf8(chunk.cast("string"))
    text = F.when(valid, F.try_validate_utf8(chunk.cast("string")))
    return F.when(chunk.isNotNull(), F.coalesce(scrub(text, registry), F.lit(REDACTED_BINARY)))


def scrub_map(entries: Column, registry: Column | None = None) -> Column:
    """Scrubs keys and values of a string map; of keys that become equal the last entry stays."""
    scrubbed = F.transform(
        F.map_entries(entries),
        lambda e: F.struct(scrub(e["key"], registry).alias("key"), scrub(e["value"], registry).alias("value")),
    )
    return F.map_from_entries(last_entries(scrubbed))


def scrub_array(values: Column, registry: Column | None = None) -> Column:
    """Scrubs every element of a string array."""
    return F.transform(values, lambda value: scrub(value, registry))


def last_entries(entries: Column) -> Column:
    """Drops each (key, value) entry that a later entry with the same key replaces."""
    def superseded(entry: Column, index: Column) -> Column:
        later = F.slice(entries, index + 2, F.size(entries))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.filter(entries, superseded)


def is_secret_name(name: Column) -> Column:
    """True for variable names that usually hold credentials."""
    upper = F.upper(name)
    return reduce(lambda a, b: a | b, [upper.contains(part) for part in SECRET_NAME_PARTS])


def utf8_tail(text: Column, limit: int = TAIL_BYTES) -> Column:
    """The last ``limit`` bytes of the UTF-8 form, without a broken leading character."""
    start = F.greatest(F.octet_length(text) - limit + 1, F.lit(1))
    tail = F.substr(F.encode(text, "UTF-8"), start)
    whole = F.regexp_replace(F.hex(tail), "^(?:[89AB][0-9A-F]){0,3}", "")
    return F.decode(F.unhex(whole), "UTF-8")


def first_line_or_unknown(text: Column, limit: int = 200) -> Column:
    """First line of a captured version output, at most ``limit`` characters."""
    head = F.try_element_at(lines_of(strip(text)), F.lit(1))
    return F.coalesce(F.nullif(F.left(head, F.lit(limit)), F.lit("")), F.lit(UNKNOWN_VERSION))


def iso_utc(moment: Column) -> Column:
    """UTC time with second precision and a ``Z``."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """Number as text with a fixed count of decimals; exact ties go to the even digit."""
    shape = "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(f"+{shape};-{shape}" if signed else shape))
