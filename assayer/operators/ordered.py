"""Running values in key order that survive one key holding most of the rows.

A plain window sends every row of a key to one task. Here the rows are first sorted by range over keys and
order, so that a key with many rows lies in many ranges, and stored with their places. Then every (key,
range) is walked by a window of its own. Only keys that lie in more than one range need anything else: the
totals of their ranges, at most two rows a range in all, are accumulated and added as offsets. There is no
number of pieces to choose, and nothing of the data passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from assayer.session import store_table

_AT, _RANGE, _TIE = "__at", "__range", "__tie"
_PLACE_BITS = 33  # the lower bits of a row's number count inside its range


@dataclass(frozen=True)
class Placed:
    """Rows sorted by range over keys and order, and the keys that reach from one range into the next."""

    rows: DataFrame
    keys: tuple[str, ...]
    spanning: DataFrame  # at most a row a range, and there are at most spark.sql.shuffle.partitions ranges


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return same


def place(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Placed:
    """Sorts and stores a table for :func:`walk`. Rows of equal order are split like any others, unless they are identical."""
    tie = F.xxhash64(*[F.col(f.name) for f in df.schema if isinstance(f.dataType, AtomicType)])
    ordered = df.withColumn(_TIE, tie).orderBy(*keys, *order, _TIE).drop(_TIE)
    rows = store_table(ordered.withColumn(_AT, F.monotonically_increasing_id()), "placed-rows")
    rows = rows.withColumn(_RANGE, F.shiftright(_AT, _PLACE_BITS))
    # a key that goes on in a range holds the range's first row
    begins = (F.col(_RANGE) > 0) & (F.col(_AT).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) == 0)
    firsts = rows.filter(begins).select(F.lit(True).alias("__spans"), *[F.col(k).alias(f"__f_{k}") for k in keys]).distinct()
    return Placed(rows, tuple(keys), firsts)


def walk(
    placed: Placed, rows: DataFrame | None = None, number: str | None = None, sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None, inclusive: bool = True,
) -> DataFrame:
    """Adds running values to the placed rows, or to ``rows`` with columns added to them."""
    rows, keys = placed.rows if rows is None else rows, list(placed.keys)
    sums, maxima = sums or {}, maxima or {}
    base = Window.partitionBy(*keys, _RANGE).orderBy(_AT)
    frame = base.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    added: dict[str, Column] = {number: F.row_number().over(base).cast("bigint")} if number else {}
    added |= {name: F.coalesce(F.sum(source).over(frame), F.lit(0).cast(rows.schema[source].dataType)) for name, source in sums.items()}
    added |= {name: F.max(source).over(frame) for name, source in maxima.items()}
    # spanning keys and offsets are bounded by the number of ranges, so both are broadcast
    totals = rows.join(F.broadcast(placed.spanning), _same(keys, "__f_"), "left_semi").groupBy(*keys, _RANGE).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(source).alias(f"__t_{name}") for name, source in sums.items()],
        *[F.max(source).alias(f"__t_{name}") for name, source in maxima.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in (*keys, _RANGE)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        *[F.sum(f"__t_{name}").over(before).alias(f"__o_{name}") for name in sums],
        *[F.max(f"__t_{name}").over(before).alias(f"__o_{name}") for name in maxima],
    )
    shifted = {name: F.coalesce(F.col(f"__o_{name}") + F.col(name), F.col(name), F.col(f"__o_{name}")) for name in sums}
    shifted |= {name: F.greatest(F.col(f"__o_{name}"), F.col(name)) for name in maxima}
    if number:
        shifted[number] = (F.col(number) + F.coalesce("__o", F.lit(0))).cast("bigint")
    walked = rows.withColumns(added).join(F.broadcast(offsets), _same([*keys, _RANGE], "__k_"), "left")
    return walked.withColumns(shifted).select(*rows.columns, *added)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str | None = None, sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None, inclusive: bool = True,
) -> DataFrame:
    """Adds running values per key, in ascending ``order``.

    ``number`` names a 1-based row number, ``sums`` and ``maxima`` map new
    column names to the columns they accumulate. ``inclusive=False`` accumulates
    only the rows before the current one (null for the first row's maximum,
    0 for its sum). ``order`` should be a total order within a key.
    """
    return walk(place(df, keys, order), number=number, sums=sums, maxima=maxima, inclusive=inclusive).drop(_AT, _RANGE)


def list_parts(df: DataFrame, keys: Sequence[str], value: str, part_rows: int = 10_000) -> DataFrame:
    """Sorted value lists per key, cut into parts of at most ``part_rows`` values.

    Joining a key's parts in ``part`` order gives the full sorted list, so no
    array grows with the key and nothing is dropped.
    """
    numbered = running(df.select(*keys, value), keys, [value], number="__row")
    part = F.floor((F.col("__row") - 1) / part_rows).cast("bigint")
    return (
        numbered.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(value)).alias(value))
    )
