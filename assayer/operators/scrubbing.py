"""Scrubbing a table with a registry of secrets that is itself a table, of any size.

The registry is indexed once. Every secret is represented by one *anchor*: the hash of a window of a fixed
width, the rarest of its windows in the registry, so that secrets with a common beginning do not share
anchors. A pass over the texts hashes their windows of the same widths and keeps those that a filter of
fixed size lets through; the rest of the work is an equi-join of anchors, which gives each text the few
secrets that may be in it, whatever the size of the registry. Those are replaced, longest first, by Spark's
own string functions, as if the whole registry had been tried.

A placeholder can itself complete a secret that was not in the text before. Which placeholders can is a
property of the registry: the index holds the pairs, found by equi-joins as well, and a text's secrets are
closed under them. Usually there are none.

Texts travel only if the found secrets are too many to broadcast; the anchors, the filter's hits and the
found secrets are what is shuffled. Null texts stay null; a secret without a name leaves an empty placeholder;
rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import redact_patterns, replace_registered
from assayer.session import spread, store_table

WIDTHS = (1, 2, 4, 8, 16)  # bytes of an anchor: the widest a secret has room for
FILTER_BITS = 22  # the filter has two to this power bits, half a megabyte
_SLAB = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def registered_secrets(secrets: DataFrame) -> DataFrame:
    """(value, name): empty values are ignored, the last registration of a value wins."""
    return (
        secrets.filter(F.col("value") != "")
        .groupBy("value")
        .agg(F.max(F.struct("position", "name")).alias("last"))
        .select("value", "last.name")
    )


@dataclass
class Registry:
    """An indexed registry."""

    anchors: DataFrame  # anchor, rank, value, placeholder: one row a secret
    follows: DataFrame | None  # start, rank, value, placeholder: the secrets that the placeholder ``start`` can complete
    widths: tuple[int, ...]
    filter: np.ndarray


def _windows(data: bytes, widths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashes of all windows of each of the widths, by doubling the width."""
    hashes, width = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
    while len(hashes):
        if width in widths:
            mixed = (hashes ^ np.uint64(width)) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            yield mixed ^ (mixed >> np.uint64(32))
        if 2 * width > max(widths):
            return
        hashes, width = (hashes[:-width] ^ (hashes[:-width] >> np.uint64(31))) * _MIX + hashes[width:], 2 * width


def _arrow(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _secret_windows(known: DataFrame) -> DataFrame:
    """(number, window): the different windows of each secret, of the widest width it has room for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, found = batch.slice(at, 1000), [np.empty(0, np.uint64)]
                for value in part.column(1).to_pylist():
                    data = value.encode("utf-8", "surrogatepass")
                    (hashes,) = _windows(data, (max(w for w in WIDTHS if w <= len(data)),))
                    found.append(np.unique(hashes))
                which = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found[1:]]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), _arrow(np.concatenate(found))], ["number", "window"])

    return known.select("number", "value").mapInArrow(run, "number long, window long")


def index_registry(secrets: DataFrame) -> Registry:
    """Indexes (value, name, position) rows; the index is stored and serves any number of tables and batches."""
    known = registered_secrets(secrets).select(
        F.monotonically_increasing_id().alias("number"), (-F.length("value")).alias("rank"), "value",
        F.concat(F.lit("<"), F.coalesce("name", F.lit("")), F.lit(">")).alias("placeholder"),
    )
    known = store_table(known, "registry-values")
    windows = store_table(_secret_windows(known), "registry-windows")
    often = windows.groupBy("window").count()
    rarest = windows.join(often, "window").groupBy("number").agg(F.min_by("window", "count").alias("anchor"))
    anchors = store_table(known.join(rarest, "number").select("anchor", "rank", "value", "placeholder"), "registry")
    # at most a row a filter bit, then a row a width
    both = F.array(F.shiftrightunsigned("anchor", 64 - FILTER_BITS), F.col("anchor").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[anchors.select(F.explode(both.cast("array<int>")).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    size = F.octet_length("value")
    width = F.greatest(F.lit(1), *[F.when(size >= w, w) for w in WIDTHS])
    registry = Registry(anchors, None, tuple(sorted(r[0] for r in anchors.select(width).distinct().collect())), np.packbits(bits))
    follows = store_table(_follows(registry), "registry-follows")
    return registry if follows.isEmpty() else replace(registry, follows=follows)


def _key(column: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(column).alias("__k1"), F.xxhash64(F.lit(1), column).alias("__k2")]


def _present(texts: DataFrame, registry: Registry) -> DataFrame:
    """(k1, k2, rank, value, placeholder): for each text of a single column the secrets whose anchors it holds."""
    widths, packed = registry.widths, registry.filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).view(bool)
        for batch in batches:
            rows, found = [], [np.empty(0, np.uint64)]
            for text in batch.column(2):
                data = text.as_py().encode("utf-8", "surrogatepass")
                own = [found[0]]
                for at in range(0, len(data), _SLAB):
                    for hashes in _windows(data[at : at + _SLAB + WIDTHS[-1] - 1], widths):
                        maybe = hashes[bits[hashes >> np.uint64(64 - FILTER_BITS)]]
                        own.append(np.unique(maybe[bits[maybe & np.uint64((1 << FILTER_BITS) - 1)]]))
                found.append(np.unique(np.concatenate(own)))
                rows.append(len(found[-1]))
            which = pa.array(np.repeat(np.arange(len(rows)), rows))
            hits = _arrow(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), hits], ["__k1", "__k2", "__anchor"])

    column = F.col(texts.columns[0])
    hits = texts.filter(column.isNotNull()).select(*_key(column), column).mapInArrow(run, "__k1 long, __k2 long, __anchor long")
    return hits.join(registry.anchors, F.col("__anchor") == F.col("anchor")).select("__k1", "__k2", "rank", "value", "placeholder")


def _follows(registry: Registry) -> DataFrame:
    """(start, rank, value, placeholder): secrets that a placeholder, alone or with the text around it, can complete."""
    secrets = registry.anchors.select("rank", "value", "placeholder")
    starts = secrets.select(F.col("placeholder").alias("start")).distinct()
    inside = (
        starts.select("start", *_key(F.col("start"))).withColumnsRenamed({"__k1": "a", "__k2": "b"})
        .join(_present(starts, registry), (F.col("a") == F.col("__k1")) & (F.col("b") == F.col("__k2")))
        .filter(F.col("start").contains(F.col("value")))
    )
    # the others hold an angle bracket: an end of the placeholder is their beginning, its beginning their end, or it lies inside
    size, long = F.length("value"), F.length("start")
    heads = F.filter(F.transform(F.sequence(F.lit(1), size), lambda n: F.substr("value", F.lit(1), n)), lambda s: s.endswith(">"))
    tails = F.filter(F.transform(F.sequence(F.lit(1), size), lambda n: F.substr("value", n)), lambda s: s.startswith("<"))
    middles = F.flatten(F.transform(tails, lambda t: F.filter(F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substr(t, F.lit(1), n)), lambda s: s.endswith(">"))))
    found = inside.select("start", "rank", "value", "placeholder")
    for piece, of in (
        (heads, F.transform(F.sequence(F.lit(1), long), lambda n: F.substr("start", n))),
        (tails, F.transform(F.sequence(F.lit(1), long), lambda n: F.substr("start", F.lit(1), n))),
        (middles, F.array("start")),
    ):
        cut = secrets.filter(F.col("value").rlike("[<>]")).withColumn("piece", F.explode(F.array_distinct(piece)))
        ends = starts.withColumn("end", F.explode(F.array_distinct(of)))
        found = found.union(cut.join(ends, F.col("piece") == F.col("end")).select("start", "rank", "value", "placeholder"))
    return found.distinct()


def _closed(present: DataFrame, follows: DataFrame) -> DataFrame:
    """The secrets of each text with those that their placeholders can complete, and so on."""
    found = fresh = store_table(present.distinct(), "scrub-found")
    while True:
        after = follows.select("start", F.col("rank").alias("r"), F.col("value").alias("v"), F.col("placeholder").alias("p"))
        led = fresh.join(after, F.col("placeholder") == F.col("start")).select("__k1", "__k2", F.col("r").alias("rank"), F.col("v").alias("value"), F.col("p").alias("placeholder"))
        fresh = store_table(led.distinct().join(found, ["__k1", "__k2", "value"], "left_anti").select(found.columns), "scrub-led")
        if fresh.isEmpty():
            return found
        found = found.union(fresh)


def scrub_with_registry(df: DataFrame, column: str, secrets: DataFrame | Registry) -> DataFrame:
    """Replaces registered secrets, longest first, then redacts the key patterns.

    ``secrets`` has (value, name, position) rows or is their index. Secrets of one length are tried in
    the order of their values.
    """
    registry = secrets if isinstance(secrets, Registry) else index_registry(secrets)
    if not registry.widths:
        return df.withColumn(column, redact_patterns(F.col(column)))
    df = spread(df)
    present = _present(df.select(column), registry)
    if registry.follows is not None:
        present = _closed(present, registry.follows)
    entry = F.struct("rank", "value", "placeholder")
    # stored, so that its size is known: a small one is broadcast and no text travels
    found = store_table(present.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set(entry)).alias("__registry")), "scrub-secrets")
    one, two = _key(F.col(column))
    keyed = df.withColumns({"__a": one, "__b": two}).join(found, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    replaced = F.when(F.col("__registry").isNull(), F.col(column)).otherwise(replace_registered(F.col(column), F.col("__registry")))
    return keyed.withColumn(column, redact_patterns(replaced)).select(*df.columns)
