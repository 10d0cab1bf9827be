"""Importance resampling towards a target distribution, with exact selection of the highest scores.

**Weights.** Word n-grams are hashed into ``buckets``. The corpus and the target are each reduced to an
array of bucket counts; a bucket's gain is the smoothed log ratio of its two shares, and a document's
weight the floored mean of the gains of its n-grams. A seeded Gumbel term added to the weight turns
"the highest scores" into a draw without replacement in proportion to the weights.

**Selection.** Nothing is sorted but the winners. The cutoff is found by a weighted median of medians:
each batch of a task gives the median of its remaining keys and their number, medians are folded to one
a task, a few a round, and one pivot by their weighted median. Each fold leaves at least half of the
weight with medians on either side, so a round is guaranteed to discard a sixteenth of the remaining
keys and discards about half. A round is one pass over the remaining keys, counts both sides of the
last pivot and has the next pivot of either side at hand; the keys are stored again whenever three
quarters are gone, so all rounds together read a small multiple of the table. Only a few numbers a
round reach the driver. The key is taken column by column: score, id, text hash, number of the stored
row; a column after the first only looks at the rows that tie at the cutoff. Winners are then sorted
by range, and ranks are the offsets of the ranges plus the places inside them.

Defined cases: a null or empty text has no features, weight 0, and too few words to be drawn; a null id
hashes as the empty text and comes after all others in ties; equal ids are ordered by a hash of their
texts, and identical rows are interchangeable; an empty target gives every bucket the smoothed share;
an empty table gives no rows. Input columns stay in the struct ``row``. Texts are read whole, in slabs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from assayer.llm.common import ascii_words, store

LAST = 10_000  # remaining keys that are looked at together at the end of a selection
_FOLDS = 16  # tasks that fold the tasks' medians
_REMEMBERED = 1 << 18  # buckets of words a task remembers


class _Buckets(dict):
    """Bucket of each feature, worked out once while it is remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, sizes: tuple[int, int]) -> Iterator[tuple[list[bytes], int]]:
    """(features, number of words) of a text, slab by slab; runs of words cross the slabs."""
    low, high = sizes
    carried: list[bytes] = []
    for words in ascii_words(text):
        own = carried + words
        out = words if low == 1 else []
        for n in range(max(low, 2), high + 1):
            # windows that end in this slab
            out = out + [b" ".join(own[i : i + n]) for i in range(max(0, len(carried) - n + 1), len(own) - n + 1)]
        carried = own[-(high - 1) :] if high > 1 else []
        yield out, len(words)


def bucket_counts(docs: DataFrame, text: str, sizes: tuple[int, int], buckets: int) -> np.ndarray:
    """Occurrences of each bucket in all texts; the driver gets at most ``buckets`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                for found, _ in features(body.as_py(), sizes):
                    total += np.bincount(np.fromiter(map(bucket_of.__getitem__, found), np.int64, len(found)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket."""
    s, t, width = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + width) / ((a + 1) * (t + width)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def score(
    docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(row, id, n_words, n_features, weight, score) of every document."""
    gain = gains(bucket_counts(docs, text, sizes, buckets), bucket_counts(target, target_text, sizes, buckets))
    names = ["n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for body, name in zip(batch.column(0), batch.column(1).to_pylist()):
                words = number = total = 0
                for found, n in features(body.as_py(), sizes):
                    words, number = words + n, number + len(found)
                    total += int(gain[np.fromiter(map(bucket_of.__getitem__, found), np.int64, len(found))].sum())
                weight = total // number if number else 0
                h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
                noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                for column, value in zip(out, (words, number, weight, weight + noise)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(c, pa.int64()) for c in out)], [*batch.schema.names[2:], *names])

    rows = docs.select(
        F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.struct("*").alias("row"),
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"),
    )
    schema = rows.drop("text", "name").schema
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def _weighted_median(middles: pd.Series, sizes: pd.Series) -> object:
    order = middles.argsort(kind="stable")
    at = int(np.searchsorted(sizes.iloc[order].cumsum(), (sizes.sum() + 1) // 2))
    return middles.iloc[order.iloc[at]]


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """One row a side: its size and the weighted median of its medians."""
    rows = [(side, part["size"].sum(), _weighted_median(part["middle"], part["size"])) for side, part in frame.groupby("side")]
    return pd.DataFrame(rows, columns=["side", "size", "middle"])


def _sides(pool: DataFrame, pivot: object) -> dict[int, tuple[int, object]]:
    """Number and approximate median of the keys below (-1), at (0) and above (1) the pivot; all are above None."""
    kind = pool.schema[0].dataType.simpleString()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            keys = frame.iloc[:, 0]
            for side, part in ((1, keys),) if pivot is None else ((-1, keys[keys < pivot]), (0, keys[keys == pivot]), (1, keys[keys > pivot])):
                if len(part):
                    rows.append((side, len(part), part.sort_values().iloc[(len(part) - 1) // 2]))
        if rows:
            yield _fold(pd.DataFrame(rows, columns=["side", "size", "middle"]))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [frame for frame in frames if len(frame)]
        if held:
            yield _fold(pd.concat(held))

    schema = f"side int, size long, middle {kind}"
    few = pool.mapInPandas(split, schema).repartition(_FOLDS).mapInPandas(again, schema).toPandas()
    return {int(r.side): (int(r.size), r.middle) for r in _fold(few).itertuples(index=False)} if len(few) else {}


def cutoff(keys: DataFrame, wanted: int) -> tuple[object, int, int]:
    """The ``wanted``-th smallest of a table's single column, how many keys are below it and how many equal it.

    The column has no nulls and more than ``wanted`` - 1 rows.
    """
    column = F.col(keys.columns[0])
    pool, stored, below, pivot = keys, None, 0, None
    while True:
        sides = _sides(pool, pivot)
        (low, down), (same, _), (high, up) = (sides.get(side, (0, None)) for side in (-1, 0, 1))
        if pivot is not None and below + low < wanted <= below + low + same:
            return pivot, below + low, same
        if wanted <= below + low:
            pool, left, pivot = pool.filter(column < F.lit(pivot)), low, down
        else:
            pool = pool if pivot is None else pool.filter(column > F.lit(pivot))
            below, left, pivot = below + low + same, high, up
        pivot = pivot.item() if hasattr(pivot, "item") else pivot
        if left <= LAST:
            rest = sorted(r[0] for r in pool.collect())
            value = rest[wanted - below - 1]
            return value, below + rest.index(value), rest.count(value)
        if stored is None:
            stored = left
        elif 4 * left <= stored:
            pool, stored = store(pool, "selection"), left


def winners(rows: DataFrame, order: list[str], wanted: int) -> Column:
    """Condition that holds for the ``wanted`` first rows in ascending order of the columns, the last of which is unique."""
    tied, left, terms, at_cut = rows.select(*order), wanted, [], F.lit(True)
    for name in order:
        value, below, equal = cutoff(tied.select(name), left)
        terms.append(at_cut & (F.col(name) < F.lit(value)))
        at_cut, left = at_cut & (F.col(name) == F.lit(value)), left - below
        if left == equal:
            break
        tied = tied.filter(F.col(name) == F.lit(value))
    return reduce(lambda a, b: a | b, [*terms, at_cut])


def number_sorted(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in ascending order, from 1: places inside sorted ranges plus the ranges' offsets."""
    local = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    at = store(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "winners")
    at = at.withColumns({"__range": F.shiftright("__place", 33), "__place": local})
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = at.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = at.join(offsets, F.col("__range") == F.col("__of"))
    return placed.withColumn(name, (F.col("__before") + F.col("__place") + 1).cast("long")).drop("__place", "__range", "__of", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **settings) -> DataFrame:
    """(row, n_features, weight, score, rank) of every document; the drawn ones have a rank, from 1 for the highest score.

    ``percent`` of the documents with at least ``least_words`` words are drawn. ``settings`` are those of :func:`score`.
    """
    scored = score(docs, target, **settings)
    kind = scored.schema["id"].dataType
    # what stands for a null id does not matter, as the flag comes first; ids that are no numbers are ordered as text
    tie = F.coalesce("id", F.lit(0).cast(kind)) if isinstance(kind, NumericType) else F.coalesce(F.col("id").cast("string"), F.lit(""))
    order = {"down": -F.col("score"), "no_id": F.col("id").isNull().cast("int"), "tie": tie, "text_hash": F.col("text_hash"), "number": F.monotonically_increasing_id()}
    scored = store(scored.withColumns(order), "importance")
    able = F.col("n_words") >= least_words
    wanted = percent * scored.filter(able).count() // 100
    shown = ["row", "n_features", "weight", "score", "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*shown)
    drawn = able & winners(scored.filter(able), list(order), wanted)
    ranked = number_sorted(scored.filter(drawn), list(order), "rank")
    rest = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*shown).unionByName(rest.select(*shown))
