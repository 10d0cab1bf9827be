"""SimHash near-duplicates with pivot distance tables.

1. *Fingerprints.* Every whole text becomes a fingerprint of ``64 * words64`` bits over its word
   shingles. Equal fingerprints are one class from here on, so exact copies cost one row.
2. *Pivot table.* For each distinct fingerprint the Hamming distances to many seeded reference
   fingerprints are computed once and stored beside it.
3. *Cells.* The table alone would have to be held against itself, so pairs meet in cells first: a
   cell is a set of bit positions, and fingerprints meet if they agree on all of them. With
   :func:`block_cells` two fingerprints within ``max_bits`` always share a cell, so nothing is lost.
   Every row of a cell is first held against the cell's smallest. Cells whose rows are all in one
   component then are done. In the others rows of different components are compared: a cell's
   largest component against the rest and the rest against each other, cut into chunks, so no group
   is unbounded and a cell of near-copies takes no pass over its pairs.
4. *Pivots, then verification.* By the triangle inequality no coordinate of two linked rows differs
   by more than ``max_bits``: pairs with a larger difference are discarded, survivors are verified
   on the fingerprints.
5. *Components* of the links.

Defined cases: a text without words (null, empty, spaces) has fingerprint zero and is linked like any
other; a null doc_id is no candidate for the smallest of its component; repeated rows are members
of the same class; an empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import components, store

SEED = 42
CHUNK = 1024  # rows of a cell held against each other at once
BIN_ROWS = 20_000  # rows handed to Python at once
_SLAB = 1 << 16  # shingles whose bits are counted at once

Cells = Sequence[Sequence[int]]


def block_cells(bits: int = 64, blocks: int = 7, max_bits: int = 4) -> list[list[int]]:
    """Unions of ``blocks - max_bits`` of the blocks: at most ``max_bits`` blocks differ, so one union agrees."""
    parts = [list(map(int, p)) for p in np.array_split(np.arange(bits), blocks)]
    return [sorted(itertools.chain(*chosen)) for chosen in itertools.combinations(parts, blocks - max_bits)]


def fingerprint(text: str | None, shingle: int, words64: int = 1) -> bytes:
    """Big-endian fingerprint of one whole text; a bit is set if it is set in over half the shingle hashes.

    The first 64 bits use XXH64 of the shingle; further ones are mixed from it.
    """
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return bytes(8 * words64)
    out = []
    for k in range(words64):
        mixed = hashes
        if k:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = mixed ^ (mixed >> np.uint64(32))
        rows = mixed.astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = sum(np.unpackbits(rows[i : i + _SLAB], axis=1).sum(0, dtype=np.int64) for i in range(0, len(rows), _SLAB))
        out.append(np.packbits(2 * counts > len(hashes)).tobytes())
    return b"".join(out)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of one whole text, of all its words if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        digests = [xxhash.xxh64_digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digests = [xxhash.xxh64_digest(line[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, words64: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle, words64) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], fps], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", "text_hash").schema.add("fp", "binary"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), kind).reshape(len(column), -1)


def _distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p).sum(1) for p in pivots], axis=1).astype("<u2")


def _short(fps: np.ndarray) -> np.ndarray:
    """A long for each fingerprint: itself if it has 64 bits, else its 64-bit hash."""
    if fps.shape[1] == 1:
        return fps[:, 0].astype(np.uint64).view(np.int64)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in fps], np.uint64).view(np.int64)


def pivot_table(distinct: DataFrame, words64: int, pivots: int, seed: int = SEED) -> DataFrame:
    """(fid, fp, coords): the distances of each distinct fingerprint to the reference fingerprints."""
    references = np.random.default_rng(seed).integers(0, 2**64, (pivots, words64), dtype=np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                fps = _matrix(frame["fp"], ">u8").astype(np.uint64)
                yield pd.DataFrame({"fid": _short(fps), "fp": frame["fp"], "coords": [row.tobytes() for row in _distances(fps, references)]})

    return distinct.select("fp").mapInPandas(run, "fid long, fp binary, coords binary")


def cell_keys(table: DataFrame, cells: Cells) -> DataFrame:
    """(key, fid): the cells a fingerprint lies in; a key is the cell's number and the bits on it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                bits = np.unpackbits(_matrix(part["fp"], np.uint8), axis=1)
                keys = [(bits[:, cell].astype(np.int64) @ (1 << np.arange(len(cell), dtype=np.int64))) | (k << 40) for k, cell in enumerate(cells)]
                yield pd.DataFrame({"key": np.concatenate(keys), "fid": np.tile(part["fid"].to_numpy(), len(cells))})

    return table.select("fid", "fp").mapInPandas(run, "key long, fid long")


def linked(fps: np.ndarray, coords: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs (i, j) survive the pivot table and the verification."""
    alive = np.arange(len(i))
    for column in coords.T.astype(np.int32):
        if not len(alive):
            break
        alive = alive[np.abs(column[i[alive]] - column[j[alive]]) <= max_bits]
    ok = np.zeros(len(i), bool)
    ok[alive] = np.bitwise_count(fps[i[alive]] ^ fps[j[alive]]).sum(1) <= max_bits
    return ok


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_rows(fps: np.ndarray, coords: np.ndarray, max_bits: int, group: np.ndarray) -> np.ndarray:
    """For rows of one cell, the smallest row each is linked with, directly or over others of them.

    Rows of a group are linked from the start.
    """
    first, label = np.unique(group, return_index=True, return_inverse=True)[1:]
    label = first[label]
    for row in range(len(fps)):
        others = np.arange(row + 1, len(fps))
        others = others[label[others] != label[row]]
        others = others[linked(fps, coords, np.full(len(others), row), others, max_bits)]
        if len(others):
            joined = np.append(label[others], label[row])
            label[np.isin(label, joined)] = joined.min()
    return label


def links(table: DataFrame, cells: Cells, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between fids whose closure is that of all pairs within ``max_bits`` that share a cell."""
    keys = cell_keys(table, cells)
    shared = store(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fid").alias("a"), F.max("fid").alias("b")).filter("n > 1"), "cells")
    large = store(shared.filter("n > 2").select("key", F.col("a").alias("low")), "large-cells")
    members = store(keys.join(large, "key"), "members")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                fps = np.concatenate([_matrix(frame["fp_a"], ">u8"), _matrix(frame["fp_b"], ">u8")]).astype(np.uint64)
                coords = np.concatenate([_matrix(frame["coords_a"], "<u2"), _matrix(frame["coords_b"], "<u2")])
                i = np.arange(len(frame))
                yield frame.loc[linked(fps, coords, i, i + len(frame), max_bits), ["a", "b"]]

    left = table.select(F.col("fid").alias("a"), F.col("fp").alias("fp_a"), F.col("coords").alias("coords_a"))
    right = table.select(F.col("fid").alias("b"), F.col("fp").alias("fp_b"), F.col("coords").alias("coords_b"))
    stars = members.filter("fid <> low").select(F.col("low").alias("a"), F.col("fid").alias("b"))
    ends = shared.filter("n = 2").select("a", "b").union(stars).distinct()
    first = store(ends.join(left, "a").join(right, "b").mapInPandas(verify, "a long, b long"), "near-pairs")
    labels = components(first)
    placed = members.join(labels, F.col("fid") == F.col("node"), "left").select("key", "fid", F.coalesce("component", "fid").alias("label"))
    placed = store(placed, "labelled-members")
    main = F.max(F.struct("rows", "label"))
    mixed = (
        placed.groupBy("key", "label").agg(F.count("*").alias("rows")).groupBy("key")
        .agg(F.sum("rows").alias("n"), main.alias("main"), F.count("*").alias("kinds")).filter("kinds > 1")
        .select("key", "n", F.col("main.rows").alias("most"), F.col("main.label").alias("main"))
    )
    small, inside = F.col("n") <= chunk, F.col("label") == F.col("main")
    mains = F.ceil(F.col("most") / F.lit(chunk)).cast("int")
    rest = F.ceil((F.col("n") - F.col("most")) / F.lit(chunk)).cast("int")
    place = F.when(inside, F.pmod(F.xxhash64("fid"), mains)).otherwise(mains + F.pmod(F.xxhash64("fid"), rest)).cast("int")
    zero = F.lit(0)
    units = store(
        placed.join(store(mixed, "mixed-cells"), "key")
        .withColumn("own", F.when(small, zero).otherwise(place))
        .withColumn("other", F.explode(F.sequence(F.when(inside & ~small, mains).otherwise(zero), F.when(small, zero).otherwise(mains + rest - 1))))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fid", "label"),
        "units",
    )
    bound = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-units.count() // BIN_ROWS)))).alias("bin")
    binned = units.select("*", bound).join(table, "fid").groupBy("bin")
    return first.union(binned.applyInPandas(lambda frame: _forest_of(frame, max_bits), "a long, b long")).distinct()


def _units(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The rows of a bin in order, their fingerprints and coordinates, and from where to where its units lie."""
    frame = frame.sort_values(["key", "i", "j", "fid"], ignore_index=True)
    unit = frame[["key", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)])).tolist()
    return frame, _matrix(frame["fp"], ">u8").astype(np.uint64), _matrix(frame["coords"], "<u2"), list(zip(starts, [*starts[1:], len(frame)]))


def _forest_of(frame: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """A spanning forest of the links in all units of a bin: cells that overlap find the same links again."""
    frame, fps, coords, units = _units(frame)
    fid, groups = frame["fid"].to_numpy(), frame["label"].to_numpy()
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, e in units:
        label = link_rows(fps[s:e], coords[s:e], max_bits, groups[s:e])
        moved = np.flatnonzero(label != np.arange(e - s))
        a.append(fid[s + moved])
        b.append(fid[s + label[moved]])
    ends = np.concatenate([*a, *b])
    nodes, place = np.unique(ends, return_inverse=True)
    root = _forest(len(nodes), place[: len(ends) // 2], place[len(ends) // 2 :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def near_duplicates(
    docs: DataFrame, shingle: int = 4, words64: int = 1, max_bits: int = 4, cells: Cells | None = None, pivots: int = 32,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id, first): component_id is the smallest doc_id reachable over links.

    ``first`` names the component's first row: whether it lacks an id, its id, the hash of its text.
    """
    prints = store(fingerprints(docs, shingle, words64, doc_id, text), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = store(prints.groupBy("fp").agg(F.min(own).alias("first")), "classes")
    table = store(pivot_table(classes, words64, pivots), "pivots")
    cells = cells or block_cells(64 * words64, max_bits + 3, max_bits)
    groups = components(links(table, cells, max_bits))
    ids = table.select("fid", "fp").join(groups, F.col("fid") == F.col("node")).select(F.col("fp").alias("of"), "component")
    grouped = classes.join(ids, F.col("fp") == F.col("of"), "left").select("fp", "first", "component")
    smallest = grouped.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("low"))
    placed = grouped.join(smallest, F.col("component") == F.col("c"), "left").select(F.col("fp").alias("of"), F.coalesce("low", "first").alias("first"))
    return prints.join(store(placed, "placed"), F.col("fp") == F.col("of")).select(
        "doc_id", "fp", F.col("first.doc_id").alias("component_id"), "first"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id, null last.

    Different texts under one id are different documents; of equal rows one stays.
    """
    groups = near_duplicates(docs, doc_id=doc_id, text=text, **settings)
    firsts = store(groups.select("first.doc_id", "first.text_hash").groupBy("doc_id", "text_hash").count(), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash"))
    # only ids and hashes that come more than once are brought together to keep one row of them
    often = rows.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("o"), F.col("text_hash").alias("oh"))
    often = store(often, "repeated")
    chosen = rows.join(
        firsts.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi",
    )
    same = F.col("doc_id").eqNullSafe(F.col("o")) & (F.col("text_hash") == F.col("oh"))
    once = chosen.join(often, same, "left_anti")
    again = chosen.join(often, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return once.union(again).select("row.*")
