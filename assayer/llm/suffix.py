"""Exact repeated-passage removal with a difference-cover sample of the suffixes.

A byte goes if a string of ``length`` bytes covering it also starts in a document with a smaller id.
The suffixes are never sorted all at once. Documents are packed into parts of bounded size, kept in a
table bucketed by part, so the texts are dealt out once and no later step shuffles them. Then:

1. *Sort the sample.* Positions whose offset modulo ``PERIOD`` lies in the difference cover are sampled.
   Any two positions reach sampled positions by one common shift below ``PERIOD``, so equal strings of
   ``length`` bytes hold equal sampled tuples of ``length - PERIOD + 1`` bytes at the same place in
   both. The tuples' names are sorted over the cluster, by ranges of the name, and neighbours compared.
2. *Recurse on the names that repeat.* Only samples whose name occurs in another document stay. They are
   named again by a longer prefix with its left context, ``PERIOD - 1 + length`` bytes, and sorted
   again: where such a string starts in a smaller document, all strings of ``length`` bytes in it do.
3. *Merge the remaining suffixes.* Positions from which a repeated sample is within reach, sampled or not,
   and which step 2 left open, are named by their full ``length`` bytes and sorted into the rest.
   Comparing neighbours settles them.

Depth is limited to ``length``, so a rank is only ever needed up to equality: names are 64-bit hashes of
the prefix (40 bits in step 1, where a false hit only costs work), and sorted by value. Names travel
as sorted runs, each coded by its differences; what comes back is one bit per name. Names of one
part are distinct, so a string that a third of all documents share counts once per part.

Defined cases: a null text is empty; texts shorter than ``length`` keep every byte; a null id counts
as smaller than every other; rows that share an id never remove from each other and are each returned;
an empty table gives no rows. Matches never cross documents. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import store

PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every difference modulo 31 is one of two members
PART_BYTES = 8 << 20
RUN_NAMES = 1_500_000  # names compared in one task
_SLAB = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)

RUN = "level int, bucket long, part long, names binary, ids binary"
FLAGS = "part long, level int, bucket long, flags binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the rolling hash's base and of its inverse, made once per worker."""

    _made: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls._made is None:
            cls._made = _powers(_BASE, _SLAB + 4096), _powers(pow(_BASE, -1, 2**64), _SLAB + 4096)
        return cls._made


def prefix_names(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the ``width`` bytes from each of the ascending positions."""
    power, inverse = _Tables.get()
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(data), _SLAB):
        a, b = np.searchsorted(at, [low, low + _SLAB])
        if a == b:
            continue
        piece = data[low : low + _SLAB + width].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[: len(piece)], out=total[1:])
        own = at[a:b] - low
        out[a:b] = (total[own + width] - total[own]) * inverse[own]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as the first and the differences, in as few bytes each as the largest needs."""
    step = np.diff(values.astype(np.uint64))
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return struct.pack("<BQ", width, int(values[0])) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, first = struct.unpack_from("<BQ", blob)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(raw) + 1, 8), np.uint8)
    step[1:, :width] = raw
    values = step.reshape(-1).view("<u8").astype(np.uint64)
    values[0] = first
    return np.cumsum(values, dtype=np.uint64)


def _pack_ids(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    above = (ids.astype(np.int64).view(np.uint64) - np.uint64(low % 2**64)).astype("<u8")
    width = max(1, (int(above.max()).bit_length() + 7) // 8)
    return struct.pack("<Bq", width, low) + above.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_ids(blob: bytes) -> np.ndarray:
    width, low = struct.unpack_from("<Bq", blob)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return (full.reshape(-1).view("<u8").astype(np.uint64) + np.uint64(low % 2**64)).view(np.int64)


class Part:
    """One part's documents as one byte array, and what the flags of earlier steps say about it."""

    def __init__(self, docs: pa.Table, length: int, buckets: dict[int, int]):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = pa.concat_arrays(docs["text"].chunks) if docs["text"].num_chunks > 1 else docs["text"].chunk(0)
        self.null = docs["doc_id"].is_null().to_numpy()
        self.ids = pc.fill_null(docs["doc_id"], _NO_ID).to_numpy().astype(np.int64)
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        whole = pa.concat_arrays([text])  # its bytes stand in one buffer
        low = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset] if len(whole) else 0
        held = whole.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[low : low + int(size.sum())] if held and size.sum() else np.empty(0, np.uint8)
        self.length, self.buckets = length, buckets
        self.tuple = length - PERIOD + 1
        # the sampled positions whose tuple lies in one document
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(np.resize(cover, len(self.data)))
        doc = self.owner(at)
        inside = at + self.tuple <= self.stop[doc]
        self.at, self.doc = at[inside], doc[inside]
        self.sample = _Names(prefix_names(self.data, self.at, self.tuple) >> np.uint64(24), self.ids[self.doc], 40)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Document of each position; empty documents own none."""
        return np.searchsorted(self.stop, at, "right")

    def repeated(self, flags: dict) -> None:
        """Step 1's outcome: the samples whose name occurs in another document."""
        keep = (self.sample.flagged(flags.get(1, ()), self.buckets[1]) | self.sample.shared())[self.sample.inverse]
        self.at, self.doc = self.at[keep], self.doc[keep]

    def contexts(self) -> _Names:
        """Step 2's names: the repeated samples with their context."""
        back = PERIOD - 1
        whole = (self.at - back >= self.start[self.doc]) & (self.at + self.length <= self.stop[self.doc])
        self.context_at = self.at[whole]
        names = prefix_names(self.data, self.context_at - back, back + self.length)
        self.context = _Names(names, self.ids[self.doc[whole]], 64)
        return self.context

    def remaining(self, flags: dict) -> _Names:
        """Step 3's names: positions near a repeated sample that step 2 leaves open."""
        n = len(self.data)
        hit = self.context_at[self.context.smaller(flags.get(2, ()), self.buckets[2])]
        self.settled = _covered(n, hit - (PERIOD - 1), hit + 1)
        near = _covered(n, np.maximum(self.at - (PERIOD - 1), self.start[self.doc]), self.at + 1)
        tail = (self.stop[:, None] - np.arange(1, self.length)).astype(np.int64)
        near[tail[tail >= self.start[:, None]]] = False
        near &= ~self.settled
        self.open_at = np.flatnonzero(near)
        self.open = _Names(prefix_names(self.data, self.open_at, self.length), self.ids[self.owner(self.open_at)], 64)
        return self.open

    def results(self, flags: dict) -> Iterator[dict]:
        """Every document's removed spans and kept bytes."""
        starts = self.settled
        starts[self.open_at[self.open.smaller(flags.get(3, ()), self.buckets[3])]] = True
        # a byte goes if a removed string starts at it or at one of the length - 1 bytes before it
        total = np.cumsum(starts, dtype=np.int32)
        gone = total > 0
        gone[self.length :] = total[self.length :] > total[: -self.length]
        for k, (a, b) in enumerate(zip(self.start.tolist(), self.stop.tolist())):
            own, body = gone[a:b], self.data[a:b]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                spans = [{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)]
                yield {"doc_id": None if self.null[k] else int(self.ids[k]), "n_bytes": b - a, "n_removed": int(own.sum()), "spans": spans, "kept": body[~own].tobytes()}
            else:
                yield {"doc_id": None if self.null[k] else int(self.ids[k]), "n_bytes": b - a, "n_removed": 0, "spans": [], "kept": body.tobytes()}


def _covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:-1], dtype=np.int32, out=depth[:-1]) > 0


class _Names:
    """The distinct sorted names of a part, with the smallest id each occurs under."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, bits: int):
        self.bits, self.ids = bits, ids
        self.names, first, self.inverse = np.unique(names, return_index=True, return_inverse=True)
        self.least = ids[first]  # ids ascend with the position

    def bounds(self, buckets: int) -> np.ndarray:
        edges = [(k << self.bits) // buckets for k in range(1, buckets)]
        return np.concatenate([[0], np.searchsorted(self.names, np.array(edges, np.uint64)), [len(self.names)]]).astype(np.int64)

    def runs(self, part: int, level: int, buckets: int, with_ids: bool) -> Iterator[dict]:
        edges = self.bounds(buckets)
        for k in range(buckets):
            a, b = int(edges[k]), int(edges[k + 1])
            if a < b:
                yield {"level": level, "bucket": k, "part": part, "names": pack(self.names[a:b]), "ids": _pack_ids(self.least[a:b]) if with_ids else None}

    def flagged(self, rows, buckets: int) -> np.ndarray:
        out, edges = np.zeros(len(self.names), bool), self.bounds(buckets)
        for bucket, bits in rows:
            a, b = int(edges[bucket]), int(edges[bucket + 1])
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return out

    def shared(self) -> np.ndarray:
        """Names that occur under two ids of the part."""
        out = np.zeros(len(self.names), bool)
        out[self.inverse[self.ids != self.least[self.inverse]]] = True
        return out

    def smaller(self, rows, buckets: int) -> np.ndarray:
        """Occurrences whose name also occurs under a smaller id."""
        return (self.flagged(rows, buckets)[self.inverse]) | (self.least[self.inverse] < self.ids)


def _compare(runs: pa.Table) -> pa.Table:
    """Sorts the runs of one range of names together and compares neighbours: a bit per name and part."""
    level = runs["level"][0].as_py()
    part, blobs = runs["part"].to_pylist(), runs["names"].to_pylist()
    lists = [unpack(b) for b in blobs]
    names = np.concatenate(lists)
    if level == 1:
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    else:
        ids = np.concatenate([_unpack_ids(b) for b in runs["ids"].to_pylist()])
        order = np.lexsort((ids, names))
        first = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        least = ids[order][first][np.cumsum(first) - 1]
        hit = ids[order] > least
    flags = np.zeros(len(names), bool)
    flags[order] = hit
    out, at = [], 0
    for number, own in zip(part, lists):
        bits = flags[at : at + len(own)]
        at += len(own)
        if bits.any():
            out.append({"part": number, "level": level, "bucket": runs["bucket"][0].as_py(), "flags": np.packbits(bits).tobytes()})
    return pa.Table.from_pylist(out, _schema(FLAGS))


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in text.split(", "))])


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]
)


def parts_table(docs: DataFrame, buckets: int, part_bytes: int) -> DataFrame:
    """The documents with a part number, in a table bucketed by it. Written by the scanning tasks: no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = 0, None
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                if number is None or held >= part_bytes:
                    number, held = uuid.uuid4().int >> 65, 0
                base = int(size[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(size, base + part_bytes - held, "right")))
                held += int(size[min(end, batch.num_rows) - 1]) - base
                piece = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([pa.array([number] * piece.num_rows, pa.int64()), piece["doc_id"], piece["text"]], ["part", "doc_id", "text"])
                at = end
                if at < batch.num_rows:
                    held = part_bytes

    name = f"suffix_parts_{uuid.uuid4().hex}"
    docs.mapInArrow(run, "part long, doc_id long, text string").write.bucketBy(buckets, "part").option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name)


def remove_repeats(docs: DataFrame, length: int = 50, part_bytes: int = PART_BYTES, run_names: int = RUN_NAMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row; ``length`` is at least the period plus 4."""
    if length < PERIOD + 4:
        raise ValueError(f"strings of fewer than {PERIOD + 4} bytes need a smaller period")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    table = parts_table(rows, wide, part_bytes)
    sampled = -(-total * len(COVER) // PERIOD)
    buckets = {1: max(1, -(-sampled // run_names)), 2: max(1, -(-sampled // run_names)), 3: max(1, -(-sampled // run_names))}
    run_schema = _schema(RUN)

    def first(docs_: pa.Table) -> pa.Table:
        part = Part(docs_, length, buckets)
        return pa.Table.from_pylist(list(part.sample.runs(docs_["part"][0].as_py(), 1, buckets[1], False)), run_schema)

    def advance(level: int):
        def run(docs_: pa.Table, flags_: pa.Table) -> pa.Table:
            if not docs_.num_rows:
                return pa.Table.from_pylist([], run_schema if level < 4 else _RESULT)
            flags: dict[int, list] = {}
            for row in flags_.to_pylist():
                flags.setdefault(row["level"], []).append((row["bucket"], row["flags"]))
            part = Part(docs_, length, buckets)
            part.repeated(flags)
            names = part.contexts()
            if level > 2:
                names = part.remaining(flags)
            if level > 3:
                return pa.Table.from_pylist(list(part.results(flags)), _RESULT)
            return pa.Table.from_pylist(list(names.runs(docs_["part"][0].as_py(), level, buckets[level], True)), run_schema)

        return run

    runs = table.groupBy("part").applyInArrow(first, RUN)
    flags = store(runs.groupBy("bucket").applyInArrow(_compare, FLAGS), "suffix-flags")
    for level in (2, 3):
        runs = table.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(advance(level), RUN)
        flags = flags.union(store(runs.groupBy("bucket").applyInArrow(_compare, FLAGS), "suffix-flags"))
    return table.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(advance(4), RESULT)
