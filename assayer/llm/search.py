"""Ranked lexical search: an inverted index in blocks, walked with MaxScore under pair bounds.

**Index.** A task cuts its documents into blocks of bounded size and writes, for each term of a block, the
places of its documents and its occurrences in them, and one head row with the block's ids and lengths.
Nothing is shuffled, every document with a term is in exactly one block, and the index serves any queries.

**Preparation.** The queries are taken in chunks of bounded size. One pass over the index picks the lists
of the chunk's terms and gathers them to one row a block. Each block then stores per term the largest
impact, and for pairs of terms that meet in a query the intersection of their lists with its joint impacts
and their maximum. A query's terms are paired by rising weight, so rare terms, which seldom meet, share a
pair. The k-th largest impact of a term, or joint impact of a pair, is a score that k documents reach: the
best of these over all blocks is where the query's threshold starts.

**Search.** Inside a block the query's terms are ordered by their largest impact. The bound of a set of
terms adds, for a pair inside the set, the larger of the joint maximum and the two single maxima, which is
at most their sum and far below it for terms that do not meet, and the single maxima of the others. The
terms before the first prefix whose bound reaches the threshold cannot carry a document alone; documents
come from the lists of the others, and are dropped as soon as what they have plus the bound of what is
still to be looked up stays below the threshold. A block whose whole bound is too low is skipped. The
threshold rises with the best k found so far in the task. What survives is ranked over all blocks.

Scores are integers, so results do not depend on the order of the sums. Defined cases: a null or empty
document or query has no terms and gives no rows; repeated documents are documents of their own, ordered by
id and interchangeable where it is equal; a null id comes last among equal scores; repeated query rows give
repeated results; a query term in no document adds nothing; an empty table on either side gives no rows.
Other columns are not read. Texts are read whole, in slabs; a document longer than a block is a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import ascii_words, store

BLOCK_DOCS = 4096
BLOCK_BYTES = 8 << 20  # text of a block, if it has more than one document: bounds a worker's arrays
CHUNK_BYTES = 1 << 20  # text of the queries that are searched together: the bound of what every task gets
DAMPING = 20
LENGTH_SHARE = 50


@dataclass
class Index:
    """Rows are heads of blocks (``ids``, ``lengths``) or lists of terms (``term``, ``docs``, ``tfs``)."""

    rows: DataFrame
    documents: int  # with at least one term
    terms: int  # with repeats


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of all documents to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, vocabulary, size = TaskContext.get().partitionId() << 33, [], [], {}, 0
        kind = None

        def block() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in held], np.int64)
            pairs = np.concatenate(held).astype(np.int64) * len(held) + np.repeat(np.arange(len(held)), lengths)
            pairs, tfs = np.unique(pairs, return_counts=True)
            term, doc = np.divmod(pairs, len(held))
            first = np.searchsorted(term, np.arange(len(vocabulary) + 1)).astype(np.int32)
            first = np.concatenate([[0], first]).astype(np.int32)  # the head row's lists are empty
            count = len(vocabulary) + 1
            tail = np.full(count + 1, len(held), np.int32)
            tail[0] = 0
            columns = [
                pa.array(np.full(count, number, np.int64)), pa.array([None, *vocabulary], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(first), pa.array(doc, pa.int32())),
                pa.ListArray.from_arrays(pa.array(first), pa.array(tfs, pa.int64())),
                pa.ListArray.from_arrays(pa.array(tail), pa.array(ids, kind)),
                pa.ListArray.from_arrays(pa.array(tail), pa.array(lengths)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "term", "docs", "tfs", "ids", "lengths"])

        def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 10_000):
                yield batch.slice(at, 10_000)

        for batch in batches:
            kind = batch.column(0).type
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                if ids and (len(ids) >= BLOCK_DOCS or size + len(body or "") > BLOCK_BYTES):
                    yield from slices(block())
                    number, ids, held, vocabulary, size = number + 1, [], [], {}, 0
                coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)) for words in ascii_words(body)]
                if sum(map(len, coded)):
                    ids.append(name)
                    held.append(np.concatenate(coded))
                    size += len(body)
        if ids:
            yield from slices(block())

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, term string, docs array<int>, tfs array<long>, ids array<{kind}>, lengths array<long>"
    stored = store(rows.mapInArrow(run, schema), "search-index")
    heads = stored.filter("term IS NULL")
    documents, terms = heads.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    return Index(stored, documents or 0, terms or 0)


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of the documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Queries:
    """A chunk of queries over numbered terms: bounded by CHUNK_BYTES."""

    terms: list[np.ndarray]  # of each query, by rising weight
    pairs: list[list[tuple[int, int]]]  # neighbours in that order, smaller number first
    weights: np.ndarray
    k: int


def _pairs(terms: np.ndarray) -> list[tuple[int, int]]:
    return [tuple(sorted((int(a), int(b)))) for a, b in zip(terms[0::2], terms[1::2])]


class Block:
    """The lists of a block's query terms with their impacts."""

    def __init__(self, index_documents: int, index_terms: int, queries: Queries, lengths: np.ndarray, numbers: np.ndarray, docs: list, tfs: list):
        share = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * index_documents) // index_terms
        self.size = len(lengths)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, at, tf in zip(numbers.tolist(), docs, tfs):
            self.lists[number] = at, queries.weights[number] * ((1_000_000_000 * tf) // (1000 * tf + DAMPING * share[at]))

    def joint(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold both terms, and the sums of their impacts."""
        (left, one), (right, two) = self.lists[a], self.lists[b]
        both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        return both.astype(np.int32), one[i] + two[j]


def _largest(values: np.ndarray, k: int) -> int:
    """The k-th largest value; 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def _unpack(batch: pa.RecordBatch, at: int, index: Index, queries: Queries) -> Block:
    lists = batch.column("lists")[at].values

    def arrays(name: str) -> list[np.ndarray]:
        field = lists.field(name)
        edges, values = field.offsets.to_numpy(), field.values.to_numpy().astype(np.int64)
        return [values[a:b] for a, b in zip(edges, edges[1:])]

    lengths = batch.column("lengths")[at].values.to_numpy().astype(np.int64)
    return Block(index.documents, index.terms, queries, lengths, lists.field("number").to_numpy(), arrays("docs"), arrays("tfs"))


def _prepare(rows: DataFrame, index: Index, queries: Queries) -> DataFrame:
    """Adds the maxima of the terms, the intersections of the pairs, and the thresholds that the block vouches for."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    documents, terms = index.documents, index.terms
    added = "maxima array<long>, joint array<struct<a:int, b:int, docs:array<int>, most:long>>, floors array<long>"
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, counts = shared.value, Index(None, documents, terms)
        wanted = sorted({pair for pairs in chunk.pairs for pair in pairs})
        for batch in batches:
            for at in range(batch.num_rows):
                one, block = batch.slice(at, 1), _unpack(batch, at, counts, chunk)
                maxima = {t: int(v.max()) for t, (_, v) in block.lists.items()}
                single = {t: _largest(v, chunk.k) for t, (_, v) in block.lists.items()}
                joint, double = [], {}
                for a, b in wanted:
                    if a in block.lists and b in block.lists:
                        both, sums = block.joint(a, b)
                        if len(both):
                            joint.append({"a": a, "b": b, "docs": both, "most": int(sums.max())})
                            double[a, b] = _largest(sums, chunk.k)
                floors = [max([single.get(int(t), 0) for t in own] + [double.get(p, 0) for p in pairs], default=0) for own, pairs in zip(chunk.terms, chunk.pairs)]
                fields = [pa.array([value], kind) for value, kind in (
                    (list(maxima.values()), pa.list_(pa.int64())),
                    (joint, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.list_(pa.int32())), ("most", pa.int64())]))),
                    (floors, pa.list_(pa.int64())),
                )]
                yield pa.RecordBatch.from_arrays([*one.columns, *fields], [*one.schema.names, "maxima", "joint", "floors"])

    return store(rows.mapInArrow(run, schema), "search-blocks")


def bounds(terms: list[int], pairs: list[tuple[int, int]], maxima: dict[int, int], joint: dict[tuple[int, int], int]) -> list[int]:
    """Largest score the first 0, 1, ... terms can add up to in one document."""
    partner = {a: b for pair in pairs for a, b in (pair, pair[::-1])}
    out, seen = [0], set()
    for term in terms:
        most, other = maxima[term], partner.get(term)
        if other in seen:
            both = max(most, maxima[other], joint.get((min(term, other), max(term, other)), 0))
            out.append(out[-1] - maxima[other] + both)
        else:
            out.append(out[-1] + most)
        seen.add(term)
    return out


def best_of_block(block: Block, own: np.ndarray, pairs: list, maxima: dict, joint: dict, least: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that reach ``least``; ``room`` is all zeros and left so."""
    terms = sorted((int(t) for t in own if int(t) in block.lists), key=maxima.__getitem__)
    bound = bounds(terms, pairs, maxima, joint)
    least = max(least, 1)
    if bound[-1] < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    essential = max(i for i, b in enumerate(bound) if b < least)
    for term in terms[essential:]:
        at, values = block.lists[term]
        room[at] += values
    found = np.flatnonzero(room)
    scores = room[found]
    room[found] = 0
    for i in range(essential, 0, -1):
        stay = scores + bound[i] >= least
        found, scores = found[stay], scores[stay]
        if not len(found):
            break
        at, values = block.lists[terms[i - 1]]
        place = np.minimum(np.searchsorted(at, found), len(at) - 1)
        scores = scores + np.where(at[place] == found, values[place], 0)
    stay = scores >= least
    return found[stay], scores[stay]


def _search(prepared: DataFrame, index: Index, queries: Queries, floors: dict[int, int], kind: str) -> DataFrame:
    """(query, score, id): every block's documents that may be among the best k."""
    shared = prepared.sparkSession.sparkContext.broadcast((queries, floors))
    documents, terms = index.documents, index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, start = shared.value
        counts, least = Index(None, documents, terms), dict(start)
        top: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block, pairs_met = _unpack(batch, at, counts, chunk), batch.column("joint")[at].values
                maxima = dict(zip(block.lists, batch.column("maxima")[at].as_py()))
                joint = dict(zip(zip(pairs_met.field("a").to_pylist(), pairs_met.field("b").to_pylist()), pairs_met.field("most").to_pylist()))
                room, out = np.zeros(block.size, np.int64), ([], [], [])
                for query, (own, pairs) in enumerate(zip(chunk.terms, chunk.pairs)):
                    found, scores = best_of_block(block, own, pairs, maxima, joint, least.get(query, 0), room)
                    if not len(found):
                        continue
                    best = np.sort(np.concatenate([top.get(query, scores[:0]), scores]))[-chunk.k :]
                    top[query] = best
                    if len(best) == chunk.k:
                        least[query] = max(least.get(query, 0), int(best[0]))
                    out[0].append(np.full(len(found), query))
                    out[1].append(scores)
                    out[2].append(found)
                if out[0]:
                    ids = batch.column("ids")[at].values.take(pa.array(np.concatenate(out[2])))
                    arrays = [pa.array(np.concatenate(out[0]), pa.int32()), pa.array(np.concatenate(out[1]), pa.int64()), ids]
                    yield pa.RecordBatch.from_arrays(arrays, ["query", "score", "id"])

    return prepared.mapInArrow(run, f"query int, score long, id {kind}")


def _chunks(items: DataFrame) -> Iterator[list[tuple[object, str, int]]]:
    """Different (item, text) rows with their number of copies, in chunks of about CHUNK_BYTES of text."""
    different = items.groupBy("item", "text").count()
    number = -(-(different.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // CHUNK_BYTES)
    for k in range(number):
        yield [tuple(r) for r in different.filter(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == k).orderBy("item", "text").collect()]


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, by score and id."""
    rows, spark = index.rows, index.rows.sparkSession
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    asked = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    item_kind = asked.schema["item"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    for chunk in _chunks(asked) if index.terms else ():
        result = result.union(_search_chunk(index, chunk, k, kind, item_kind))
    return result


def _search_chunk(index: Index, chunk: list[tuple[object, str, int]], k: int, kind: str, item_kind: str) -> DataFrame:
    spark, numbers = index.rows.sparkSession, {}
    own = [np.unique([numbers.setdefault(w, len(numbers)) for words in ascii_words(body) for w in words]).astype(np.int64) for _, body, _ in chunk]
    known = spark.createDataFrame([(w.decode("utf-8", "surrogatepass"), n) for w, n in numbers.items()], "known string, number int")
    # the terms of a chunk are bounded, so the index is read once and only their lists are shuffled
    lists = index.rows.join(F.broadcast(known), F.col("term") == F.col("known"), "left").filter("term IS NULL OR number IS NOT NULL")
    gathered = store(
        lists.groupBy("block").agg(
            F.max_by("ids", F.col("term").isNull()).alias("ids"), F.max_by("lengths", F.col("term").isNull()).alias("lengths"),
            F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "docs", "tfs"))).alias("lists"),
        ),
        "search-lists",
    )
    holding = np.zeros(len(numbers), np.int64)
    for number, n in gathered.select(F.explode("lists").alias("l")).groupBy("l.number").agg(F.sum(F.size("l.docs"))).collect():
        holding[number] = n
    weights = np.array([weight(index.documents, int(h)) for h in holding], np.int64)
    ordered = [terms[np.lexsort((terms, weights[terms]))] for terms in own]
    queries = Queries(ordered, [_pairs(terms) for terms in ordered], weights, k)
    prepared = _prepare(gathered, index, queries)
    best = prepared.select(F.posexplode("floors").alias("query", "floor")).groupBy("query").agg(F.max("floor"))
    found = _search(prepared, index, queries, dict(best.filter("max(floor) > 0").collect()), kind)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    asked = spark.createDataFrame([(n, item, copies) for n, (item, _, copies) in enumerate(chunk)], f"number int, item {item_kind}, copies long")
    named = ranked.join(asked, F.col("query") == F.col("number")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return named.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
