"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are the stated query set: they are taken in blocks of bounded size, and each block is
held against all documents. Per block:

1. one pass over all whole texts finds the items' word n-grams ("seeds") in the documents and stores
   their places; nothing is shuffled but the seeds' document counts;
2. of each item's seeds the rarer ones are marked: those no more frequent than the quantile
   ``rare_share`` of the item's seeds that occur at all. The measure is relative to the item, so an
   item copied into half the corpus keeps its seeds too;
3. documents with enough different rare seeds of an item near each other, or with as many seeds of any
   kind as replaced and dropped words must leave at ``threshold``, are read again and aligned with
   it: local alignment of words, one point a match, one off a mismatch or gap, over the item's number
   of words. Copies that were cut, edited or paraphrased in part keep most of the score.

Words are runs of letters, digits and underscores in lower case; characters of scripts that are written
without spaces are words of their own. Defined cases: null or empty texts and items match nothing; an
item of fewer words than a seed is one seed, of one word it only matches texts that are that word; an
item asks for no more different seeds than it has; repeated rows are reported once per (doc_id, item);
a null doc_id is an id like any other; an empty table on either side gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import store

ITEM_WORDS = 400_000  # words of the items held in memory at once: the bound of what every task gets

# Thai to Lao, Myanmar, Khmer, radicals, kana and Han, which need no spaces between words.
_UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_PLACES = T.ArrayType(T.IntegerType())


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Seeds:
    """The n-grams of one block of items, with a number each; picklable and of bounded size."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.n, self.vocabulary = n, {}
        self.items = []
        for item, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if found:
                self.items.append((item, np.array(found, np.int64)))
        self.base = len(self.vocabulary) + 1
        self.lengths = np.array([len(found) for _, found in self.items], np.int64)
        self.sizes = np.minimum(self.lengths, n)  # words of an item's seeds
        coded = [np.unique(self.code(found, size)) for (_, found), size in zip(self.items, self.sizes.tolist())]
        # the seeds of each size are numbered after those of the smaller ones
        self.codes, self.starts, total = {}, {}, 0
        for size in np.unique(self.sizes).tolist():
            self.codes[size], self.starts[size] = np.unique(np.concatenate([c for c, s in zip(coded, self.sizes) if s == size])), total
            total += len(self.codes[size])
        self.count = total
        own = [self.starts[size] + np.searchsorted(self.codes[size], grams) for grams, size in zip(coded, self.sizes.tolist())]
        seed, item = np.concatenate([[], *own]).astype(np.int64), np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.argsort(seed, kind="stable")
        # the items of seed s are owners[first[s] : first[s + 1]]
        self.owners, self.first = item[order], np.searchsorted(seed[order], np.arange(total + 1))
        self.kinds = np.array([len(g) for g in own], np.int64)

    def code(self, found: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` words; negative if it holds a word no item has. Exact while base**size fits in 63 bits."""
        count = len(found) - size + 1
        out, known = np.zeros(max(count, 0), np.int64), np.ones(max(count, 0), bool)
        for k in range(size if count > 0 else 0):
            out = out * self.base + found[k : k + count]
            known &= found[k : k + count] > 0
        return np.where(known, out, -1)

    def find(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of a text, places of its seeds, and the seeds' numbers."""
        own = words(text)
        coded = np.fromiter((self.vocabulary.get(w, 0) for w in own), np.int64, len(own))
        places, seeds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, codes in self.codes.items():
            if size == 1 and len(own) > 1:
                continue  # a word alone is no copy of an item
            mine = self.code(coded, size)
            at = np.flatnonzero(mine >= 0)
            seed = np.minimum(np.searchsorted(codes, mine[at]), len(codes) - 1)
            hit = codes[seed] == mine[at]
            places.append(at[hit])
            seeds.append(seed[hit] + self.starts[size])
        at, seed = np.concatenate(places), np.concatenate(seeds)
        order = np.argsort(at, kind="stable")
        return own, at[order], seed[order]

    def rare(self, counts: dict[int, int], share: float) -> np.ndarray:
        """Which owners hold their seed as a rare one, by the number of documents of each seed."""
        held = np.array([counts.get(s, 0) for s in range(self.count)], np.int64)
        held = np.repeat(held, np.diff(self.first))
        out = np.zeros(len(held), bool)
        order = np.argsort(self.owners, kind="stable")
        for places in np.split(order, np.cumsum(self.kinds)[:-1]) if len(order) else ():
            some = places[held[places] > 0]  # a seed in no document finds nothing and says nothing on the others
            if len(some):
                out[some] = held[some] <= np.quantile(held[some], share, method="higher")
        return out

    def _places(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each owner of each of the seeds: which of them, and the place in ``owners``."""
        number = self.first[seed + 1] - self.first[seed]
        which = np.repeat(np.arange(len(seed)), number)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + self.first[seed][which]

    def passages(self, at: np.ndarray, seed: np.ndarray, rare: np.ndarray, least: int, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item, from, to) word spans in which an item's different seeds lie near each other: enough rare ones, or many.

        An edit of one word changes as many seeds as a seed has words and takes two points, so a copy at
        ``threshold`` has ``many`` left.
        """
        need = np.minimum(least, self.kinds)
        many = np.maximum(need, self.kinds - self.sizes * np.floor((1 - threshold) * self.lengths / 2 + 1e-9).astype(np.int64))
        _, place = self._places(np.unique(seed))
        items, which = np.unique(self.owners[place], return_inverse=True)
        enough = np.bincount(which, rare[place], len(items)) >= need[items]
        chosen = items[enough | (np.bincount(which, minlength=len(items)) >= many[items])]
        if not len(chosen):
            return
        which, place = self._places(seed)
        mine = np.isin(self.owners[place], chosen)
        which, place = which[mine], place[mine]
        order = np.argsort(self.owners[place], kind="stable")
        which, place = which[order], place[order]
        edges = np.searchsorted(self.owners[place], [chosen, chosen + 1])
        for item, a, b in zip(chosen.tolist(), *edges.tolist()):
            own = slice(a, b)
            found = list(zip(at[which[own]].tolist(), seed[which[own]].tolist(), rare[place[own]].tolist()))
            reach = 2 * int(self.lengths[item])
            for some, wanted in (([f for f in found if f[2]], need[item]), (found, many[item])):
                yield from ((item, a, b) for a, b in self._runs(some, wanted, reach))

    def _runs(self, found: list[tuple[int, int, bool]], wanted: int, reach: int) -> Iterator[tuple[int, int]]:
        run = found[:1]
        for place in [*found[1:], None] if found else ():
            if place is not None and place[0] - run[-1][0] <= reach:
                run.append(place)
                continue
            if len({s for _, s, _ in run}) >= wanted:
                yield max(0, run[0][0] - reach), run[-1][0] + self.n + reach
            run = [place]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (+1 match, -1 mismatch, -1 gap) and where it ends in the passage."""
    along = np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, 1, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + along) - along  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most about ITEM_WORDS words; a block is what reaches the driver at once."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).dropDuplicates()
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")))).first()[0] or 0
    number = -(-total // ITEM_WORDS)
    for k in range(number):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == k).orderBy("item", "text").collect()]


def matches(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, rare_share: float = 0.6, least_seeds: int = 2, threshold: float = 0.5,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score): items whose alignment with a document reaches ``threshold``."""
    # ids pass through pandas as text, which keeps nulls and large numbers as they are
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    ids, result = rows.select("doc_id").schema, None
    id_kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType
    kind = benchmark.select(F.col(item_id).alias("item_id")).schema["item_id"].dataType
    for block in _blocks(benchmark, item_id, item_text):
        found = _match_block(rows, ids, Seeds(block, n), rare_share, least_seeds, threshold, kind)
        result = found if result is None else result.union(found)
    if result is None:
        result = rows.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("score")).limit(0)
    return result.groupBy(F.col("doc_id").cast(id_kind).alias("doc_id"), "item_id").agg(F.max("score").alias("score"))


def _match_block(rows: DataFrame, ids: T.StructType, seeds: Seeds, rare_share: float, least: int, threshold: float, kind: T.DataType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(seeds)  # at most ITEM_WORDS words

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for frame in frames:
            hits = [block.find(t)[1:] for t in frame["text"]]
            some = [k for k, h in enumerate(hits) if len(h[0])]
            if some:
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[some], "at": [hits[k][0].tolist() for k in some], "seed": [hits[k][1].tolist() for k in some]})

    hits = store(rows.mapInPandas(find, T.StructType([*ids, T.StructField("at", _PLACES), T.StructField("seed", _PLACES)])), "seed-hits")
    counts = dict(hits.select(F.explode(F.array_distinct("seed")).alias("s")).groupBy("s").count().collect())  # one row a seed of the block
    rare = rows.sparkSession.sparkContext.broadcast(seeds.rare(counts, rare_share))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            some = [any(True for _ in shared.value.passages(np.array(a), np.array(s), rare.value, least, threshold)) for a, s in zip(frame["at"], frame["seed"])]
            yield frame.loc[np.array(some, bool), ["doc_id"]]

    chosen = store(hits.mapInPandas(choose, hits.select("doc_id").schema).distinct(), "candidates")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        names = [item for item, _ in block.items]
        for frame in frames:
            out = {"doc_id": [], "item_id": [], "score": []}
            for row, text in enumerate(frame["text"]):
                own, at, seed = block.find(text)
                coded = np.fromiter((block.vocabulary.get(w, 0) for w in own), np.int64, len(own))
                for item, a, b in block.passages(at, seed, rare.value, least, threshold):
                    target = block.items[item][1]
                    value = align(target, coded[a:b])[0] / len(target)
                    if value >= threshold:
                        out["doc_id"].append(frame["doc_id"].iloc[row])
                        out["item_id"].append(names[item])
                        out["score"].append(value)
            if out["score"]:
                yield pd.DataFrame(out)

    again = rows.join(chosen.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return again.mapInPandas(score, rows.select("doc_id").schema.add("item_id", kind).add("score", "double"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Documents that hold no test item, with their own columns; rows that share an id share its fate."""
    found = matches(docs, benchmark, doc_id=doc_id, text=text, **settings).select(F.col("doc_id").alias("leaked")).distinct()
    bad = store(found, "leaked")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("leaked")), "left_anti").select("row.*")
