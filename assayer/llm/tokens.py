"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram tokenizer takes the cheapest cutting of a pre-token into vocabulary pieces. The forward
score of a prefix depends on the prefix alone, so the distinct pre-tokens of a batch of documents go
into one trie and every node, that is every shared prefix, is scored once. A node keeps its cost and
number of tokens; a terminal's number is the count of its pre-token, and a document's count is the sum
over its pre-tokens. The trie is worked level by level with arrays: at each level only the pieces
still alive at a node are followed through the vocabulary's own trie. Terminal counts are remembered
by the worker, up to ``REMEMBERED``, and reused by later batches.

Costs are whole numbers, so results do not depend on rounding: a piece of several bytes costs
``1000 ln(rank + 2)``, a single byte as much as the last rank; among equal costs fewer tokens win.

Defined cases: a null or empty text has no pre-tokens and count 0; every byte is a piece, so any text
can be cut; repeated rows are counted each; an empty table gives no rows. Whole texts are counted and
the trie of a batch holds at most ``BATCH_CHARS`` characters beyond one document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 1 << 22
REMEMBERED = 400_000


class Vocabulary:
    """Pieces as a trie in arrays: an edge is parent * 256 + byte, sorted; nodes without a piece cost -1."""

    _loaded: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        last = max(ranks.values(), default=0)
        costs = {piece: round(1000 * np.log((last if len(piece) == 1 else rank) + 2)) for piece, rank in ranks.items()}
        for byte in range(256):
            costs.setdefault(bytes([byte]), round(1000 * np.log(last + 2)))
        ids, edges, self.cost = {b"": 0}, {}, [-1]
        for piece in sorted(costs):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in ids:
                    ids[piece[:n]] = len(self.cost)
                    edges[ids[piece[: n - 1]] * 256 + piece[n - 1]] = len(self.cost)
                    self.cost.append(-1)
            self.cost[ids[piece]] = costs[piece]
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.cost = np.array(self.cost, np.int64)
        self.pattern, self.known = regex.compile(pattern), {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        """The worker's own copy of a vocabulary file with lines of base64 piece and rank."""
        if (path, pattern) not in cls._loaded:
            with open(path, "rb") as lines:
                cls._loaded[path, pattern] = cls({base64.b64decode(p): int(r) for p, r in map(bytes.split, lines)}, pattern)
        return cls._loaded[path, pattern]

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next vocabulary node of each state, 0 where there is none."""
        wanted = states * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.targets[at], 0)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token: forward scores over the trie of all of them."""
        data = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        order = sorted(range(len(data)), key=data.__getitem__)
        flat = np.frombuffer(b"".join(data[k] for k in order), np.uint8)
        size = np.array([len(data[k]) for k in order], np.int64)
        start = np.cumsum(size) - size
        terminal = np.zeros(len(order), np.int64)
        # per level: node of every pre-token still in the trie, and best (cost, tokens) of every node
        node, words = np.zeros(len(order), np.int64), np.flatnonzero(size > 0)
        best = {0: (np.zeros(1, np.int64), np.zeros(1, np.int64))}
        # pieces under way: the level they began on, their ancestor there, the node they reached here, their state
        alive = (np.empty(0, np.int64),) * 4
        depth = 0
        above = np.zeros(len(words), np.int64)
        while len(words):
            byte = flat[start[words] + depth].astype(np.int64)
            edge = above * 256 + byte
            first = np.concatenate([[True], edge[1:] != edge[:-1]])  # sorted pre-tokens: a node's are neighbours
            here = np.cumsum(first) - 1
            parent, label = above[first], byte[first]
            # every piece under way at the parent, and a new one that begins there, take the node's byte
            began, ancestor, at, state = alive
            by_node = np.argsort(at, kind="stable")
            began, ancestor, at, state = began[by_node], ancestor[by_node], at[by_node], state[by_node]
            low, high = np.searchsorted(at, parent, "left"), np.searchsorted(at, parent, "right")
            many = high - low
            pick = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            child = np.repeat(np.arange(len(parent)), many)
            began = np.concatenate([began[pick], np.full(len(parent), depth)])
            ancestor = np.concatenate([ancestor[pick], parent])
            state = np.concatenate([state[pick], np.zeros(len(parent), np.int64)])
            child = np.concatenate([child, np.arange(len(parent))])
            state = self.step(state, label[child])
            live = state > 0
            began, ancestor, child, state = began[live], ancestor[live], child[live], state[live]
            ends = np.flatnonzero(self.cost[state] >= 0)
            cost, tokens = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
            for level in np.unique(began[ends]).tolist():
                mine = began[ends] == level
                cost[mine], tokens[mine] = best[level][0][ancestor[ends[mine]]], best[level][1][ancestor[ends[mine]]]
            cost += self.cost[state[ends]]
            tokens += 1
            rank = np.lexsort((tokens, cost, child[ends]))
            lead = rank[np.concatenate([[True], np.diff(child[ends][rank]) != 0])]
            best[depth + 1] = (cost[lead], tokens[lead])
            for level in set(best) - set(np.unique(began).tolist()) - {depth + 1}:
                del best[level]
            alive = (began, ancestor, child, state)
            depth += 1
            ended = size[words] == depth
            terminal[words[ended]] = tokens[lead][here[ended]]
            words, above = words[~ended], here[~ended]
        out = np.zeros(len(order), np.int64)
        out[order] = terminal
        return out

    def documents(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(pre-tokens, distinct pre-tokens, tokens) of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            self.known.update(zip(new, self.count(new).tolist()))
        return [(len(c), len(set(c)), sum(map(self.known.__getitem__, c))) for c in cut]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary.of(vocabulary, pattern)
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < BATCH_CHARS):
                    chars, end = chars + len(texts[end] or ""), end + 1
                found = np.array(own.documents(texts[at:end]), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *map(pa.array, found.T.copy())], ["doc_id", "n_pretokens", "n_distinct", "n_tokens"])
                at = end

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = rows.select("doc_id").schema
    for name in ("n_pretokens", "n_distinct", "n_tokens"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)
