"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary naive Bayes classifier over hashed byte n-grams
tells the languages with that bit set from the others; its answer is a mean log ratio per n-gram of
the text. A language's loss is the weighted sum of the logistic losses of the bits against its
codeword, a bit weighing more the better its classifier did on the training rows. The codeword with
the smallest loss wins. The result is flagged ambiguous if the runner-up is close, or if the answers fit
no codeword well: the smallest loss is above all but ``LOOSE`` of those of the training texts.

Training reads a bounded sample, at most about ``sample_docs`` different whole texts in all (a seeded
choice, the same share of every language above an equal floor), reduced in Spark to one number per
language, fold and n-gram bucket: a table of fixed width, whatever the number of tasks. The numbers are
whole, so their sums do not depend on any order. Prediction reads whole texts and nothing but the text.

Defined cases: a null text or one without letters is ``und`` with score 0 and ambiguous; rows with a
null language teach nothing; equal texts of a language teach once; with no labelled rows everything is
``und``; with one language everything with letters is that language. Very long texts are read in slabs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import store

WIDTH = 1 << 15  # n-gram buckets
GRAMS = (1, 2, 3, 4)
SAMPLE_DOCS = 20_000  # bound of the training sample
MARGIN = 0.1  # ambiguous below this distance between the best two probabilities
UNDETERMINED = "und"
LETTER = r"\p{L}"
LOOSE = 0.005  # share of the training texts whose answers would be flagged as fitting no codeword
_UNIT = 1 << 32  # a text's n-gram shares add up to this whole number, about
_SLAB = 1 << 20


def codewords(count: int, seed: int = 5) -> np.ndarray:
    """A row of 0 and 1 for each language: all distinct splits for few languages, seeded splits for many."""
    if count <= 7:
        splits = [bits for bits in itertools.product((0, 1), repeat=count) if bits[0] == 1 and 0 in bits]
        return np.array(splits or [(1,) * count], np.int8).T.copy()
    rng, length = np.random.default_rng(seed), max(16, 10 * int(np.ceil(np.log2(count))))
    best = max((rng.permuted(np.arange(count)[:, None] % 2 * np.ones((1, length), np.int8), axis=0) for _ in range(20)), key=lambda c: min((c[i] != c[:i]).sum(1).min() for i in range(1, count)))
    return best.astype(np.int8)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the lower-cased text's bytes, in arrays of bounded size."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    for at in range(0, len(data), _SLAB):
        part, rolling = data[at : at + _SLAB + GRAMS[-1] - 1], np.uint32(0)
        for n in range(1, GRAMS[-1] + 1):
            if len(part) < n:
                break
            count = min(len(part) - n + 1, _SLAB)
            rolling = (rolling[:count] if n > 1 else np.zeros(count, np.uint32)) * np.uint32(0x01000193) + part[n - 1 : n - 1 + count] + np.uint32(1)
            mixed = (rolling ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield mixed >> np.uint32(17)


def gram_counts(text: str) -> np.ndarray:
    return sum((np.bincount(b, minlength=WIDTH) for b in buckets(text)), np.zeros(WIDTH, np.int64))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    ratios: np.ndarray  # buckets x bits
    shift: np.ndarray  # bits
    scale: np.ndarray  # bits
    weights: np.ndarray  # bits
    limit: float = np.inf  # a larger loss fits no codeword

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Answer of each bit's classifier per text: positive for set."""
        at = np.flatnonzero(counts)
        weight = np.sqrt(counts[at])  # common n-grams of a long text count less than their number
        return (weight @ self.ratios[at] / weight.sum() - self.shift) * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted sum of the bits' logistic losses against each codeword."""
        signs = 2 * self.codes.astype(float) - 1
        return (np.logaddexp(0, -signs * margins) * self.weights).sum(1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        losses = self.losses(margins)
        likely = np.exp(losses.min() - losses)
        likely /= likely.sum()
        order = np.argsort(-likely, kind="stable")
        best = likely[order[0]]
        close = len(order) > 1 and best - likely[order[1]] < MARGIN
        return self.languages[order[0]], float(best), bool(close or losses.min() > self.limit)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Fits the bit classifiers on a bounded sample of (text, lang) rows; None if there are none."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = dict(rows.groupBy("lang").count().orderBy("lang").collect())  # one row a language
    if not sizes:
        return None
    share = max(1, sample_docs // len(sizes))
    wanted = F.create_map(*[F.lit(x) for lang_, n in sizes.items() for x in (lang_, min(1.0, share / n))])
    # rows that share an id are drawn apart; equal texts teach once, however many of them are drawn
    part = F.pmod(F.xxhash64("text", "key", F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.filter(part < wanted[F.col("lang")]).select("text", "lang").dropDuplicates()
    sample = store(drawn.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(13)), F.lit(2)).cast("int")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for body, language, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.sqrt(gram_counts(body))
                at = held.setdefault((language, fold), np.zeros(WIDTH + 1, np.int64))
                at[:WIDTH] += np.round(own * (_UNIT / max(own.sum(), 1))).astype(np.int64)
                at[WIDTH] += 1  # the number of texts
        for (language, fold), numbers in held.items():
            at = np.flatnonzero(numbers)
            columns = [pa.array([language] * len(at), pa.string()), pa.array([fold] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(numbers[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "fold", "bucket", "n"])

    # at most two folds of WIDTH + 1 rows a language reach the driver
    summed = sample.mapInArrow(count, "lang string, fold int, bucket int, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow().to_pandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    numbers = np.zeros((2, len(languages), WIDTH + 1))
    numbers[found["fold"], found["lang"].map(languages.index), found["bucket"]] = found["n"]
    table, docs = numbers[:, :, :WIDTH] / _UNIT, numbers[:, :, WIDTH]
    codes = codewords(len(languages))
    # weights: how far apart a fold's mean texts lie under the other fold's ratios
    answers = np.zeros((len(languages), codes.shape[1]))
    for fold in (0, 1):
        if docs[fold].sum() and docs[1 - fold].sum():
            ratios = _ratios(table[1 - fold], codes)
            means = table[fold] / np.maximum(docs[fold], 1)[:, None]
            answers += means @ ratios
    both = table.sum(0)
    ratios = _ratios(both, codes)
    centres = both / np.maximum(docs.sum(0), 1)[:, None] @ ratios
    low = np.array([centres[codes[:, b] == 0, b].max(initial=-np.inf) for b in range(codes.shape[1])])
    high = np.array([centres[codes[:, b] == 1, b].min() for b in range(codes.shape[1])])
    low = np.where(np.isfinite(low), low, high - 1)
    gap = np.maximum(high - low, 1e-6)
    signs = 2 * codes.astype(float) - 1
    held_out = (signs * (answers / 2 - (high + low) / 2) > 0).mean(0) if docs.min() > 0 else np.ones(codes.shape[1])
    weights = np.maximum(held_out, 0.1)
    return _with_limit(Model(languages, codes, ratios, (high + low) / 2, 4.0 / gap, weights), sample)


def _with_limit(model: Model, sample: DataFrame) -> Model:
    """The model with the loss that all but LOOSE of the sample's texts with letters stay below."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"loss": [shared.value.losses(shared.value.margins(gram_counts(body))).min() for body in frame["text"]]})

    losses = sample.filter(F.col("text").rlike(LETTER)).select("text").mapInPandas(run, "loss double")
    limit = losses.agg(F.percentile("loss", F.lit(1.0 - LOOSE))).first()[0]
    return replace(model, limit=np.inf if limit is None else float(limit))


def _ratios(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's share among the languages with and without each bit."""
    share = (table + 1e-7 * max(table.sum(), 1.0)) / (table.sum(1, keepdims=True) + 1e-7 * WIDTH * max(table.sum(), 1.0))
    out = []
    for bits in codes.T:
        with_bit, without = share[bits == 1], share[bits == 0]
        out.append(np.log(with_bit.mean(0)) - (np.log(without.mean(0)) if len(without) else 0.0))
    return np.stack(out, axis=1)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` and ``ambiguous``, from the text alone."""
    letters: Column = F.coalesce(F.col(text).rlike(LETTER), F.lit(False))
    rows = docs.select(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)], F.when(letters, F.col(text)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed width times the bits of the codewords

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for frame in frames:
            found = [
                (UNDETERMINED, 0.0, True) if body is None or fitted is None else fitted.decode(fitted.margins(gram_counts(body)))
                for body in frame["text"]
            ]
            out = frame.drop(columns="text")
            out[["lang_pred", "score", "ambiguous"]] = pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous"], index=out.index)
            yield out

    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    # kept columns pass through pandas as text, which keeps nulls and large numbers as they are
    kinds = docs.select(*keep).schema
    return rows.mapInPandas(run, schema).select(*[F.col(f"k{i}").cast(kinds[i].dataType).alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "ambiguous")
