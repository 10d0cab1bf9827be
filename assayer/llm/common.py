"""Helpers the operators share: stored intermediate tables, words, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import shared_dir

SPACES = r"[\x20\x09-\x0D]+"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` once to the folder all executors share and reads it from there on.

    Later steps start from the files, so a lost executor costs only its own tasks.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    ``edges`` has two columns of one orderable type. Labels spread along the edges and then jump to
    the label of their label, so long chains take few rounds. Every round is an equi-join and a
    minimum with partial sums, its labels are stored, and only one count reaches the driver. Loops,
    repeated edges and an empty table are fine: a node on no edge is not returned; edges with a null
    end are ignored.
    """
    a, b = edges.columns
    clean = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = store(clean.union(clean.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        low = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        near = labels.join(low, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("near")
        )
        root = labels.select(F.col("node").alias("root"), F.col("component").alias("far"))
        stepped = store(
            near.join(root, F.col("near") == F.col("root"), "left").select("node", "old", F.least("near", "far").alias("component")),
            "labels",
        )
        labels = stepped.select("node", "component")
        if not stepped.filter("component <> old").limit(1).count():
            return labels


#: Bytes of a word in lower case, everything else a space. UTF-8 never holds ASCII bytes inside a longer character.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLAB = 1 << 20


def ascii_words(text: str | None) -> Iterator[list[bytes]]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8 in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _SLAB)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
