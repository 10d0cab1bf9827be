"""Small table jobs: intervals, date windows, summaries, dependency levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import last_entries
from assayer.operators.ordered import place, walk
from assayer.session import store_table


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the overlapping or touching intervals of each key.

    A row opens an island when it starts after every earlier end. The latest
    opening start seen so far names the island, which is then a partial group-by.
    """
    placed = place(df.select(*keys, start, end).distinct(), keys, [start, end])
    reach = walk(placed, maxima={"__reach": end}, inclusive=False)
    opens = F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))
    islands = walk(placed, reach.withColumn("__open", F.when(opens, F.col(start))), maxima={"__island": "__open"})
    return islands.groupBy(*keys, "__island").agg(F.max(end).alias(end)).select(*keys, F.col("__island").alias(start), end)


def date_window(start: Column, days: Column) -> Column:
    """The ``days`` dates from ``start`` on, as ISO text; empty for zero or fewer."""
    last = F.date_add(start, F.greatest(days, F.lit(1)) - 1)
    dates = F.transform(F.sequence(start, last), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return F.when(days > 0, dates).otherwise(F.array().cast("array<string>"))


def stats_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, maximum and rounded mean per key; zeros where there is no value."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(value), F.lit(0)).alias("min"),
        F.coalesce(F.max(value), F.lit(0)).alias("max"),
        F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias("mean"),
    )


def average(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean per key, 0.0 where there is no value."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("average"))


def basket_totals(df: DataFrame, keys: Sequence[str], price: str, quantity: str) -> DataFrame:
    """Sum of price times quantity (1 when missing) per basket, rounded to cents."""
    amount = F.col(price) * F.coalesce(F.col(quantity), F.lit(1))
    return df.groupBy(*keys).agg(F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("total"))


def parse_query_string(query: Column) -> Column:
    """Query string as a map: decoded, last value of a key wins, a bare name maps to ''."""
    body = F.regexp_replace(query, r"^\?", "")
    parts = F.filter(F.split(body, "&"), lambda part: part != "")

    def decode(text: Column) -> Column:
        return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))

    pairs = F.transform(
        parts,
        lambda part: F.struct(
            decode(F.substring_index(part, "=", 1)).alias("key"),
            decode(F.regexp_extract(part, r"(?s)^[^=]*=(.*)\z", 1)).alias("value"),
        ),
    )
    return F.map_from_entries(last_entries(pairs))


def _weighed(edges: DataFrame) -> DataFrame:
    """One edge per (node, dependency): the level of the node is at least ``least`` and ``steps`` above the dependency's."""
    return edges.groupBy("node", "dependency").agg(F.max("least").alias("least"), F.max("steps").alias("steps"))


def _contract(singles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follows nodes of one dependency to the first that is not one of them; also those that end in a circle.

    Pointers double their reach every round: "at least ``least``, and ``steps`` above" is again of that form
    after another, so a chain of any kind takes the logarithm of its length.
    """
    singles = store_table(singles, "chains")
    most = singles.count()
    on = F.col("n.dependency") == F.col("d.node")
    reach, open_ = 1, singles
    done = singles.limit(0)
    while True:
        # pointers that left the chains are done; the others jump over what their dependency has reached
        inside = open_.alias("n").join(singles.alias("d"), on, "left_semi")
        ended = open_.alias("n").join(singles.alias("d"), on, "left_anti")
        inside, done = store_table(inside, "chain-inside"), store_table(done.unionByName(ended), "chain-ends")
        if reach > most or inside.isEmpty():
            return done, inside
        every = done.unionByName(inside)
        open_ = inside.alias("n").join(every.alias("d"), on).select(
            "n.node", "d.dependency", F.greatest("n.least", F.col("d.least") + F.col("n.steps")).alias("least"),
            (F.col("n.steps") + F.col("d.steps")).alias("steps"),
        )
        reach *= 2


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node: 0 without dependencies, else one above its deepest one.

    ``nodes(node)`` and ``edges(node, dependency)``. Every round releases the nodes
    that wait for nothing and drops the edges to them, and then contracts the
    chains: a node that waits for one other follows it, by pointers that double
    their reach, and is left out until the end. What is left are nodes that wait
    for several others, so the rounds are the longest path among those. Every
    table is stored, and only counts reach the driver. Ordering by (level, node)
    is a valid dependency order. Nodes on a cycle, or behind one, are never
    released: their level is null.
    """
    own = edges.select("node", "dependency").distinct()
    everyone = store_table(nodes.select("node").union(own.select("node")).union(own.select("dependency")).distinct(), "nodes")
    links = store_table(own.withColumns({"least": F.lit(0).cast("long"), "steps": F.lit(1).cast("long")}), "links")
    waiting = everyone.withColumn("floor", F.lit(0).cast("long"))
    levels, chains = waiting.select("node", F.col("floor").alias("level")).limit(0), []
    while True:
        counts = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        marked = store_table(waiting.join(counts, "node", "left"), "waiting")
        free = store_table(marked.filter("n IS NULL").select("node", F.col("floor").alias("level")), "released")
        levels = levels.unionByName(free)
        waiting = marked.filter("n IS NOT NULL").drop("n")
        met = links.join(free.select(F.col("node").alias("dependency"), "level"), "dependency", "left")
        risen = met.filter("level IS NOT NULL").groupBy("node").agg(F.max(F.greatest("least", F.col("level") + F.col("steps"))).alias("risen"))
        waiting = store_table(waiting.join(risen, "node", "left").select("node", F.greatest("floor", "risen").alias("floor")), "waiting")
        links = store_table(met.filter("level IS NULL").select("node", "dependency", "least", "steps"), "links")

        alone = links.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
        singles = links.join(alone, "node", "left_semi").join(waiting, "node").select(
            "node", "dependency", F.greatest("least", "floor").alias("least"), "steps"
        )
        followed, circling = _contract(singles)
        if free.isEmpty() and followed.isEmpty():
            break
        if not followed.isEmpty() or not circling.isEmpty():
            chains.append(followed)
            gone = followed.select("node").union(circling.select("node"))
            waiting = store_table(waiting.join(gone, "node", "left_anti"), "waiting")
            over = followed.select(F.col("node").alias("dependency"), F.col("dependency").alias("to"), F.col("least").alias("l"), F.col("steps").alias("s"))
            kept = links.join(gone, "node", "left_anti").join(over, "dependency", "left").select(
                "node", F.coalesce("to", "dependency").alias("dependency"),
                F.greatest("least", F.col("l") + F.col("steps")).alias("least"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"),
            )
            links = store_table(_weighed(kept), "links")
    for chain in reversed(chains):
        levels = store_table(levels, "levels")
        ends = levels.select(F.col("node").alias("dependency"), "level")
        after = chain.join(ends, "dependency").select("node", F.greatest("least", F.col("level") + F.col("steps")).alias("level"))
        levels = levels.unionByName(after)
    return everyone.join(levels, "node", "left").select("node", F.col("level").cast("int").alias("level"))
