"""Running values and merged intervals over one and many ranges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import tables
from assayer.operators.ordered import list_parts, place, running, walk


@pytest.fixture(params=[1, 4, 40])
def ranges(spark, request):
    """Number of ranges the rows are sorted into."""
    settings = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, order values repeat, some are null."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.choice([None, *range(40)]), i, rng.randrange(-5, 9)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "key string, place int, id int, amount int").repartition(5)


def _order(row):
    return (row[1] is not None, row[1] or 0, row[2])


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(skewed, inclusive, ranges):
    rows, df = skewed
    out = running(
        df, ["key"], ["place", "id"], number="n", sums={"total": "amount"}, maxima={"top": "amount"},
        inclusive=inclusive,
    )
    found = {r.id: (r.n, r.total, r.top) for r in out.collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        seen = []
        for n, row in enumerate(sorted((r for r in rows if r[0] == key), key=_order), 1):
            upto = seen + [row[3]] if inclusive else list(seen)
            expected[row[2]] = (n, sum(upto), max(upto) if upto else None)
            seen.append(row[3])
    assert found == expected
    assert out.columns == [*df.columns, "n", "total", "top"]


def test_a_key_that_ties_in_its_order_lies_in_many_ranges(spark, ranges):
    df = spark.range(400).select(F.lit(1).alias("key"), F.lit(7).alias("place"), "id", F.lit(2).alias("amount"))
    placed = place(df, ["key"], ["place"])
    assert placed.rows.select("__range").distinct().count() > ranges / 2
    out = walk(placed, number="n", sums={"total": "amount"}).collect()
    assert sorted((r.n, r.total) for r in out) == [(n, 2 * n) for n in range(1, 401)]


def test_running_over_nothing(spark, ranges):
    df = spark.createDataFrame([], "key string, place int, amount int")
    assert running(df, ["key"], ["place"], number="n", sums={"total": "amount"}).collect() == []


def test_running_over_the_whole_table(skewed, ranges):
    rows, df = skewed
    out = running(df, [], ["id"], sums={"total": "amount"})
    total, expected = 0, {}
    for row in sorted(rows, key=lambda r: r[2]):
        total += row[3]
        expected[row[2]] = total
    assert {r.id: r.total for r in out.collect()} == expected


def test_list_parts_are_whole_and_bounded(skewed, ranges):
    rows, df = skewed
    parts = list_parts(df, ["key"], "id", part_rows=11).orderBy("key", "part").collect()
    assert all(len(p.id) <= 11 for p in parts)
    joined = {}
    for part in parts:
        joined.setdefault(part.key, []).extend(part.id)
    assert joined == {key: sorted(r[2] for r in rows if r[0] == key) for key in {r[0] for r in rows}}


def _merge(intervals):
    merged = []
    for start, end in sorted(intervals):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def test_merge_intervals(spark, ranges):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else "cold", s, s + rng.choice([0, 1, 3, 20])) for s in (rng.randrange(300) for _ in range(150))]
    rows += [("fixture", 1, 2), ("fixture", 2, 3), ("fixture", 10, 11)]
    df = spark.createDataFrame(rows, "owner string, start int, end int")
    out = tables.merge_intervals(df, ["owner"])
    found = sorted(tuple(r) for r in out.collect())
    assert found == sorted((k, *i) for k in {r[0] for r in rows} for i in _merge([r[1:] for r in rows if r[0] == k]))
    assert [f[1:] for f in found if f[0] == "fixture"] == [(1, 3), (10, 11)]


def test_dependency_levels(spark):
    nodes = spark.createDataFrame([("lonely",), ("a",)], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x")], "node string, dependency string")
    levels = {r.node: r.level for r in tables.dependency_levels(nodes, edges).collect()}
    assert levels == {"lonely": 0, "a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def _levels(nodes, edges):
    """Levels by peeling, in plain Python."""
    waits = {n: set() for n in nodes} | {n: set() for e in edges for n in e}
    for node, dependency in edges:
        waits[node].add(dependency)
    level, out = 0, dict.fromkeys(waits)
    while free := [n for n, on in waits.items() if not on]:
        for node in free:
            out[node] = level
            del waits[node]
        for on in waits.values():
            on.difference_update(free)
        level += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{a}", f"n{b}") for a in range(60) for b in rng.sample(range(60), rng.choice([0, 1, 1, 1, 2])) if seed % 2 == 0 or b < a]
    got = tables.dependency_levels(spark.createDataFrame([("alone",)], "node string"), spark.createDataFrame(edges, "node string, dependency string"))
    assert {r.node: r.level for r in got.collect()} == _levels(["alone"], edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    stored, own = [], tables.store_table
    monkeypatch.setattr(tables, "store_table", lambda df, purpose: stored.append(purpose) or own(df, purpose))
    chain = spark.range(1, 10_000).select(F.col("id").alias("node"), (F.col("id") - 1).alias("dependency"))
    both = chain.union(spark.createDataFrame([(20_000, 9_999), (20_000, 5_000), (20_001, 20_000), (30_000, 30_001), (30_001, 30_000), (30_002, 30_001)], chain.schema))
    got = tables.dependency_levels(chain.select("node").limit(0), both)
    levels = {r.node: r.level for r in got.collect()}
    assert levels == {k: k for k in range(10_000)} | {20_000: 10_000, 20_001: 10_001, 30_000: None, 30_001: None, 30_002: None}
    assert stored.count("chain-inside") < 40 and stored.count("released") < 10


def test_small_tables(spark):
    empty = spark.createDataFrame([("k", None)], "key string, value int")
    row = tables.stats_summary(empty, ["key"], "value").first()
    assert (row["min"], row["max"], row["mean"]) == (0, 0, 0.0)
    assert tables.average(empty, ["key"], "value").first()["average"] == 0.0
    basket = spark.createDataFrame([("b", 1.005, 2), ("b", 2.0, None)], "basket string, price double, quantity int")
    assert tables.basket_totals(basket, ["basket"], "price", "quantity").first()["total"] == 4.01
    days = spark.range(1).select(
        tables.date_window(F.lit("2026-01-01").cast("date"), F.lit(0)).alias("none"),
        tables.date_window(F.lit("2026-01-31").cast("date"), F.lit(2)).alias("two"),
    ).first()
    assert days["none"] == [] and days["two"] == ["2026-01-31", "2026-02-01"]
