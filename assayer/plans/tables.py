"""Intervals, windows of dates, summaries, paths, query strings, dependency levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import keys, paths
from assayer.operators import tables
from assayer.plans.registry import derive, plain, query

_INTERVALS = """
SELECT l_suppkey AS owner, (l_orderkey * 7 + l_partkey) % 20000 AS start, (l_orderkey * 7 + l_partkey) % 20000 + CAST(l_quantity AS BIGINT) AS end
FROM {lineitem}"""


@query(
    "X01_merge_intervals",
    f"""SELECT owner, min("start") AS "start", max("end") AS "end" FROM (
          SELECT *, sum(opens) OVER (PARTITION BY owner ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY owner ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                      THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT * FROM {plain(_INTERVALS)})))
        GROUP BY owner, island""",
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_intervals(derive(spark, sf_dir, _INTERVALS), ["owner"])


_STARTS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_custkey % 5 - 1 AS INT) AS days FROM {orders}"


@query(
    "X02_date_window",
    f"""SELECT o_orderkey, array_to_string(list_transform(range(0, greatest(days, 0)), lambda i: strftime(first_day + CAST(i AS INT), '%Y-%m-%d')), ',') AS dates
        FROM {plain(_STARTS)}""",
)
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = tables.date_window(F.col("first_day"), F.col("days"))
    return derive(spark, sf_dir, _STARTS).select("o_orderkey", F.array_join(dates, ",").alias("dates"))


_VALUES = "SELECT l_suppkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_quantity END AS quantity FROM {lineitem}"


@query(
    "X03_stats_summary",
    f"""SELECT l_suppkey, coalesce(min(quantity), 0) AS min, coalesce(max(quantity), 0) AS max, coalesce(round(avg(quantity), 2), 0) AS mean
        FROM {plain(_VALUES)} GROUP BY l_suppkey""",
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stats_summary(derive(spark, sf_dir, _VALUES), ["l_suppkey"], "quantity")


@query(
    "X04_average",
    f"SELECT l_suppkey, coalesce(round(avg(quantity), 8), 0) AS average FROM {plain(_VALUES)} GROUP BY l_suppkey",
)
def average(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.average(derive(spark, sf_dir, _VALUES), ["l_suppkey"], "quantity")
    return table.select("l_suppkey", F.round("average", 8).alias("average"))


_BASKETS = "SELECT l_orderkey, l_extendedprice AS price, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS quantity FROM {lineitem}"


@query("X05_basket_totals", f"SELECT l_orderkey, round(sum(price * coalesce(quantity, 1)), 2) AS total FROM {plain(_BASKETS)} GROUP BY l_orderkey")
def basket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.basket_totals(derive(spark, sf_dir, _BASKETS), ["l_orderkey"], "price", "quantity")


_MESSY = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/../../' || host || '/./b//c/../d' WHEN 1 THEN host || '/x/y/../../..' WHEN 2 THEN ''
       ELSE './/' || host || '/../../z/' END AS path, host
FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host FROM {pages})"""


@query(
    "X06_normalize_path",
    f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || host || '/b/d' WHEN 1 THEN '/' WHEN 2 THEN '/' ELSE '/z' END AS path FROM {plain(_MESSY)}""",
)
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _MESSY).select("page_id", paths.normalize_path(F.col("path")).alias("path"))


_QUERIES = """
SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS own FROM {pages}"""


@query(
    "X07_parse_query",
    f"""SELECT page_id, string_split(part, '=')[1] AS key, coalesce(string_split(part, '=')[2], '') AS value
        FROM (SELECT page_id, unnest(string_split(own, '&')) AS part FROM {plain(_QUERIES)}) WHERE part <> ''
        UNION ALL SELECT page_id, unnest(['q', 'é b', 'flag', 'bad']), unnest(['last=' || page_id, 'x y!', '', '%zz']) FROM pages""",
)
def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.lit("&q=first&&%C3%A9+b=x+y%21&flag&bad=%zz&q=last="), F.col("page_id").cast("string"))
    text = F.concat(F.lit("?"), F.col("own"), tail)
    return derive(spark, sf_dir, _QUERIES).select("page_id", F.explode(tables.parse_query_string(text)))


@query(
    "X08_cache_key",
    """SELECT doc_id, array_to_string(list_transform(string_split(payload, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c
         WHEN unicode(c) < 65536 THEN chr(92) || 'u' || printf('%04x', unicode(c))
         ELSE chr(92) || 'u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || chr(92) || 'u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END), '') AS cache_key
       FROM (SELECT doc_id, '{"lang":' || to_json(lang) || ',"source":' || to_json(source) || ',"text":' || to_json(text) || '}' AS payload FROM documents)""",
)
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derive(spark, sf_dir, "SELECT doc_id, text, source, lang FROM {documents}")
    payload = F.create_map(F.lit("text"), F.col("text"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return docs.select("doc_id", keys.ascii_json(keys.canonical_json_map(payload)).alias("cache_key"))


_NODES = "SELECT 'p' || CAST(p_partkey AS STRING) AS node FROM {part}"
_EDGES = """
SELECT 'p' || CAST(p_partkey AS STRING) AS node, 'p' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS dependency FROM {part} WHERE p_partkey > 0
UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'p' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) FROM {part} WHERE p_partkey > 0
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey + 1 - 2 * (s_suppkey % 2) AS STRING) FROM {supplier}"""


@query(
    "X10_dependency_levels",
    """SELECT 'p' || p_partkey AS node, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS INT) AS level FROM part
       UNION ALL SELECT 's' || s_suppkey, NULL FROM supplier""",
)
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dependency_levels(derive(spark, sf_dir, _NODES), derive(spark, sf_dir, _EDGES))
