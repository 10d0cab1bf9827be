"""Streaming forms, run over the given tables arriving as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from assayer.operators.latest import with_run_key
from assayer.operators.scoring import derive_metrics
from assayer.operators.scrubbing import index_registry
from assayer.plans import inputs
from assayer.plans.logs import _TURNS as TURNS
from assayer.plans.planning import _CAP as CAP
from assayer.plans.registry import derive, plain, query
from assayer.plans.scoring import AGGREGATES_SQL, flat
from assayer.plans.stores import _NEWEST as NEWEST
from assayer.plans.stores import _SAVES as SAVES
from assayer.plans.trees import redact_sql
from assayer.session import shared_dir
from assayer.streaming import edits
from assayer.streaming import runs as streams

_ARRIVALS = 4


def _play(rows: DataFrame, place: str, purpose: str, sink: Callable[[DataFrame, str, str], DataStreamWriter]) -> str:
    """Lets a table arrive as compressed JSON lines in the order of ``place`` and streams each arrival.

    The query stops and resumes from its checkpoint between arrivals, so each
    arrival is one micro-batch however many files it has.
    """
    spark = rows.sparkSession
    folder, out = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-out")
    for arrival in range(_ARRIVALS):
        rows.filter(F.expr(place) == arrival).write.mode("append").option("compression", "gzip").json(folder)
        arriving = streams.stream_runs(spark, folder, rows.schema)
        sink(arriving, out, f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return out


def _to_parquet(stream: DataFrame, out: str, state: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, inputs.RUNS).withColumn("finished_at", F.col("finished_at").cast("string"))


_BY_DAY = "CAST(least(3, floor((CAST(substring(finished_at, 9, 2) AS INT) - 1) / 8)) AS INT)"


@query("T01_stream_runs", f"SELECT event_id, task_id, agent, passed, round(score, 10) AS score FROM {plain(inputs.RUNS)}")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _play(_runs(spark, sf_dir), "event_id % 4", "stream-runs", _to_parquet)
    return spark.read.parquet(out).select("event_id", "task_id", "agent", "passed", F.round("score", 10).alias("score"))


@query("T02_last_wins", f"SELECT task_id, agent, created_at, score FROM {plain(SAVES)} QUALIFY {NEWEST}")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = with_run_key(derive(spark, sf_dir, SAVES))
    out = _play(
        saves, "CAST(score AS BIGINT) % 4", "stream-saves",
        lambda stream, path, state: streams.upsert(stream, path, state, ["run_key"], ["created_at", "score"], merge_every=3),
    )
    return streams.read_upserted(spark, out, ["run_key"], ["created_at", "score"]).select("task_id", "agent", "created_at", "score")


@query(
    "T02_first_wins",
    f"""SELECT task_id, agent, created_at, score FROM {plain(SAVES)}
        QUALIFY row_number() OVER (PARTITION BY task_id, agent ORDER BY CAST(floor(score) AS BIGINT) % 4, created_at, score) = 1""",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = with_run_key(derive(spark, sf_dir, SAVES))
    out = _play(
        saves, "CAST(floor(score) AS BIGINT) % 4", "stream-first",
        lambda stream, path, state: streams.first_wins(stream, path, state, ["run_key"], ["created_at", "score"]),
    )
    return streams.read_first(spark, out, ["run_key"], ["created_at", "score"]).select("task_id", "agent", "created_at", "score")


_LIVE = ("pass_at_1", "pass_at_5", "ci_low", "ci_high", "mean_score", "score_std_dev", "mean_cost_usd")


@query("T03_live_aggregates", f"SELECT task_id, agent, repeats, successes, {', '.join(f'round({c}, 8) AS {c}' for c in _LIVE)} FROM ({AGGREGATES_SQL})")
def live_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _play(
        _runs(spark, sf_dir), "event_id % 4", "stream-counts",
        lambda stream, path, state: streams.write_live_counts(streams.live_counts(stream), path, state),
    )
    counts = streams.read_live_counts(spark, out)
    table = flat(derive_metrics(counts))
    return table.select("task_id", "agent", "repeats", "successes", *[F.round(c, 8).alias(c) for c in _LIVE])


@query(
    "T04_spend_cap",
    f"""SELECT event_id, task_id, CAST(spent AS DOUBLE) AS spent_before, spent < {CAP} AS admitted
        FROM (SELECT *, coalesce(sum(coalesce(CAST(cost_usd AS DECIMAL(18, 6)), 0)) OVER (
                PARTITION BY task_id ORDER BY finished_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
              FROM {plain(inputs.RUNS)})""",
)
def spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _play(
        _runs(spark, sf_dir), _BY_DAY, "stream-spend",
        lambda stream, path, state: streams.spend_cap(stream, path, state, CAP, "task_id", ["finished_at", "event_id"]),
    )
    marked = spark.read.parquet(f"{out}/runs")
    return marked.select("event_id", "task_id", F.col("spent_before").cast("double"), "admitted")


# The registry is a table: two fragments and the names of the customers' segments.
_CHUNK_SECRETS = """
SELECT 0 AS position, 'tion' AS value, 'WORD' AS name UNION ALL SELECT 1, 'tions and', 'PHRASE'
UNION ALL SELECT 2 + c_custkey, c_mktsegment || CAST(c_custkey AS STRING), 'SEGMENT' FROM {customer}"""


@query(
    "T05_scrub_stream",
    f"SELECT conv_id, turn, role, {redact_sql('replace(replace(text, $$tions and$$, $$<PHRASE>$$), $$tion$$, $$<WORD>$$)')} AS text FROM {plain(TURNS)}",
)
def scrub_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = index_registry(derive(spark, sf_dir, _CHUNK_SECRETS))
    out = _play(
        derive(spark, sf_dir, TURNS), "conv_id % 4", "stream-logs",
        lambda stream, path, state: streams.scrub_arrivals(stream, "text", registry, path, state),
    )
    return spark.read.parquet(out).select("conv_id", "turn", "role", "text")


_EDITS = """
SELECT o_custkey AS entity, o_orderkey AS position, CASE o_orderkey % 5 WHEN 3 THEN 'undo' WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'redo' ELSE 'undo' END
       ELSE 'append' END AS kind, CAST(o_orderkey % 10 AS STRING) AS piece
FROM {orders}"""


@query(
    "X11_replay_edits",
    f"""SELECT entity, array_to_string(s.tape[1:s.cur], '') AS value, n AS operations FROM (
          SELECT entity, count(*) AS n, list_reduce(
            list({{'kind': kind, 'piece': piece, 'tape': CAST([] AS VARCHAR[]), 'cur': 0}} ORDER BY position),
            lambda a, x: CASE x.kind
              WHEN 'append' THEN {{'kind': '', 'piece': '', 'tape': list_append(a.tape[1:a.cur], x.piece), 'cur': a.cur + 1}}
              WHEN 'undo' THEN {{'kind': '', 'piece': '', 'tape': a.tape, 'cur': greatest(0, a.cur - 1)}}
              ELSE {{'kind': '', 'piece': '', 'tape': a.tape, 'cur': least(len(a.tape)::INT, a.cur + 1)}} END,
            {{'kind': '', 'piece': '', 'tape': CAST([] AS VARCHAR[]), 'cur': 0}}) AS s
          FROM {plain(_EDITS)} GROUP BY entity)""",
)
def replay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derive(spark, sf_dir, _EDITS)
    share = max(1, -(-log.count() // _ARRIVALS))
    out = _play(
        log, f"CAST(least({_ARRIVALS - 1}, floor(position / {share})) AS INT)", "stream-edits",
        lambda stream, path, state: streams.write_live_counts(edits.replay_edits(stream), path, state, ["entity"]),
    )
    return streams.read_live_counts(spark, out, ["entity"]).select("entity", "value", "operations")
