"""Streams: replays, restarts and ordering."""

import json

from pyspark.sql import functions as F

from assayer.functions.text import registry_literal
from assayer.operators.scoring import derive_metrics
from assayer.operators.scrubbing import index_registry
from assayer.streaming import edits, runs as streams

SCHEMA = "run_key string, task_id string, agent string, at int, passed boolean, score double, cost_usd double, duration_s double, text string"


def _arrive(folder, name, *records):
    folder.mkdir(exist_ok=True)
    base = {"agent": "a", "task_id": "t", "passed": True, "score": 1.0, "duration_s": 1.0}
    (folder / f"{name}.json").write_text("\n".join(json.dumps({**base, **r}) for r in records))


def _source(spark, folder):
    from pyspark.sql.types import _parse_datatype_string

    return streams.stream_runs(spark, str(folder), _parse_datatype_string(SCHEMA), files_per_batch=1)


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_upsert_keeps_the_last_row_over_restarts(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    keys, order = ["run_key"], ["at"]
    _arrive(source, "1", {"run_key": "x", "at": 1, "score": 0.1}, {"run_key": "x", "at": 2, "score": 0.2}, {"run_key": "y", "at": 1})
    _run(streams.upsert(_source(spark, source), out, state, keys, order))
    _arrive(source, "2", {"run_key": "x", "at": 1, "score": 0.9}, {"run_key": "y", "at": 5, "score": 0.5})
    _run(streams.upsert(_source(spark, source), out, state, keys, order))
    expected = {("x", 2, 0.2), ("y", 5, 0.5)}
    current = streams.read_upserted(spark, out, keys, order)
    assert {(r.run_key, r.at, r.score) for r in current.collect()} == expected


def test_live_metrics_equal_batch_metrics(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    _arrive(source, "1", *[{"run_key": str(i), "at": i, "passed": i == 0, "score": i / 4, "cost_usd": 1.0} for i in range(3)])
    _arrive(source, "2", *[{"run_key": str(i), "at": i, "passed": i == 3, "score": i / 4} for i in range(3, 5)])
    _run(streams.write_live_counts(streams.live_counts(_source(spark, source)), out, str(tmp_path / "state")))
    row = derive_metrics(streams.read_live_counts(spark, out)).first()
    assert (row.repeats, row.successes, row.mean_score) == (5, 2, 0.5)
    assert round(row.pass_at_k["2"], 9) == 0.7 and round(row.pass_all_at_k["2"], 9) == 0.1


def test_spend_cap_carries_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    _arrive(source, "1", {"run_key": "1", "at": 1, "cost_usd": 0.4}, {"run_key": "2", "at": 2})
    _run(streams.spend_cap(_source(spark, source), out, str(tmp_path / "state"), 1.0, "task_id", ["at"]))
    _arrive(source, "2", {"run_key": "3", "at": 3, "cost_usd": 0.7}, {"run_key": "4", "at": 4, "cost_usd": 0.1})
    _run(streams.spend_cap(_source(spark, source), out, str(tmp_path / "state"), 1.0, "task_id", ["at"]))
    _arrive(source, "3", {"run_key": "5", "at": 5})
    _run(streams.spend_cap(_source(spark, source), out, str(tmp_path / "state"), 1.0, "task_id", ["at"]))
    marked = spark.read.parquet(f"{out}/runs").orderBy("at").collect()
    assert [(r.at, r.admitted, r.shutdown_reason) for r in marked] == [
        (1, True, None), (2, True, None), (3, True, None), (4, False, "budget_exceeded"), (5, False, "budget_exceeded")
    ]


def _lose(state, batch):
    """Forgets that a batch was committed, as if the driver was lost after it wrote."""
    for name in (f"{batch}", f".{batch}.crc"):
        (state / "commits" / name).unlink()


def test_lost_batches_are_replayed_without_a_trace(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    spend, kept = str(tmp_path / "spend"), str(tmp_path / "kept")
    for k in range(5):
        _arrive(source, str(k), {"run_key": "x", "at": k, "cost_usd": 0.25}, {"run_key": f"y{k}", "at": 10 * k, "task_id": "u", "cost_usd": 0.5})
        for again in (False, True):
            if again and k in (1, 2, 4):
                _lose(state / "spend", k)
                _lose(state / "kept", k)
            _run(streams.spend_cap(_source(spark, source), spend, str(state / "spend"), 0.9, "task_id", ["at"]))
            _run(streams.upsert(_source(spark, source), kept, str(state / "kept"), ["run_key"], ["at"], merge_every=2))
    marked = spark.read.parquet(f"{spend}/runs").orderBy("task_id", "at").collect()
    assert [(r.task_id, float(r.spent_before), r.admitted) for r in marked] == (
        [("t", k / 4, k < 4) for k in range(5)] + [("u", k / 2, k < 2) for k in range(5)]
    )
    assert {(r.run_key, r.at) for r in streams.read_upserted(spark, kept, ["run_key"], ["at"]).collect()} == {("x", 4)} | {(f"y{k}", 10 * k) for k in range(5)}
    # a batch reads the totals of the batch before it: nothing else is needed for the next one
    for k in range(4):
        for f in (tmp_path / "spend" / f"totals-{k}").iterdir():
            f.unlink()
    _arrive(source, "5", {"run_key": "z", "at": 99, "task_id": "u"})
    _run(streams.spend_cap(_source(spark, source), spend, str(state / "spend"), 0.9, "task_id", ["at"]))
    assert float(spark.read.parquet(f"{spend}/runs").filter("at = 99").first().spent_before) == 2.5


def test_chunks_are_scrubbed_on_arrival(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    _arrive(source, "1", {"text": "token=abc and token=abcdefghijklmnop"})
    scrubbed = streams.scrub_stream(_source(spark, source), "text", registry_literal({"abc": "SHORT"}))
    _run(scrubbed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")))
    assert spark.read.parquet(out).first().text == "token=<SHORT> and token=<SHORT>defghijklmnop"


def test_arrivals_are_scrubbed_with_a_stored_registry(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    secrets = [(0, "pear", "FRUIT"), (1, "pears and plums", "MANY"), (2, "never there", "NONE")]
    registry = index_registry(spark.createDataFrame(secrets, "position int, value string, name string"))
    for k, text in enumerate(["a pear", "pears and plums, pears"]):
        _arrive(source, str(k), {"at": k, "text": text})
        _run(streams.scrub_arrivals(_source(spark, source), "text", registry, out, state))
    assert [r.text for r in spark.read.parquet(out).orderBy("at").collect()] == ["a <FRUIT>", "<MANY>, <FRUIT>s"]


def _values(spark, tmp_path, *slices):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, operations in enumerate(slices):
        lines = [json.dumps({"entity": "e", "position": i * 100 + n, "kind": k, "piece": p}) for n, (k, p) in enumerate(operations)]
        (source / f"{i}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema("entity string, position long, kind string, piece string").json(str(source))
        _run(streams.write_live_counts(edits.replay_edits(stream), out, str(tmp_path / "state"), ["entity"]))
    return streams.read_live_counts(spark, out, ["entity"]).first()


def test_edit_replay_over_two_batches(spark, tmp_path):
    row = _values(spark, tmp_path, [("append", "a"), ("append", "b"), ("undo", "")], [("append", "c"), ("redo", "")])
    assert (row.value, row.operations) == ("ac", 5)


def test_replay_rules():
    assert edits.replay([], 0, [("undo", ""), ("redo", ""), ("append", "x"), ("undo", ""), ("undo", ""), ("redo", "")]) == (["x"], 1)


def test_first_arrival_wins_however_late_a_row_comes(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for arrival in ([("a", 5, 0.5), ("a", 4, 0.25)], [("a", 1, 1.0), ("b", 9_000_000, 0.5)], [("c", 0, 0.75), ("b", 2, 1.0)]):
        _arrive(folder, f"f{len(list(folder.glob('*.json'))) if folder.exists() else 0}", *[{"run_key": k, "at": at, "score": s} for k, at, s in arrival])
        _run(streams.first_wins(_source(spark, folder), out, state, ["run_key"], ["at"]))
    rows = streams.read_first(spark, out, ["run_key"], ["at"]).orderBy("run_key").collect()
    assert [(r.run_key, r.at, r.score) for r in rows] == [("a", 4, 0.25), ("b", 9_000_000, 0.5), ("c", 0, 0.75)]


def test_a_step_is_written_where_its_rows_are(spark, tmp_path):
    from assayer.operators import saved

    path, order = str(tmp_path / "kept"), saved.newest_first("at")
    rows = spark.range(0, 60, 1, 3).select((F.col("id") % 20).alias("key"), F.col("id").alias("at"))
    for step in range(2):
        saved.save(rows.withColumn("at", F.col("at") + 100 * step), path, ["key"], order, step, merge_every=2)
    parts, base = (list((tmp_path / "kept" / name).glob("*.parquet")) for name in ("part-0", "base-1"))
    assert len(parts) == 3 and all(".zstd." in f.name for f in [*parts, *base])
    assert spark.read.parquet(f"{path}/base-1").count() == 20
    assert {(r.key, r.at) for r in saved.read(spark, path, ["key"], order).collect()} == {(k, 140 + k) for k in range(20)}


def test_arrivals_are_compressed(spark, tmp_path):
    from assayer.plans import streams as plans

    before = spark.conf.get("spark.checkpoint.dir")
    rows = spark.range(8).select("id", F.lit("x" * 50).alias("text"))
    out = plans._play(rows, "id % 4", "arrivals-test", plans._to_parquet)
    assert spark.read.parquet(out).count() == 8
    place = tmp_path.__class__(before.removeprefix("file:"))
    names = [f.name for folder in place.glob("assayer-arrivals-test-*") for f in folder.glob("part-*.json*")]
    assert names and all(name.endswith(".json.gz") for name in names)


def test_entities_of_a_bucket_keep_their_own_tapes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    arrivals = ([(e, 1, "append", str(e)) for e in (None, 1, 2, 2**60 + 1)], [(1, 2, "undo", ""), (2, 3, "append", "c"), (2, 4, "append", "d"), (None, 5, "append", "n")])
    for i, rows in enumerate(arrivals):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("entity", "position", "kind", "piece"), r))) for r in rows))
        stream = spark.readStream.schema("entity long, position long, kind string, piece string").json(str(source))
        _run(streams.write_live_counts(edits.replay_edits(stream, buckets=1), out, str(tmp_path / "state"), ["entity"]))
    rows = streams.read_live_counts(spark, out, ["entity"]).collect()
    assert {(r.entity, r.value, r.operations) for r in rows} == {(None, "Nonen", 2), (1, "", 2), (2, "2cd", 3), (2**60 + 1, str(2**60 + 1), 1)}
