"""Reading and writing reports, manifests and archives through real files."""

import hashlib
import io
import json
import os
import stat
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayer.functions.metrics import pass_at_k
from assayer.operators import quality, scoring, snapshots
from assayer.sources import listing, reports, trees


@pytest.fixture()
def runs(spark):
    data = [(t, a, r, r * 3 + 1, (r + len(a)) % 2 == 0, 0.5, None if r else 0.25) for t in ("t1", "t2") for a in ("a", "bb") for r in range(3)]
    table = spark.createDataFrame(data, "task_id string, agent string, repeat int, seed long, passed boolean, score double, cost_usd double")
    null = F.lit(None)
    result = F.struct(
        F.col("agent"), null.cast("string").alias("agent_version"), F.lit(0).alias("exit_code"), F.lit(False).alias("timed_out"),
        F.lit(1.5).alias("duration_s"), F.col("cost_usd"), null.cast("long").alias("tokens_in"), null.cast("long").alias("tokens_out"),
        F.lit("é\"\n").alias("stdout_tail"), F.lit("").alias("stderr_tail"), F.lit("none").alias("error_kind"), null.cast("string").alias("error_detail"),
    )
    return table.withColumns({"agent_result": result, "duration_s": F.lit(1.5), "error_kind": F.lit("none"), "run_id": F.lit("r"),
                              "schema_version": F.lit("1.0.0")})


def _text(folder, parts="part-*"):
    return "".join(p.read_text() for p in sorted(Path(folder).glob(parts)))


def _document(spark, runs, path):
    suite = F.struct(F.lit("s").alias("name"), F.lit("0.1.0").alias("version"), F.lit("0" * 40).alias("corpus_git_sha"),
                     F.lit("git").alias("corpus_ref_kind"), F.lit(True).alias("corpus_dirty"), F.lit(None).cast("string").alias("calibration_date"),
                     F.array(F.lit("oracle")).alias("calibration_agents"))
    metadata = F.create_map(F.lit("repeats"), F.lit("3"), F.lit("skipped_adapters_json"), F.lit("{}"))
    lines = reports.report_document_lines(runs, scoring.aggregate_runs(runs), "r", "2026-01-01T00:00:00Z", suite, metadata)
    reports.write_report_document(lines.repartition(1).sortWithinPartitions("section", "k1", "k2", "k3", "line") if path is None else lines, str(path))


def test_report_document_round_trip(spark, runs, tmp_path):
    _document(spark, runs, tmp_path / "lines")
    document = json.loads(_text(tmp_path / "lines", "section=*/part-*"))
    assert [(r["task_id"], r["agent"], r["repeat"]) for r in document["runs"]] == [(t, a, r) for t in ("t1", "t2") for a in ("a", "bb") for r in range(3)]
    assert [(a["agent"], a["task_id"]) for a in document["aggregates"]] == [("a", "t1"), ("a", "t2"), ("bb", "t1"), ("bb", "t2")]
    assert document["metadata"] == {"repeats": "3"} and document["runs"][0]["agent_result"]["stdout_tail"] == "é\"\n"
    assert "artifacts_dir" in document["runs"][0] and len(document["aggregates"][0]["pass_at_1_ci95"]) == 2

    whole = tmp_path / "report.json"
    whole.write_text(json.dumps(document, indent=2))
    loaded = reports.load_reports(spark, str(whole))
    assert loaded.select("suite.corpus_dirty", "run_id").first() == (True, "r")
    assert reports.report_runs(loaded).count() == 12
    back = reports.report_aggregates(loaded).filter("agent = 'a' AND task_id = 't1'").first()
    n, c = F.lit(back.repeats), F.lit(back.successes)
    assert back.pass_at_k["2"] == pytest.approx(spark.range(1).select(pass_at_k(n, c, 2)).first()[0])
    assert back.pass_at_1_ci95.low < back.pass_at_1 < back.pass_at_1_ci95.high


def test_documents_of_several_part_files_are_loaded(spark, runs, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("one", "two"):
            _document(spark, runs, tmp_path / name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "one").glob("section=1/part-*"))) > 1
    loaded = reports.load_report_parts(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert loaded.head.select("run_id", "suite.corpus_dirty", "metadata").collect() == [("r", True, {"repeats": "3"})] * 2
    assert {r.report.rsplit("/", 1)[1] for r in loaded.runs.collect()} == {"one", "two"}
    back = loaded.runs.filter("report LIKE '%/two'").select("task_id", "agent", "repeat", "seed", "passed", "score", "agent_result")
    assert sorted(map(str, back.collect())) == sorted(map(str, runs.select(back.columns).collect()))
    whole = json.loads(_text(tmp_path / "one", "section=*/part-*"))
    assert loaded.aggregates.count() == 2 * len(whole["aggregates"])
    (tmp_path / "one" / "section=1" / "part-99999.txt").write_text('{"run_id": 3, "agent": [')
    with pytest.raises(Exception):
        reports.load_report_parts(spark, str(tmp_path / "one")).runs.collect()


def test_strict_reading_fails_on_broken_reports(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"run_id": ["not", "text"], "runs": 3}')
    with pytest.raises(Exception):
        reports.load_reports(spark, str(tmp_path / "bad.json")).collect()


def test_jsonl_and_csv(spark, runs, tmp_path):
    for part in ("repeat = 0", "repeat > 0"):
        reports.append_runs_jsonl(runs.filter(part), str(tmp_path / "jsonl"))
    lines = [json.loads(line) for p in Path(tmp_path / "jsonl").glob("part-*") for line in p.read_text().splitlines()]
    assert len(lines) == 12 and all("artifacts_dir" in line for line in lines)
    reports.write_csv(reports.runs_csv(runs).coalesce(1), str(tmp_path / "csv"))
    header, first, second = _text(tmp_path / "csv").splitlines()[:3]
    assert header == ",".join(reports.RUN_COLUMNS)
    assert first == "r,t1,a,0,False,0.500000,1.500000,0.250000,none"
    assert second == "r,t1,a,1,True,0.500000,1.500000,,none"


def test_manifest_discovery(spark, tmp_path):
    for folder in ("suite/a", "suite/b/deep", "suite/a/nested", "other"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "task.yaml").write_text(f"id: {folder.replace('/', '-')}\nchecks:\n  - name: one\n    type: ruff\n")
    (tmp_path / "suite/readme.md").write_text("x")

    def names(*inputs):
        found = trees.scan_manifests(spark, [str(tmp_path / i) for i in inputs])
        return {r.dir.removeprefix(str(tmp_path) + "/") for r in found.select("dir").collect()}

    assert names("suite") == {"suite/a", "suite/b/deep", "suite/a/nested"}
    assert names("suite/a", "suite/a/task.yaml") == {"suite/a"}
    assert names("suite/*", "other") == {"suite/a", "suite/b/deep", "other"}
    loaded = trees.with_defaults(trees.load_manifests(trees.scan_manifests(spark, [str(tmp_path / "other")]))).first()
    assert (loaded.id, loaded.timeout_s, loaded.checks[0].threshold, loaded.limits.mem_mb, loaded.problem) == ("other", 300, 10, 2048, None)


def test_tree_scan_and_reports_on_disk(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir/a.txt").write_text("hello")
    (tmp_path / "junit.xml").write_text("<testsuite/>")
    found = trees.scan_tree(spark, str(tmp_path), "t").orderBy("path").collect()
    assert [(r.path, r.size) for r in found] == [("junit.xml", 12), ("sub dir/a.txt", 5)]
    assert trees.junit_reports(spark, str(tmp_path)).first().xml == "<testsuite/>"


def test_listing_knows_links_modes_and_prunes_before_reading(spark, tmp_path):
    root = tmp_path / "tree"
    for folder in ("src/deep/er", ".git/objects", "src/__pycache__", "empty", "wide"):
        (root / folder).mkdir(parents=True)
    (root / "run.sh").write_text("#!/bin/sh\n")
    (root / "run.sh").chmod(0o750)
    (root / "src/deep/er/é.txt").write_text("ü")
    (root / "src/big.bin").write_bytes(bytes(range(256)) * 9000)
    os.mkfifo(root / "pipe")  # reading it would wait for ever
    os.mkfifo(root / ".git/objects/pack")
    os.mkfifo(root / "src/__pycache__/x.pyc")
    (root / "link").symlink_to("src/big.bin")
    (root / "broken").symlink_to("nowhere")
    (root / "folder").symlink_to("src")
    for k in range(30):
        (root / f"wide/d{k}").mkdir()
        (root / f"wide/d{k}/f").write_text(str(k))

    def digest(content):
        return hashlib.sha256(content).hexdigest()

    want = {
        "run.sh": (digest(b"#!/bin/sh\n"), 10, True), "src/deep/er/é.txt": (digest("ü".encode()), 2, False),
        "src/big.bin": (digest(bytes(range(256)) * 9000), 256 * 9000, False), "pipe": (digest(b"special:%d" % stat.S_IFIFO), 0, False),
        "link": (digest(b"src/big.bin"), 11, True), "broken": (digest(b"nowhere"), 7, True),
        **{f"wide/d{k}/f": (digest(str(k).encode()), len(str(k)), False) for k in range(30)},
    }
    trees_of = spark.createDataFrame([(7, str(root)), (8, str(root / "src"))], "tree_id int, root string")
    for directories in (1, 3, 1000):
        listed = listing.list_trees(trees_of, directories=directories)
        hashed = listing.hash_trees(listed).collect()
        assert {r.path: (r.sha256, r.size, r.executable) for r in hashed if r.tree_id == 7} == want and len(hashed) == len(want) + 2
    files = trees.scan_tree(spark, f"file://{root}", "t")
    built = snapshots.build_snapshot(files).collect()
    assert {r.path: (r.sha256, r.size, r.executable) for r in built} == want
    assert {r.path: r.sha256 for r in files.collect()} == {p: w[0] for p, w in want.items()}
    assert {r.kind for r in files.collect()} == {"file", "link", "special"}
    assert listing.list_trees(trees_of.limit(0)).count() == 0


def test_archive_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("app.py", "x = 1")
        archive.writestr("dir/", "")
        archive.writestr("../evil", "y")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        archive.writestr(link, "target")
    table = spark.createDataFrame([("t", bytearray(buffer.getvalue()))], "task_id string, content binary")
    members = trees.archive_members(table)
    assert {(r.path, r.is_dir, r.size) for r in members.collect()} == {("app.py", False, 5), ("dir/", True, 0), ("../evil", False, 1), ("link", False, 6)}
    assert {r.message for r in quality.member_findings(members).collect()} == {"zip entry escapes: ../evil", "zip entry link: link"}


def test_duplicate_ids(spark):
    table = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [r.id for r in quality.duplicate_ids(table).collect()] == ["a"]
