"""Operators on the literal cases the reference behaviour is known for."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import compare, latest, planning, quality, rules, saved, scoring, scrubbing, snapshots, source_code
from assayer.schemas import CHECK_SPEC, TASK
from assayer.sources import trees


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_score_runs(spark):
    checks = spark.createDataFrame(
        [("r", True, 1.0, True, 1.0), ("r", False, 3.0, False, 0.0), ("none", False, 1.0, False, 0.5), ("bad", True, 0.0, True, 1.0)],
        "run string, required boolean, weight double, passed boolean, score double",
    )
    assert rows(scoring.score_runs(checks, ["run"]), "run", "passed", "score", "bad_weights") == [
        ("bad", True, None, True), ("none", True, 0.5, False), ("r", True, 0.25, False)
    ]


def _runs(spark, outcomes):
    data = [("t", a, p, float(p), c, 1.0) for a, passes in outcomes.items() for p, c in passes]
    return spark.createDataFrame(data, "task_id string, agent string, passed boolean, score double, cost_usd double, duration_s double")


def test_aggregates(spark):
    runs = _runs(spark, {"a": [(True, 1.0), (True, None), (False, 3.0), (False, None), (False, 2.0)], "one": [(False, None)]})
    table = {r.agent: r for r in scoring.aggregate_runs(runs).collect()}
    a, one = table["a"], table["one"]
    assert (a.repeats, a.successes, a.pass_at_1) == (5, 2, 0.4)
    assert a.pass_at_k == {"1": pytest.approx(0.4), "2": pytest.approx(0.7), "5": 1.0}
    assert a.pass_all_at_k["2"] == pytest.approx(0.1)
    assert a.mean_cost_usd == 2.0 and a.dollars_per_solve == pytest.approx(5.0)
    assert one.score_std_dev is None and one.mean_cost_usd is None and one.dollars_per_solve is None


def test_comparison_of_reports(spark):
    before = scoring.aggregate_runs(_runs(spark, {"a": [(False, None)], "gone": [(True, None)], "same": [(True, None)], "worse": [(True, None)]}))
    after = scoring.aggregate_runs(_runs(spark, {"a": [(True, None)], "new": [(True, None)], "same": [(True, None)], "worse": [(False, None)]}))
    tasks = compare.compare_tasks(before, after)
    assert dict(rows(tasks, "agent", "status")) == {
        "a": "improved", "gone": "missing", "new": "missing", "same": "unchanged", "worse": "regressed"
    }
    lines = [r.line for r in compare.compare_task_lines(tasks).collect()]
    assert lines[0].startswith("t a: improved pass_at_1 0.000 ci95=0.000..") and lines[1] == "t gone: missing"
    agents = [r.line for r in compare.compare_agent_lines(compare.compare_agents(before, after)).collect()]
    assert agents[0].endswith("(delta +1.000)") and agents[1] == "gone: missing on one side"
    assert compare.leaderboard_lines(after).first().line.startswith("a\tt\tpass@1=1.000\tci95=")


def test_warnings_of_dirty_unknown_suites(spark):
    side = "struct<schema_version:string,version:string,corpus_git_sha:string,corpus_ref_kind:string,corpus_dirty:boolean>"
    pairs = spark.createDataFrame(
        [(1, ("1.0.0", "0.1.0", "x", "unknown", True), ("1.0.0", "0.2.0", "x", "git", False)), (2, ("1", "1", "x", "git", False), ("1", "1", "x", "git", False))],
        f"pair int, left {side}, right {side}",
    )
    found = compare.comparability_warnings(pairs).collect()
    assert {w.pair for w in found} == {1} and len(found) == 3
    assert found[0].warning == "suite.version differs: 0.1.0 != 0.2.0"


def _tree(spark, files):
    data = [("t", path, kind, bytearray(content.encode()), content, False) for path, (kind, content) in files.items()]
    return spark.createDataFrame(data, "tree_id string, path string, kind string, content binary, text string, executable boolean")


def test_snapshot_diff_and_documents(spark):
    base = snapshots.build_snapshot(_tree(spark, {"old.txt": ("file", "a"), "same.txt": ("file", "b"), ".git/x": ("file", "c"), "s": ("special", "4096")}))
    current = snapshots.build_snapshot(_tree(spark, {"new.txt": ("file", "a"), "same.txt": ("file", "changed"), "s": ("special", "4096")}))
    changes = snapshots.snapshot_diff(base, current)
    assert rows(changes, "path", "change") == [("new.txt", "added"), ("old.txt", "removed"), ("same.txt", "modified")]
    document = snapshots.changed_files_documents(changes).first().document
    assert json.loads(document) == {"added": ["new.txt"], "modified": ["same.txt"], "removed": ["old.txt"]}
    flipped = current.withColumn("executable", F.col("path") == "new.txt")
    assert rows(snapshots.snapshot_diff(current, flipped), "path", "change") == [("new.txt", "modified")]


def test_text_diffs_match_difflib(spark):
    before = {"a.py": ("file", "x = 1\ny = 2\n"), "gone": ("file", "g"), "link": ("symlink", "one"), "noeol": ("file", "a")}
    after = {"a.py": ("file", "x = 1\ny = 3\nz = 4\n"), "new": ("file", "n"), "link": ("symlink", "two"), "noeol": ("file", "b token=abcdefghijklm")}
    base, current = _tree(spark, before), _tree(spark, after)
    changes = snapshots.snapshot_diff(snapshots.build_snapshot(base), snapshots.build_snapshot(current))
    found = {r.path: r["diff"] for r in snapshots.text_diffs(changes, base, current).collect()}
    assert found["new"] == "Added new\n" and found["gone"] == "Removed gone\n" and found["link"] == "Changed binary-or-large link\n"
    expected = difflib.unified_diff(before["a.py"][1].splitlines(True), after["a.py"][1].splitlines(True), "a/a.py", "b/a.py")
    assert found["a.py"] == "".join(expected)
    assert found["noeol"].endswith("-a+b <REDACTED>\n")


def test_tree_hash_depends_on_content_not_on_partitioning(spark):
    files = _tree(spark, {f"d{i % 7}/f{i}": ("file", str(i)) for i in range(60)})
    entries = snapshots.tree_entries(files)
    first = snapshots.tree_hash(entries).first().tree_hash
    assert snapshots.tree_hash(entries.repartition(7)).first().tree_hash == first
    changed = entries.withColumn("executable", F.col("path") == "d0/f0")
    assert snapshots.tree_hash(changed).first().tree_hash != first


def test_overlay_and_nearest_directory(spark):
    base = spark.createDataFrame([("t", "a", "1"), ("t", "b", None)], "tree_id string, path string, v string")
    top = spark.createDataFrame([("t", "b", "2"), ("t", "c", "3"), ("t", "a", None)], "tree_id string, path string, v string")
    assert sorted(map(tuple, snapshots.overlay(base, top).collect()), key=str) == [("t", "a", None), ("t", "b", "2"), ("t", "c", "3")]
    changed = spark.createDataFrame([("x/y/z.txt",), ("x/y",), ("q/r",), ("top.txt",)], "path string")
    marked = spark.createDataFrame([("x",), ("x/y",), ("",)], "dir string")
    assert [r.dir for r in snapshots.nearest_marked_dir(changed, marked).collect()] == ["", "x/y"]


SOURCE = '''
import os.path
from pkg import a as b
from . import c

class Box:
    class Inner:
        def get(self): ...
    async def get(self, *, key: str = "k") -> "Box": ...

def solve(value: int, /, other=1, *args: int, flag, **kw) -> int:
    def test_nested():
        assert value
    assert other
'''


def test_source_facts(spark):
    data = [("t", "m.py", SOURCE), ("t", "bad.py", "def ("), ("t", "nul.py", "a\x00b"), ("t", "none.py", None)]
    facts = source_code.parse_sources(spark.createDataFrame(data, "tree_id string, path string, text string"))
    assert rows(facts, "path", "parsed", "test_functions", "asserts") == [
        ("bad.py", False, 0, 0), ("m.py", True, 1, 2), ("none.py", False, 0, 0), ("nul.py", False, 0, 0)
    ]
    found = {(r.kind, r.name): r.signature for r in source_code.symbols(facts).collect()}
    assert found[("method", "get")] == "(self, key: str = 'k') -> 'Box'"
    assert found[("function", "solve")] == "(value: int, other = 1, *args: int, flag, **kw) -> int"
    assert ("class", "Inner") in found and ("function", "test_nested") in found
    assert [(r.module, r.name) for r in source_code.imports(facts).orderBy("ord").collect()] == [("os.path", None), ("pkg", "a"), ("", "c")]


@pytest.mark.parametrize(
    "module, name, forbidden, names, expected",
    [
        ("os.path", "sep", "os", ["path"], False), ("os.path", None, "os", ["path"], True), ("os", "path", "os", ["path"], True),
        ("os", None, "os", ["path"], False), ("os.path.x", None, "os", [], True), ("osx", None, "os", [], False), ("os", "y", "os", [], True),
    ],
)
def test_import_rules(value, module, name, forbidden, names, expected):
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    assert bool(value(rules.import_violates(F.lit(module), F.lit(name).cast("string"), F.lit(forbidden), listed))) is expected


def _specs(spark, *checks):
    defaults = {f.name: None for f in CHECK_SPEC}
    tasks = spark.createDataFrame([("task", ["c0"], [{**defaults, "name": f"c{i}", **c} for i, c in enumerate(checks)])],
                                  f"task_id string, required_checks array<string>, checks array<{CHECK_SPEC.simpleString()}>")
    full = tasks.withColumns({"timeout_s": F.lit(1), "editable_files": F.array().cast("array<string>"),
                              "limits": F.lit(None).cast("struct<cpu_s:int,mem_mb:int,nproc:int,fsize_mb:int>")})
    return rules.expand_specs(trees.with_defaults(full), spark.createDataFrame([("t", "task")], "tree_id string, task_id string"))


def _judge(spark, evidence, *checks):
    found = rules.run_checks(_specs(spark, *checks), evidence, tuple({c["type"] for c in checks}))
    return [(r.passed, r.error_kind, r.error_detail) for r in found.orderBy("position").collect()]


def test_content_and_existence_checks(spark):
    files = _tree(spark, {"app.py": ("file", "value = 42"), "d/x.txt": ("file", "x")})
    raw = files.withColumn("content", F.when(F.col("path") == "d/x.txt", F.unhex(F.lit("FF"))).otherwise(F.col("content")))
    found = _judge(
        spark, rules.Evidence(files=raw),
        {"type": "content_present", "path": "app.py", "pattern": "42"}, {"type": "content_absent", "path": "./app.py", "pattern": "secret"},
        {"type": "content_present", "path": "no.py", "pattern": "x"}, {"type": "content_present", "path": "d/x.txt", "pattern": "x"},
        {"type": "content_present", "path": "app.py"}, {"type": "file_exists", "path": "d"}, {"type": "file_absent", "path": "d/x.txt"},
        {"type": "file_exists", "path": "../out"}, {"type": "file_exists"}, {"type": "nonsense"},
    )
    assert [f[:2] for f in found] == [
        (True, "none"), (True, "none"), (False, "check_crash"), (False, "check_failed"), (False, "check_failed"),
        (True, "none"), (False, "none"), (False, "check_failed"), (False, "check_failed"), (False, "check_failed"),
    ]
    assert found[8][2] == "check path is required" and found[9][2] == "check type is not registered: nonsense"


def test_scope_integrity_and_tamper_checks(spark):
    base = {"app.py": ("file", "1"), "tests/verification.py": ("file", "def test_a():\n    assert 1\n"), "tests/gone.py": ("file", "")}
    current = {"app.py": ("file", "2"), "tests/verification.py": ("file", "def test_a():\n    pass\n"), "pyproject.toml": ("symlink", "x"),
               "sub/conftest.py": ("file", "ADDOPTS --ignore")}
    old, new = _tree(spark, base), _tree(spark, current)
    facts = source_code.parse_sources(new.filter("path like '%.py'"))
    metrics = source_code.test_metrics(source_code.parse_sources(old.filter("path like '%.py'")))
    evidence = rules.Evidence(
        files=new, changes=snapshots.snapshot_diff(snapshots.build_snapshot(old), snapshots.build_snapshot(new)),
        base_metrics=metrics, metrics=source_code.test_metrics(facts, metrics), parsed=facts,
    )
    checks = [{"type": "diff_scope", "max_files_changed": 9}, {"type": "diff_scope", "max_files_changed": 1},
              {"type": "integrity", "forbid_changes": ["tests/*"]}, {"type": "no_test_tamper"}]
    assert [f[0] for f in _judge(spark, evidence, *checks)] == [True, False, False, False]
    found = rules.check_violations(_specs(spark, *checks), evidence, ("no_test_tamper",))
    assert {r.violation for r in found.collect()} == {
        "assert count decreased: tests/verification.py", "visible test removed: tests/gone.py",
        "unsafe test config path: pyproject.toml", "suspicious test config pattern addopts: sub/conftest.py",
        "suspicious test config pattern --ignore: sub/conftest.py",
    }
    only_new = rules.suspicious_configs(new, new)
    assert [r.violation for r in only_new.collect()] == ["unsafe test config path: pyproject.toml"]


def test_code_checks(spark):
    files = _tree(spark, {"app.py": ("file", "def solve(value: int) -> int:\n    return value\n"), "lib/x.py": ("file", "class solve: ...\n"),
                          "bad/y.py": ("file", "def ("), "lib/notes.txt": ("file", "not python {")})
    facts = source_code.parse_sources(files.filter("path like '%.py'"))
    solve = {"symbol": "solve", "kind": "function", "in_file": "app.py"}
    found = _judge(
        spark, rules.Evidence(files=files, parsed=facts),
        {"type": "ast_defines", **solve, "forbid_in_globs": ["lib/*.py"]}, {"type": "ast_defines", **solve, "forbid_in_globs": ["bad/*"]},
        {"type": "ast_defines", **solve, "kind": "class", "in_file": "lib/x.py", "forbid_in_globs": ["*.py"]},
        {"type": "ast_signature", **solve, "signature": "(value: int) -> int"}, {"type": "ast_signature", **solve, "symbol": "other", "signature": "()"},
        {"type": "ast_no_import", "module": "os"}, {"type": "ast_no_import", "module": "os", "in_file": "app.py"}, {"type": "ast_defines", "in_file": "app.py"},
        {"type": "ast_defines", **solve, "forbid_in_globs": ["lib/*"]},
    )
    assert [f[:2] for f in found] == [
        (True, "none"), (False, "check_failed"), (True, "none"), (True, "none"), (False, "none"), (False, "check_failed"),
        (True, "none"), (False, "check_failed"), (False, "check_failed"),
    ]


def _manifest(**changes):
    check = {"name": "scope", "type": "diff_scope", "max_files_changed": 1}
    return {"id": "t-one", "version": "0.1.0", "tier": 3, "category": "backward_compat", "description": "x" * 30,
            "required_checks": ["scope"], "checks": [check], **changes}


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, set()), ({"odd": 1}, {"V01"}), ({"required_checks": ["ghost"]}, {"V08"}),
        ({"checks": [{"name": "scope", "type": "diff_scope"}] * 2}, {"V07"}), ({"id": "X", "tier": 9}, {"V02", "V03"}),
        ({"editable_files": ["a/../b"]}, {"V09"}), ({"checks": [{"name": "scope", "type": "ast_no_import"}]}, {"V11"}),
        ({"checks": [], "description": None}, {"V04", "V06", "V08"}), ({"limits": {"cpu_s": 0}}, {"V05"}),
    ],
)
def test_manifest_rules(spark, changes, expected):
    raw = spark.createDataFrame([(json.dumps(_manifest(**changes)),)], "raw string")
    table = raw.withColumn("task", F.from_json("raw", TASK)).select("raw", "task.*")
    found = quality.validate(table, ["id"], quality.manifest_rules(F.col("raw")))
    assert {r.rule_id for r in found.collect()} == expected


def test_settings_bounds():
    quality.check_settings(parallel=1, repeats=100)
    for wrong in ({"parallel": 0}, {"repeats": 101}, {"inline_diff_max_bytes": -1}):
        with pytest.raises(ValueError):
            quality.check_settings(**wrong)


def plainly_scrubbed(text, known):
    """Every secret tried in turn, the longest first."""
    for secret in sorted(known, key=lambda v: (-len(v), v)) if text is not None else ():
        text = text.replace(secret, f"<{known[secret]}>")
    return text


def registry_of(spark, known):
    return spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(known.items())], "position int, value string, name string")


def test_registry_is_found_by_anchors_as_if_every_secret_was_tried(spark):
    secrets = [(i, f"k{i % 40:02d}" + "x" * (i % 3), f"N{i}") for i in range(120)] + [(999, "", "EMPTY")]
    table = spark.createDataFrame(secrets, "position int, value string, name string")
    docs = [(1, "k01xx k02x k39 token=abcdefghijkl"), (2, "none"), (2, "none"), (None, None), (3, ""), (4, "k39" * 50 + "é" * 10 + "k00xx")]
    known = {value: name for _, value, name in secrets if value}
    expected = [(i, (plainly_scrubbed(t, known) or t) and plainly_scrubbed(t, known).replace("token=abcdefghijkl", "<REDACTED>")) for i, t in docs]
    found = scrubbing.scrub_with_registry(spark.createDataFrame(docs, "id int, text string"), "text", table)
    assert found.columns == ["id", "text"] and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("seed", range(4))
def test_nested_overlapping_and_completed_secrets(spark, seed):
    rng = random.Random(seed)
    letters = "ab<>é" if seed % 2 else "abc"
    known = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))): "".join(rng.choice("abA") for _ in range(rng.randrange(1, 4))) for _ in range(25)}
    docs = [(i, "".join(rng.choice(letters + "xyz ") for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    found = scrubbing.scrub_with_registry(spark.createDataFrame(docs, "id int, text string"), "text", registry_of(spark, known))
    assert dict(map(tuple, found.collect())) == {i: plainly_scrubbed(t, known) for i, t in docs}


def test_a_registry_of_a_hundred_thousand_secrets(spark):
    rows = spark.range(100_000).select(
        F.col("id").cast("int").alias("position"), F.concat(F.lit("live-key-"), F.sha2(F.col("id").cast("string"), 256)).alias("value"),
        F.concat(F.lit("K"), F.col("id")).alias("name"),
    )
    index = scrubbing.index_registry(rows)
    assert index.follows is None and index.widths == (16,)
    wanted = rows.filter("position % 9973 = 5").collect()
    docs = [(k, f"start {r.value}{r.value} live-key-0000 {r.value[:-1]} end") for k, r in enumerate(wanted)] + [(99, "live-key- only " * 500)]
    found = scrubbing.scrub_with_registry(spark.createDataFrame(docs, "id int, text string"), "text", index)
    assert dict(map(tuple, found.collect())) == {i: plainly_scrubbed(t, {r.value: r.name for r in wanted}) for i, t in docs}
    # the common beginning is no anchor: what is in no text joins nothing
    assert scrubbing._present(spark.createDataFrame([(docs[-1][1],)], "text string"), index).count() == 0


def test_plans_and_budgets(spark):
    tasks = spark.createDataFrame([("b", 10), ("a", 20)], "task_id string, timeout_s int")
    cells = planning.build_matrix(tasks, ["y", "x"], 2).withColumns({"task_version_hash": F.lit("v"), "env_manifest_hash": F.lit("e")})
    keyed = planning.with_cell_key(cells)
    done = keyed.filter("repeat = 0").withColumn("error_kind", F.when(F.col("agent") == "x", "timeout").otherwise("none"))
    assert planning.pending(keyed, done).count() == 4 and planning.pending(keyed, done, retry_errors=True).count() == 6
    summary = planning.plan_summary(keyed, done, spark.createDataFrame([("x",)], "agent string")).first()
    assert tuple(summary) == (8, 4, 4, 2, 120)
    with pytest.raises(ValueError):
        planning.build_matrix(tasks, ["x"], 0)
    runs = spark.createDataFrame([("s", 1, 1.0), ("s", 2, None), ("s", 3, 2.0), ("s", 4, 1.0)], "suite string, at int, cost_usd double")
    spent = planning.admit_within_budget(runs, 1.5, ["suite"], ["at"])
    assert [r.admitted for r in spent.orderBy("at").collect()] == [True, True, True, False]
    assert not any(r.admitted for r in planning.admit_within_budget(runs, 0.0, ["suite"], ["at"]).collect())


def test_latest_rows_replace_older_ones(spark):
    cols = "task_id string, agent string, repeat int, seed int, task_version_hash string, env_manifest_hash string, created_at string, score double"
    old = spark.createDataFrame([("t", "a", 0, 1, "v", "e", "2026-01-01", 0.1), ("t", "b", 0, 1, "v", "e", "2026-01-02", 0.2)], cols)
    new = spark.createDataFrame([("t", "a", 0, 1, "v", "e", "2026-01-01", 0.9), ("t", "a", 0, 1, "v2", "e", "2026-01-03", 0.5)], cols)
    merged = latest.merge_runs(latest.with_run_key(old), latest.with_run_key(new))
    assert rows(merged, "agent", "task_version_hash", "score") == [("a", "v", 0.9), ("a", "v2", 0.5), ("b", "v", 0.2)]
    assert rows(latest.latest_cell(merged), "agent", "score") == [("a", 0.5), ("b", 0.2)]


def test_nearest_marked_directories(spark):
    rng = random.Random(11)
    names = ["a", "b", "c"]
    paths_ = ["/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["top"]
    for marked in (["a", "a/b", "b/c/a", "c"], ["", "b"], []):
        found = snapshots.nearest_marked_dir(spark.createDataFrame([(p,) for p in paths_], "path string"), spark.createDataFrame([(m,) for m in marked * 2], "dir string"))
        want = set()
        for path in paths_:
            above = [d for d in marked if path == d or d == "" or path.startswith(d + "/")]
            want |= {max(above, key=len)} if above else set()
        assert [r.dir for r in found.collect()] == sorted(want)


def test_rules_meet_only_what_their_keys_name(spark):
    files = [("t", p, "file", bytearray(b"import os.path\n"), "x") for p in ("app.py", "lib/a.py", "lib/sub/b.py", "tests/t.py", "lib.txt")]
    table = spark.createDataFrame(files, "tree_id string, path string, kind string, content binary, text string")
    changes = table.select("tree_id", "path", F.lit("added").alias("change"))
    specs = spark.createDataFrame(
        [("t", k, f"n{k}", "integrity", True, 1.0, globs) for k, globs in enumerate([["lib/*"], ["*.py", "lib/*.py", "lib/a.py"], ["lib/sub/b.py"], ["none/*"], ["lib*"]])],
        "tree_id string, position int, name string, type string, required boolean, weight double, forbid_changes array<string>",
    )
    found = rules.integrity_violations(specs, rules.Evidence(changes=changes))
    assert rows(found, "position", "violation") == sorted(
        [(0, "lib/a.py"), (0, "lib/sub/b.py"), (2, "lib/sub/b.py")] + [(1, p) for p in ("app.py", "lib/a.py", "lib/sub/b.py", "tests/t.py")]
        + [(4, p) for p in ("lib/a.py", "lib/sub/b.py", "lib.txt")]
    )


def test_saved_runs_replace_and_are_read_back(spark, tmp_path):
    path, kind = str(tmp_path / "runs"), "run_key string, created_at int, score double, checks array<struct<name:string, passed:boolean>>"

    def some(*data):
        return spark.createDataFrame([(k, at, s, [(f"{k}{i}", True) for i in range(n)]) for k, at, s, n in data], kind)

    state = {}
    for step in range(7):
        batch = [("a", step, step / 8, step), ("b", -step, step / 8, 1), (f"k{step}", step, 0.5, 2), ("a", step - 1, 9.0, 9)]
        number = saved.save(some(*batch), path, ["run_key"], saved.newest_first("created_at"), merge_every=3)
        assert number == step
        for k, at, s, n in sorted(batch, key=lambda r: r[1]):
            if k not in state or at >= state[k][0]:
                state[k] = (at, s, n)
        found = saved.read(spark, path, ["run_key"], saved.newest_first("created_at"))
        assert {r.run_key: (r.created_at, r.score, len(r.checks)) for r in found.collect()} == state
    # a step saved again changes nothing, neither does one that was lost half-way
    saved.save(some(*batch), path, ["run_key"], saved.newest_first("created_at"), step=6, merge_every=3)
    (tmp_path / "runs" / "part-7").mkdir()
    found = saved.read(spark, path, ["run_key"], saved.newest_first("created_at"))
    assert found.columns == ["run_key", "created_at", "score", "checks"]
    assert {r.run_key: (r.created_at, r.score, len(r.checks)) for r in found.collect()} == state
    opened = {f.split("/")[-2] for f in found.inputFiles()}
    assert opened == {"base-5", "part-6"}
    assert latest.child_checks(found, "score").filter("run_key = 'k6'").count() == 2
    assert saved.save_runs(some(("b", 50, 1.0, 0)), path) == 7  # the lost step's number is free
    assert saved.read_runs(spark, path).filter("run_key = 'b'").first().created_at == 50


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = latest.latest(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Broadcast" in plan, "SortMergeJoin" in plan


def test_stored_keys_are_not_sent_through_the_driver(spark):
    tasks = spark.createDataFrame([("t", 5)], "task_id string, timeout_s int")
    cells = planning.with_cell_key(
        planning.build_matrix(tasks, ["a", "b"], 2).withColumns({"task_version_hash": F.lit("v"), "env_manifest_hash": F.lit("e")})
    )
    runs = cells.filter("repeat = 0").select("run_key", F.lit("none").alias("error_kind"))
    for found in (planning.completed(cells, runs), planning.pending(cells, runs), planning.plan_summary(cells, runs)):
        assert _joins(found) == (False, True)
    assert (planning.completed(cells, runs).count(), planning.pending(cells, runs).count()) == (2, 2)


def test_checks_do_not_send_trees_through_the_driver(spark):
    from assayer.plans import workspaces

    current = spark.sql("SELECT id AS tree_id, 'app.py' AS path, 'file' AS kind, 'import os.path' AS text, encode('import os.path', 'UTF-8') AS content FROM range(1, 2)")
    facts = workspaces.parsed(current)
    metrics = source_code.test_metrics(facts)
    evidence = rules.Evidence(
        files=current, changes=spark.sql("SELECT id AS tree_id, 'notes.txt' AS path, 'added' AS change FROM range(1, 2)"), base_metrics=metrics,
        metrics=source_code.test_metrics(facts, metrics), parsed=facts,
        outputs=spark.sql("SELECT id AS tree_id, 'types' AS name, '' AS stdout, 0 AS exit_code, false AS timed_out, false AS check_timed_out, '' AS junit FROM range(1, 2)"),
    )
    checks = F.from_json(F.lit(json.dumps(workspaces.CHECKS)), f"array<{CHECK_SPEC.simpleString()}>")
    tasks = spark.range(1).select(
        F.lit("t").alias("task_id"), F.array(F.lit("types")).alias("required_checks"), checks.alias("checks"), F.lit(60).alias("timeout_s"),
        F.array().cast("array<string>").alias("editable_files"), F.lit(None).cast("struct<cpu_s:int,mem_mb:int,nproc:int,fsize_mb:int>").alias("limits"),
    )
    specs = rules.expand_specs(trees.with_defaults(tasks), spark.sql("SELECT id AS tree_id, 't' AS task_id FROM range(1, 2)")).checkpoint()
    results, found = rules.run_checks(specs, evidence), rules.check_violations(specs, evidence)
    assert _joins(results) == (False, True) and _joins(found) == (False, True)
    assert {r.name for r in results.collect() if r.passed} == {"gone", "tamper", "types", "scope"}
    assert {(r.name, r.violation) for r in found.collect()} == {("no_import", "app.py:os.path"), ("intact", "notes.txt")}


def test_judged_runs_are_joined_by_shuffle(spark):
    from assayer.plans.lifecycle import judge_runs

    results = spark.sql("SELECT id AS tree_id, true AS required, true AS passed, 1.0D AS weight, 0.5D AS score FROM range(1, 2)")
    sessions = spark.sql(
        """SELECT id AS tree_id, 't' AS task_id, 'a' AS agent, 'codex' AS adapter, 'v' AS version_output, 0 AS repeat, 0 AS exit_code, false AS timed_out,
           1.5D AS duration_s, '' AS stdout, '' AS stderr, CAST(NULL AS STRING) AS crash_detail FROM range(1, 2)"""
    )
    judged = judge_runs(results, sessions, spark.sql("SELECT id AS tree_id, 'app.py' AS path FROM range(1, 2)"))
    assert _joins(judged) == (False, True)
    assert judged.first().score == 0.5
