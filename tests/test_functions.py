"""Column functions against plain Python."""

import fnmatch
import hashlib
import json
import math
import random
import re
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from assayer.functions import keys, metrics, paths, text, usage
from assayer.operators import usage as usage_tables
from assayer.operators import tables, tool_output


@pytest.mark.parametrize("n, c, k", [(5, 2, 2), (5, 2, 1), (10, 0, 5), (10, 10, 10), (3, 1, 5), (24, 13, 10)])
def test_pass_rates_match_combinatorics(value, n, c, k):
    any_k = None if k > n else 1 - math.comb(n - c, k) / math.comb(n, k)
    all_k = None if k > n else math.comb(c, k) / math.comb(n, k)
    assert value(metrics.pass_at_k(F.lit(n), F.lit(c), k)) == (None if any_k is None else pytest.approx(any_k))
    assert value(metrics.pass_all_at_k(F.lit(n), F.lit(c), k)) == (None if all_k is None else pytest.approx(all_k))


def test_wilson_interval_contains_the_rate_and_stays_in_bounds(value):
    for c, n in [(0, 1), (1, 1), (2, 5), (50, 100)]:
        ci = value(metrics.wilson_ci(F.lit(c), F.lit(n)))
        assert 0 <= ci.low <= c / n <= ci.high <= 1
    assert value(metrics.wilson_ci(F.lit(0), F.lit(0))) is None


def test_k_map_leaves_out_undefined_entries(value):
    rates = {k: metrics.pass_at_k(F.lit(5), F.lit(2), k) for k in metrics.PUBLISHED_K}
    assert set(value(metrics.k_map(rates))) == {"1", "2", "5"}


def test_seeds_and_keys_match_hashlib(value):
    assert value(keys.run_seed(F.lit(42), F.lit("task"), F.lit("codex"), F.lit(3))) == 284566750
    digest = int(hashlib.sha256("7:é:checks".encode()).hexdigest(), 16)
    assert value(keys.check_seed(F.lit(7), F.lit("é"))) == (digest + 7) % 2**31
    payload = {"agent": "a\"b", "env_manifest_hash": "e", "repeat": 1, "seed": 5, "task_id": "tâ", "task_version_hash": "v"}
    expected = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    columns = {k: F.lit(v) for k, v in payload.items()}
    assert value(keys.run_key(**columns)) == expected


def test_cache_key_escapes_like_json(value):
    data = {"z": "naïve 🙂", "a": "1"}
    column = F.create_map(*[F.lit(x) for pair in data.items() for x in pair])
    assert value(keys.ascii_json(keys.canonical_json_map(column))) == json.dumps(data, sort_keys=True, separators=(",", ":"))


def test_run_id_shape(value):
    stamp = F.lit("2026-01-02 03:04:05").cast("timestamp")
    run_id = value(keys.run_id(stamp, F.array(F.lit("a")), F.array(F.lit("t")), F.lit(1), F.lit("process"), F.lit(1), F.lit(1)))
    assert re.fullmatch(r"20260102T030405Z-[0-9a-f]{8}", run_id)


_PATHS = [
    "app.py", "tests/test_a.py", "tests/sub/test_b.py", "docs/readme.md", "a/b/c/d.txt", ".git/x", "src/x[1].py",
    "README", "src/__pycache__/m.py", "a\nb.py", "tests", "x/y.tar.gz",
]
_GLOBS = ["*.py", "tests/*", "tests/**", "*", "?pp.py", "[a-s]*", "[!a]*", "docs/*.md", "src/x[[]1].py", "a*b.py", "**/test_*.py", "x.y"]


def test_name_globs_match_shell_rules(spark):
    rows = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    for glob in _GLOBS:
        found = {r.path for r in rows.filter(paths.matches_name_globs(F.col("path"), [glob])).collect()}
        assert found == {p for p in _PATHS if fnmatch.fnmatch(p, glob)}, glob


def test_globs_of_a_rules_table(spark):
    rules = spark.createDataFrame([(1, ["*.md", "app*"]), (2, []), (3, None)], "id int, globs array<string>")
    rows = rules.select("id", paths.name_globs_to_regex("globs").alias("regex"), F.explode(F.lit(_PATHS)).alias("path"))
    found = {(r.id, r.path) for r in rows.filter(F.rlike("path", F.col("regex"))).collect()}
    assert found == {(1, "docs/readme.md"), (1, "app.py")}


def test_tree_globs_match_pathlib(spark, tmp_path):
    names = [p for p in _PATHS if "\n" not in p and p != "tests"]
    for name in names:
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("")
    rows = spark.createDataFrame([(p,) for p in names], "path string")
    for glob in ["*.py", "tests/*.py", "**/*.py", "tests/**/*.py", "*/*.md", "a/**/d.txt", "[a-d]*", "src/*/*.py", "[!a]*.py"]:
        found = {r.path for r in rows.filter(F.col("path").rlike(paths.tree_glob_regex(glob))).collect()}
        expected = {p.relative_to(tmp_path).as_posix() for p in tmp_path.glob(glob) if p.is_file()}
        assert found == expected, glob


@pytest.mark.parametrize("path, expected", [("/../../a", "/a"), ("a/./b//c/..", "/a/b"), ("", "/"), ("..", "/"), ("x/../../y", "/y")])
def test_normalize_path(value, path, expected):
    assert value(paths.normalize_path(F.lit(path))) == expected


def test_stems(value):
    for name, expected in [("a/_x.py", "_x"), ("a/.hidden", ".hidden"), ("a/b.tar.gz", "b.tar"), ("plain", "plain")]:
        assert value(paths.stem(F.lit(name))) == expected


def test_scrub_text(value):
    registry = text.registry_literal({"pq7": "SHORT_KEY", "pq7rst": "LONG_KEY", "$1\\x": "ODD", "": "EMPTY"})
    for sample, expected in [
        ("door pq7 open", "door <SHORT_KEY> open"), ("pq7rst pq7 $1\\x", "<LONG_KEY> <SHORT_KEY> <ODD>"), ("nothing", "nothing"),
        ("sk-" + "b" * 24 + " tail", "<REDACTED> tail"), ("API-KEY:9876543210zy,", "<REDACTED>,"), ("\u017fecret=qqqqqqqqqqqqq", "<REDACTED>"),
    ]:
        assert value(text.scrub(F.lit(sample), registry)) == expected


def test_scrub_bytes_and_maps(value):
    assert value(text.scrub_bytes(F.lit(bytearray(b"\xffA")))) == text.REDACTED_BINARY
    assert value(text.scrub_bytes(F.lit(bytearray(b"ok")))) == "ok"
    pairs = F.create_map(F.lit("token=aaaaaaaaaaaaa"), F.lit("x"), F.lit("token=bbbbbbbbbbbbb"), F.lit("y"))
    assert value(text.scrub_map(pairs)) == {"<REDACTED>": "y"}


def test_utf8_tail(value):
    sample = "aé漢🙂" * 5
    for limit in range(1, 25):
        expected = sample.encode()[-limit:].decode("utf-8", errors="ignore")
        assert value(text.utf8_tail(F.lit(sample), limit)) == expected
    assert value(text.utf8_tail(F.lit(""), 5)) == ""


def test_lines_and_strip(value):
    for sample in ["", "a", "a\n", "a\r\nb", "a\n\nb\x0bc\x85d e", "\n"]:
        assert value(text.lines_of(F.lit(sample))) == sample.splitlines()
    assert value(text.normalize(F.lit("\t  MiXeD  \x1f"))) == "mixed"


def test_fixed_follows_exact_binary_rounding(value):
    for number in (0.0625, 2.675, 1234.5678, -0.5, 0.0):
        for digits in (2, 3, 6):
            assert value(text.fixed(F.lit(number), digits)) == f"{number:.{digits}f}"
    assert value(text.fixed(F.lit(0.25), 3, signed=True)) == "+0.250"
    assert value(text.fixed(F.lit(-0.25), 3, signed=True)) == "-0.250"


def test_version_text(value):
    assert value(text.first_line_or_unknown(F.lit(" \n"))) == "version_unknown"
    assert value(text.first_line_or_unknown(F.lit("\n tool 1.2\nmore"))) == "tool 1.2"
    assert len(value(text.first_line_or_unknown(F.lit("x" * 500)))) == 200


@pytest.mark.parametrize(
    "sample, expected",
    [
        ('{"usage":{"input_tokens":31,"output_tokens":7},"total_cost_usd":0.5}', (0.5, 31, 7)),
        ('{"usage":{"input_tokens":902,"output_tokens":64,"cost_usd":0.25}}', (0.25, 902, 64)),
        ("plain words", (None, None, None)),
        ("[1]\n7\n\"x\"", (None, None, None)),
        ('{"cost":"$1.5","tokens_in":"1,000"}\n\n{"cost":0.5,"tokens_out":2}', (2.0, 1000, 2)),
        ('{"cost":true,"tokens_in":1.5,"input_tokens":4}', (None, 4, None)),
        ('{"message":{"text":"m"},"usage":{"tokens_in":3}}', (None, 3, None)),
        ('{"message":{"usage":{"tokens_in":9}},"usage":{"tokens_in":3}}', (None, 9, None)),
        ("", (None, None, None)),
    ],
)
def test_json_usage(spark, sample, expected):
    found = usage_tables.json_usage(spark.createDataFrame([(1, sample)], "id int, log string"), ["id"], "log").collect()
    assert [tuple(r) for r in found] == [(1, *expected)]


def test_json_usage_is_read_without_lambdas(spark):
    logs = spark.createDataFrame([(1, '{"cost":1}'), (2, None)], "id int, log string")
    found = usage_tables.json_usage(logs, ["id"], "log")
    assert {tuple(r) for r in found.collect()} == {(1, 1.0, None, None), (2, None, None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.lower() and plan.lower().count("parsejson") == 1, plan


def test_text_usage(value):
    found = value(usage.text_usage(F.lit("Cost: $1.75\nTokens: 320 sent, 2,010 received")))
    assert (found.cost_usd, found.tokens_in, found.tokens_out) == (1.75, 320, 2010)


def test_usage_by_tool_and_negative_values(spark):
    sessions = [(1, "oracle", "cost 9", None), (2, "pi", '{"cost":-1,"tokens_in":2}', ""), (3, "aider", "Cost: $1.75", "5 sent"), (4, "other", "cost 9", ""), (5, "codex", None, '{"cost":2}')]
    found = usage_tables.session_usage(spark.createDataFrame(sessions, "id int, adapter string, stdout string, stderr string"), ["id"])
    assert {r.id: (r.cost_usd, r.tokens_in, r.tokens_out) for r in found.collect()} == {
        1: (0.0, 0, 0), 2: (-1.0, 2, None), 3: (1.75, 5, None), 4: (None, None, None), 5: (2.0, None, None)
    }
    checked = found.select("id", usage.any_negative(usage_tables.as_struct()).alias("bad"), usage.non_negative(usage_tables.as_struct()).alias("u"))
    assert {r.id: (r.bad, r.u.cost_usd) for r in checked.collect()}[2] == (True, None)


def test_tool_counts(value):
    assert value(tool_output.ruff_count(F.lit('[{"code": "W605"}, {"code": "B006"}, {"code": "B006"}]'))) == 3
    assert value(tool_output.ruff_count(F.lit("no report"))) is None
    assert value(tool_output.ruff_count(F.lit(" \n"))) == 0
    assert value(tool_output.mypy_count(F.lit("Found 12 errors in 4 files (checked 9 source files)"))) == 12
    assert value(tool_output.mypy_count(F.lit("a.py:1: error: x\nb.py:2: note: y\nc.py:3: error: z"))) == 2


@pytest.mark.parametrize(
    "xml, counts, broken",
    [
        ('<testsuite tests="2" failures="1" errors="0" skipped="0"></testsuite>', (2, 1, 0, 0), False),
        ('<testsuites><testsuite tests="2"/><testsuite tests="3" skipped="1"/></testsuites>', (5, 0, 0, 1), False),
        ("<testsuite", (None,) * 4, True),
        ('<testsuite tests="many"/>', (None,) * 4, True),
        ("", (None,) * 4, True),
        (None, (0, 0, 1, 0), False),
    ],
)
def test_junit_totals(value, xml, counts, broken):
    found = value(tool_output.junit_totals(F.lit(xml).cast("string")))
    assert (found.tests, found.failures, found.errors, found.skipped) == counts
    assert (found.problem is not None) == broken


def test_large_junit_is_counted_unless_a_limit_is_set(value):
    xml = F.concat(F.lit("<testsuite tests='1'>"), F.repeat(F.lit("x"), 1024 * 1024), F.lit("</testsuite>"))
    assert value(tool_output.junit_totals(xml, limit_bytes=1024 * 1024)).problem == "junit.xml exceeds size limit"
    found = value(tool_output.junit_totals(xml))
    assert (found.tests, found.problem) == (1, None)


def test_glob_heads_and_module_parents(value):
    heads = {"lib/*.py": "lib", "*.txt": "", "a/b/c.txt": "a/b", "a/b*/c": "a", "**/x": "", "x": "", "a/[bc]/d": "a", "a?/b": "", "": ""}
    for pattern, head in heads.items():
        assert value(paths.glob_head(F.lit(pattern))) == head
    assert value(paths.tree_glob_normal(F.lit("./lib//*.py"))) == "lib/*.py"
    assert value(paths.module_and_parents(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    assert value(paths.module_and_parents(F.lit("os"))) == ["os"]


def test_query_strings_match_urllib(value):
    random.seed(3)
    samples = ["?empty=&flag", "a=1&a=2", "x=%zz&y=%41%", "", "?", "=v", "k%20=a+b", "a=b=c", "é=%C3%A9"]
    samples += ["".join(random.choice("ab=&%+4?") for _ in range(12)) for _ in range(20)]
    for sample in samples:
        expected = {}
        for part in sample.removeprefix("?").split("&"):
            if part:
                name, _, content = part.partition("=")
                expected[unquote_plus(name)] = unquote_plus(content)
        assert value(tables.parse_query_string(F.lit(sample))) == expected, sample
