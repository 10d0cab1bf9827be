"""File trees: paths, globs, snapshots, differences, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import paths
from assayer.functions.text import SECRET_PATTERNS
from assayer.operators import snapshots
from assayer.plans import inputs
from assayer.plans.registry import derive, plain, query

_FILES, _BASE, _CURRENT = plain(inputs.FILES), plain(inputs.BASE_FILES), plain(inputs.CURRENT_FILES)
_EXCLUDED = "[" + ", ".join(f"'{name}'" for name in paths.EXCLUDED_DIRS) + "]"
_IS_EXCLUDED = f"len(list_intersect(string_split(path, '/'), {_EXCLUDED})) > 0"
_NAME = "regexp_extract(path, '[^/]*$')"


def files(spark: SparkSession, sf_dir: str, text: str = inputs.FILES) -> DataFrame:
    """Derived file table with the content as bytes."""
    return derive(spark, sf_dir, text).withColumn("content", F.encode("text", "UTF-8"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the derived base and current trees."""
    sides = (
        files(spark, sf_dir, text).select("tree_id", "path", F.sha2("content", 256).alias("sha256"), "executable")
        for text in (inputs.BASE_FILES, inputs.CURRENT_FILES)
    )
    return snapshots.snapshot_diff(*sides)


CHANGES_SQL = f"""
(SELECT coalesce(b.tree_id, c.tree_id) AS tree_id, coalesce(b.path, c.path) AS path,
        CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM {_BASE} b FULL JOIN {_CURRENT} c ON b.tree_id = c.tree_id AND b.path = c.path
 WHERE b.path IS NULL OR c.path IS NULL OR b.text <> c.text OR b.executable <> c.executable)"""


@query("P01_excluded_paths", f"SELECT tree_id, path, {_IS_EXCLUDED} AS excluded FROM {_FILES}")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, inputs.FILES).select(
        "tree_id", "path", paths.has_excluded_segment(F.col("path")).alias("excluded")
    )


@query(
    "P02_visible_tests",
    f"""SELECT tree_id, path FROM {_FILES} WHERE starts_with(path, 'tests/') OR starts_with({_NAME}, 'test_')
        OR ends_with({_NAME}, '_test.py') OR {_NAME} IN ('conftest.py', 'pytest.ini', 'pyproject.toml')""",
)
def visible_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, inputs.FILES).filter(paths.is_visible_test(F.col("path"))).select("tree_id", "path")


@query(
    "P03_core_files",
    f"""SELECT tree_id, path FROM {_FILES} WHERE {_NAME} = 'core' OR starts_with({_NAME}, 'core.')
        OR ends_with({_NAME}, '.core') ORDER BY tree_id, path""",
)
def core_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(spark, sf_dir, inputs.FILES).filter(paths.is_core_dump(F.col("path")))
    return found.select("tree_id", "path").orderBy("tree_id", "path")


NAME_GLOBS = ("tests/*", "*.py", "docs/*/core.1*", "src/*/mod_?4.py", "*[02468].txt", "*core*")


@query(
    "P04_name_globs",
    "SELECT tree_id, path, "
    + ", ".join(f"path GLOB '{glob}' AS g{i}" for i, glob in enumerate(NAME_GLOBS))
    + f" FROM {_FILES}",
)
def name_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [paths.matches_name_globs(F.col("path"), [glob]).alias(f"g{i}") for i, glob in enumerate(NAME_GLOBS)]
    return derive(spark, sf_dir, inputs.FILES).select("tree_id", "path", *flags)


TREE_GLOBS = {
    "src/*/*.py": r"^src/[^/]*/[^/]*\.py$", "**/test_*.py": r"^(.*/)?test_[^/]*\.py$",
    "tests/*": r"^tests/[^/]*$", "docs/**": r"^docs/.+$", "*.txt": r"^[^/]*\.txt$",
    "docs/*/core.[13]*": r"^docs/[^/]*/core\.[13][^/]*$",
}


@query(
    "P05_tree_globs",
    "SELECT tree_id, path, "
    + ", ".join(f"regexp_matches(path, '{regex}') AS g{i}" for i, regex in enumerate(TREE_GLOBS.values()))
    + f" FROM {_FILES}",
)
def tree_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("path").rlike(paths.tree_glob_regex(glob)).alias(f"g{i}") for i, glob in enumerate(TREE_GLOBS)]
    return derive(spark, sf_dir, inputs.FILES).select("tree_id", "path", *flags)


_RISKY = f"""
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '/' || path WHEN 1 THEN '../' || path WHEN 2 THEN 'a' || chr(92) || path
       WHEN 3 THEN '' WHEN 4 THEN 'a/../' || path WHEN 5 THEN './' WHEN 6 THEN 'a..b/' || path ELSE path END AS path
FROM ({inputs.FILES})"""


@query(
    "P06_unsafe_paths",
    f"""SELECT doc_id, path, CASE doc_id % 8 WHEN 0 THEN 'absolute' WHEN 1 THEN 'parent segment' WHEN 2 THEN 'backslash'
        WHEN 3 THEN 'empty' WHEN 4 THEN 'parent segment' WHEN 5 THEN 'empty' END AS reason FROM {plain(_RISKY)}""",
)
def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _RISKY).select("doc_id", "path", paths.unsafe_reason(F.col("path")).alias("reason"))


_ESCAPING = f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'x/../../run/' || path WHEN 1 THEN '../other/' || path
       WHEN 2 THEN '/data/run/' || path WHEN 3 THEN '/data/runner/' || path WHEN 4 THEN '../../../..' ELSE path END AS path
FROM ({inputs.FILES})"""


@query("P07_stays_inside", f"SELECT doc_id, doc_id % 6 IN (0, 2, 5) AS inside FROM {plain(_ESCAPING)}")
def stays_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = paths.stays_inside(F.lit("/data/run"), F.col("path"))
    return derive(spark, sf_dir, _ESCAPING).select("doc_id", inside.alias("inside"))


@query(
    "P13_python_files",
    f"SELECT tree_id, path FROM {_FILES} WHERE ends_with(path, '.py') AND NOT ({_IS_EXCLUDED}) AND kind <> 'symlink'",
)
def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = paths.is_python_source(F.col("path"), F.col("kind"))
    return derive(spark, sf_dir, inputs.FILES).filter(keep).select("tree_id", "path")


@query(
    "S07_build_snapshot",
    f"""SELECT tree_id, path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, executable
        FROM {_FILES} WHERE NOT ({_IS_EXCLUDED})""",
)
def build_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.build_snapshot(files(spark, sf_dir))


@query(
    "S08_tree_entries",
    f"""SELECT tree_id, path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, executable
        FROM {_FILES} ORDER BY tree_id, path""",
)
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.tree_entries(files(spark, sf_dir)).orderBy("tree_id", "path")


def _tree_hash_sql(source: str) -> str:
    """The level-by-level fold as nested aggregations."""
    folded = f"""SELECT tree_id, sha256(path) AS place, path AS ord,
        '{{"executable":' || CASE WHEN executable THEN 'true' ELSE 'false' END || ',"path":"' || path || '","sha256":"' ||
        sha256(text) || '","size":' || strlen(text) || '}}' AS txt FROM {source}"""
    for length in snapshots.FOLD_LEVELS:
        cut = f"left(place, {length})" if length else "''"
        folded = f"""SELECT tree_id, place, place AS ord, sha256(string_agg(txt, chr(10) ORDER BY ord, txt)) AS txt
                     FROM (SELECT tree_id, {cut} AS place, ord, txt FROM ({folded})) GROUP BY tree_id, place"""
    return f"(SELECT tree_id, txt AS tree_hash FROM ({folded}))"


@query(
    "H06_task_version_hash",
    f"""SELECT w.tree_id AS task_id, sha256('{{"algorithm":"task-version-hash-v1","hidden":' || coalesce('"' || h.tree_hash || '"', 'null')
          || ',"prompt_sha256":"' || sha256('prompt ' || w.tree_id) || '","solution":' || coalesce('"' || s.tree_hash || '"', 'null')
          || ',"spec_sha256":"' || sha256('spec ' || w.tree_id) || '","workspace_sha256":"' || w.tree_hash || '"}}') AS task_version_hash
        FROM {_tree_hash_sql(_FILES)} w
        LEFT JOIN {_tree_hash_sql(f"(SELECT * FROM {_FILES} WHERE starts_with(path, 'tests/'))")} h ON w.tree_id = h.tree_id
        LEFT JOIN {_tree_hash_sql(f"(SELECT * FROM {_FILES} WHERE starts_with(path, 'src/'))")} s ON w.tree_id = s.tree_id""",
)
def task_version_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = snapshots.tree_entries(files(spark, sf_dir))

    path = F.col("path")
    parts = {"workspace_sha256": F.lit(True), "hidden": path.startswith("tests/"), "solution": path.startswith("src/")}
    hashed = snapshots.part_hashes(entries, parts).withColumnRenamed("tree_id", "task_id")
    parts = hashed.withColumns(
        {
            "prompt_sha256": F.sha2(F.concat(F.lit("prompt "), "task_id"), 256),
            "spec_sha256": F.sha2(F.concat(F.lit("spec "), "task_id"), 256),
        }
    )
    return snapshots.task_version_hash(parts)


@query(
    "S11_readable_text",
    f"""SELECT doc_id, CASE WHEN kind = 'file' AND doc_id % 13 <> 0 THEN text END AS text
        FROM {_FILES}""",
)
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.unhex(F.lit("FF")), F.col("content"))
    table = files(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 13 == 0, broken).otherwise(F.col("content")))
    text = snapshots.readable_text(F.col("content"), F.col("kind"))
    return table.select("doc_id", text.alias("text"))


@query("J02_snapshot_diff", f"SELECT tree_id, path, change FROM {CHANGES_SQL}")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir)


@query(
    "J13_overlay",
    f"""SELECT coalesce(c.tree_id, b.tree_id) AS tree_id, coalesce(c.path, b.path) AS path,
        sha256(CASE WHEN c.path IS NULL THEN b.text ELSE c.text END) AS sha256
        FROM {_BASE} b FULL JOIN {_CURRENT} c ON b.tree_id = c.tree_id AND b.path = c.path""",
)
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, top = (
        files(spark, sf_dir, text).select("tree_id", "path", F.sha2("content", 256).alias("sha256"))
        for text in (inputs.BASE_FILES, inputs.CURRENT_FILES)
    )
    return snapshots.overlay(base, top)


@query(
    "A17_changed_count",
    f"""SELECT tree_id, count(*) AS changed, count(*) FILTER (WHERE change = 'added') AS added,
        count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'modified') AS modified
        FROM {CHANGES_SQL} GROUP BY tree_id""",
)
def changed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_count(changes(spark, sf_dir))


@query(
    "O05_path_sets",
    f"""SELECT 'left only' AS side, tree_id, path FROM (SELECT tree_id, path FROM {_BASE} EXCEPT SELECT tree_id, path FROM {_CURRENT})
        UNION ALL SELECT 'both', tree_id, path FROM (SELECT tree_id, path FROM {_BASE} INTERSECT SELECT tree_id, path FROM {_CURRENT})""",
)
def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = (derive(spark, sf_dir, t).select("tree_id", "path") for t in (inputs.BASE_FILES, inputs.CURRENT_FILES))
    only = base.join(current, ["tree_id", "path"], "left_anti").select(F.lit("left only").alias("side"), "tree_id", "path")
    both = base.join(current, ["tree_id", "path"], "left_semi").select(F.lit("both").alias("side"), "tree_id", "path")
    return only.unionByName(both)


@query("O06_changed_paths", f"SELECT tree_id, path FROM {CHANGES_SQL} ORDER BY tree_id, path")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_paths(changes(spark, sf_dir))


_MARKED = """
SELECT DISTINCT source || CASE WHEN CAST(substring(source, 4) AS INT) % 2 = 0 THEN '/src' ELSE '' END AS dir
FROM {documents} WHERE CAST(substring(source, 4) AS INT) % 5 <> 4
UNION SELECT DISTINCT source || '/src/pkg' AS dir FROM {documents} WHERE CAST(substring(source, 4) AS INT) % 3 = 0"""


@query(
    "J16_nearest_marked_dir",
    f"""SELECT DISTINCT dir FROM (
          SELECT p.path, arg_max(d.dir, length(d.dir)) AS dir
          FROM (SELECT tree_id || '/' || path AS path FROM {CHANGES_SQL}) p
          JOIN {plain(_MARKED)} d ON p.path = d.dir OR starts_with(p.path, d.dir || '/') GROUP BY p.path) ORDER BY dir""",
)
def nearest_marked_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = changes(spark, sf_dir).select(F.concat_ws("/", "tree_id", "path").alias("path"))
    return snapshots.nearest_marked_dir(changed, derive(spark, sf_dir, _MARKED))


_PART = 4


def _list_sql(kind: str) -> str:
    return f"coalesce(to_json(list(path ORDER BY path) FILTER (WHERE change = '{kind}')), '[]')"


@query(
    "K10_changed_files_documents",
    f"""SELECT tree_id, part, '{{"added":' || {_list_sql('added')} || ',"modified":' || {_list_sql('modified')} ||
               ',"removed":' || {_list_sql('removed')} || '}}' AS document
        FROM (SELECT *, (row_number() OVER (PARTITION BY tree_id, change ORDER BY path) - 1) // {_PART} AS part
              FROM {CHANGES_SQL}) GROUP BY tree_id, part""",
)
def changed_files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_files_documents(changes(spark, sf_dir), part_rows=_PART)


def redact_sql(text: str) -> str:
    """The fixed key patterns applied in order."""
    for pattern in SECRET_PATTERNS:
        text = f"regexp_replace({text}, '{pattern.replace('(?iu)', '(?i)')}', '<REDACTED>', 'g')"
    return text


_DIFF = """
CASE WHEN change = 'added' THEN 'Added ' || path || chr(10) WHEN change = 'removed' THEN 'Removed ' || path || chr(10)
     WHEN kind = 'symlink' THEN 'Changed binary-or-large ' || path || chr(10)
     WHEN before = after THEN ''
     ELSE '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) ||
          '@@ -' || span || ' +' || span || ' @@' || chr(10) ||
          array_to_string(list_transform(lines[greatest(1, n - 3):n - 1], lambda l: ' ' || l || chr(10)), '') ||
          '-' || lines[n] || '+' || lines[n] || ' and one more line' || chr(10) END"""


@query(
    "K11_text_diffs",
    f"""SELECT tree_id, path, change, {redact_sql('(' + _DIFF + ')')} AS diff FROM (
          SELECT *, CASE WHEN n = 1 THEN '1' ELSE greatest(1, n - 3) || ',' || least(n, 4) END AS span FROM (
            SELECT d.*, b.text AS before, c.text AS after, b.kind, string_split(b.text, chr(10)) AS lines,
                   len(string_split(b.text, chr(10))) AS n
            FROM {CHANGES_SQL} d LEFT JOIN {_BASE} b ON d.tree_id = b.tree_id AND d.path = b.path
            LEFT JOIN {_CURRENT} c ON d.tree_id = c.tree_id AND d.path = c.path))""",
)
def text_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = (files(spark, sf_dir, text) for text in (inputs.BASE_FILES, inputs.CURRENT_FILES))
    return snapshots.text_diffs(changes(spark, sf_dir), base, current)
