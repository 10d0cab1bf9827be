"""Keyed snapshots of file trees: content hashes, differences, versions, text diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.keys import canonical_json
from assayer.functions.paths import EXCLUDED_DIRS, has_excluded_segment
from assayer.functions.text import scrub
from assayer.operators.ordered import list_parts
from assayer.operators.scrubbing import scrub_with_registry
from assayer.session import store_table

# Prefix lengths of the hashed path at which a tree's entries are folded, widest first.
FOLD_LEVELS = (5, 2, 0)


def build_snapshot(files: DataFrame, excluded: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """(tree, path, sha256, size, executable) of every file outside excluded directories.

    A link is hashed by its target text; a special file by its type number. Both
    are given in ``content``, which is read for the surviving paths only.
    """
    content = F.when(
        F.col("kind") == "special", F.concat(F.lit("special:"), F.col("content").cast("string")).cast("binary")
    ).otherwise(F.col("content"))
    size = F.when(F.col("kind") == "special", F.lit(0)).otherwise(F.octet_length("content"))
    return files.filter(~has_excluded_segment(F.col("path"), excluded)).select(
        "tree_id", "path", F.sha2(content, 256).alias("sha256"), size.cast("bigint").alias("size"), "executable"
    )


def snapshot_diff(
    base: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("tree_id", "path"),
    compare: Sequence[str] = ("sha256", "executable"),
) -> DataFrame:
    """Rows added, removed or modified between two keyed snapshots of any table.

    One full outer equi-join on the (unique) keys; compared columns are null-safe.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *keys, F.lit(True).alias(f"__{name}"), *[F.col(c).alias(f"__{name}_{c}") for c in compare]
        )

    both = side(base, "base").join(side(current, "current"), list(keys), "full_outer")
    same = F.lit(True)
    for column in compare:
        same = same & F.col(f"__base_{column}").eqNullSafe(F.col(f"__current_{column}"))
    change = (
        F.when(F.col("__base").isNull(), "added")
        .when(F.col("__current").isNull(), "removed")
        .when(~same, "modified")
    )
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def changed_paths(changes: DataFrame) -> DataFrame:
    """All changed paths in stable order."""
    return changes.select("tree_id", "path").orderBy("tree_id", "path")


def changed_count(changes: DataFrame) -> DataFrame:
    """Changed files per tree, in all and by kind of change."""
    return changes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("changed"),
        *[F.count_if(F.col("change") == kind).alias(kind) for kind in ("added", "removed", "modified")],
    )


def overlay(base: DataFrame, top: DataFrame, keys: Sequence[str] = ("tree_id", "path")) -> DataFrame:
    """Rows of ``base`` with those of ``top`` laid over them; nothing is deleted.

    An anti join on the keys alone: the contents of ``base`` are only shuffled
    when the keys of ``top`` are too many to broadcast.
    """
    kept = base.join(top.select(*keys), list(keys), "left_anti")
    return kept.unionByName(top.select(*base.columns))


def changed_files_parts(changes: DataFrame, registry: Column | None = None, part_rows: int = 10_000) -> DataFrame:
    """Sorted, scrubbed path lists per (tree, change), in parts of bounded length."""
    parts = list_parts(changes, ["tree_id", "change"], "path", part_rows)
    return parts.withColumn("path", F.transform("path", lambda p: scrub(p, registry)))


def changed_files_documents(changes: DataFrame, registry: Column | None = None, part_rows: int = 10_000) -> DataFrame:
    """The parts as JSON objects with ``added``, ``modified`` and ``removed`` lists."""
    parts = changed_files_parts(changes, registry, part_rows)
    empty = F.array().cast("array<string>")

    def of(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("change") == kind, F.col("path"))), empty).alias(kind)

    lists = parts.groupBy("tree_id", "part").agg(of("added"), of("modified"), of("removed"))
    return lists.select("tree_id", "part", F.to_json(F.struct("added", "modified", "removed")).alias("document"))


def readable_text(content: Column, kind: Column, limit: int | None = None) -> Column:
    """Text of a regular UTF-8 file, up to ``limit`` bytes if one is set; null for anything else."""
    text = content.cast("string")
    fits = kind == "file" if limit is None else (kind == "file") & (F.octet_length(content) <= limit)
    return F.when(fits & F.is_valid_utf8(text), text)


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        diffs = []
        for path, before, after in zip(batch["path"], batch["before"], batch["after"]):
            if before is None or after is None:
                diffs.append(f"Changed binary-or-large {path}\n")
                continue
            names = f"a/{path}", f"b/{path}"
            text = "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), *names))
            diffs.append(text if not text or text.endswith("\n") else text + "\n")
        yield batch[["tree_id", "path", "change"]].assign(diff=diffs)


def text_diffs(
    changes: DataFrame,
    base: DataFrame,
    current: DataFrame,
    secrets: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Unified diff per changed file; a marker line where either side has no text.

    Only modified files need texts. They come by inner joins, so a small set of
    changes is broadcast to the files instead of shuffling the files, and only
    pairs of texts, bounded if ``limit`` is set, reach the Python workers.
    """
    def texts(files: DataFrame, name: str) -> DataFrame:
        return files.select("tree_id", "path", readable_text(F.col("content"), F.col("kind"), limit).alias(name))

    modified = changes.filter(F.col("change") == "modified")
    paired = modified.join(texts(base, "before"), ["tree_id", "path"]).join(texts(current, "after"), ["tree_id", "path"])
    tree_type = changes.schema["tree_id"].dataType.simpleString()
    compared = paired.select("tree_id", "path", "change", "before", "after").mapInPandas(
        _unified, f"tree_id {tree_type}, path string, change string, diff string"
    )
    line = F.concat(F.initcap("change"), F.lit(" "), "path", F.lit("\n"))
    one_sided = changes.filter(F.col("change") != "modified").select("tree_id", "path", "change", line.alias("diff"))
    diffs = compared.unionByName(one_sided)
    if secrets is None:
        return diffs.withColumn("diff", scrub(F.col("diff")))
    return scrub_with_registry(diffs, "diff", secrets)


def tree_entries(files: DataFrame) -> DataFrame:
    """Ordered inventory of each tree: (path, sha256, size, executable)."""
    return files.select(
        "tree_id", "path", F.sha2(F.col("content"), 256).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("size"), "executable",
    )


def tree_hash(entries: DataFrame, keys: Sequence[str] = ("tree_id",)) -> DataFrame:
    """Content hash of a keyed group of files.

    Entries are folded level by level along prefixes of their hashed path, each
    level sorted by path or prefix, so a group of any size is hashed without one
    task ever holding it whole.
    """
    entry = canonical_json(
        executable=F.col("executable"), path=F.col("path"), sha256=F.col("sha256"), size=F.col("size")
    )
    folded = entries.select(
        *keys, F.sha2(F.col("path"), 256).alias("__place"), F.col("path").alias("__order"), entry.alias("__text")
    )
    for length in FOLD_LEVELS:
        folded = (
            folded.withColumn("__place", F.left("__place", F.lit(length)))
            .groupBy(*keys, "__place")
            .agg(F.array_sort(F.collect_list(F.struct("__order", "__text"))).alias("__members"))
            .select(
                *keys, "__place", F.col("__place").alias("__order"),
                F.sha2(F.array_join(F.col("__members.__text"), "\n"), 256).alias("__text"),
            )
        )
    return folded.select(*keys, F.col("__text").alias("tree_hash"))


def part_hashes(entries: DataFrame, parts: Mapping[str, Column], keys: Sequence[str] = ("tree_id",)) -> DataFrame:
    """One column of content hashes for each part of a group; a part is a condition on its entries.

    Entries are tagged with the parts they belong to and folded once for all of them. A part without entries has none.
    """
    tags = F.filter(F.array(*[F.when(inside, F.lit(name)) for name, inside in parts.items()]), lambda tag: tag.isNotNull())
    hashed = tree_hash(entries.withColumn("__part", F.explode(tags)), (*keys, "__part"))
    return hashed.groupBy(*keys).agg(*[F.max(F.when(F.col("__part") == name, F.col("tree_hash"))).alias(name) for name in parts])


def task_version_hash(parts: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Hash that changes with any part of a task.

    ``parts`` has one row per task with the hashes ``hidden``, ``prompt_sha256``,
    ``solution``, ``spec_sha256`` and ``workspace_sha256``.
    """
    names = ("hidden", "prompt_sha256", "solution", "spec_sha256", "workspace_sha256")
    payload = canonical_json(algorithm=F.lit("task-version-hash-v1"), **{name: F.col(name) for name in names})
    return parts.select(*keys, F.sha2(payload, 256).alias("task_version_hash"))


def nearest_marked_dir(changed: DataFrame, marked_dirs: DataFrame) -> DataFrame:
    """Deepest directory with a marker file at or above each changed path, distinct.

    ``marked_dirs`` has one ``dir`` per row. Paths climb together, a directory a
    round: those that are marked are done, the others go on as their different
    parents, so no directory is looked up twice and the root at most once. The
    rounds are the depth of the deepest path, and shrink quickly.
    """
    marked = store_table(marked_dirs.select("dir").distinct(), "marked-dirs")
    found, left = marked.limit(0), changed.select(F.col("path").alias("dir")).distinct()
    while True:
        left = store_table(left, "unmarked-dirs")
        found = found.unionByName(left.join(marked, "dir", "left_semi"))
        above = left.filter("dir <> ''").join(marked, "dir", "left_anti")
        if above.isEmpty():
            return found.distinct().orderBy("dir")
        left = above.select(F.regexp_extract("dir", "(?s)^(.*)/", 1).alias("dir")).distinct()
