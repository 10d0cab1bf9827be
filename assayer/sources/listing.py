"""Listing file trees on storage that all executors mount, with what only the file system knows.

A round hands the open directories out to tasks; a task walks down from each of its directories until it has
listed ``DIRECTORIES`` of them and hands back what it did not get to, so a tree of any shape is spread again
every round. Excluded directories are neither listed nor entered, and nothing is opened while listing.
Contents are read afterwards, for the rows that are still wanted, or hashed in pieces without being held.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.paths import EXCLUDED_DIRS
from assayer.session import store_table

DIRECTORIES = 1000  # directories a task lists below one open directory and round
_ROWS = 5000
_BYTES = 16 << 20
_PIECE = 1 << 20

_COLUMNS = ("tree_id", "root", "path", "kind", "mode", "size", "target")


def _text(name: str) -> str:
    """A name as valid text; bytes that are not UTF-8 become question marks."""
    return name.encode("utf-8", "replace").decode("utf-8")


def _walk(root: str, start: str, excluded: frozenset[str], most: int) -> Iterator[tuple]:
    """(path, kind, mode, size, target) of what lies below a directory; directories not reached are ``open``."""
    waiting, listed = [start], 0
    while waiting and listed < most:
        place = waiting.pop()
        listed += 1
        with os.scandir(os.path.join(root, place)) as entries:
            for entry in entries:
                path = f"{place}/{entry.name}" if place else entry.name
                info = entry.stat(follow_symlinks=False)
                if stat.S_ISDIR(info.st_mode):
                    if entry.name not in excluded:
                        waiting.append(path)
                elif entry.name in excluded or entry.is_dir():
                    continue  # a link to a directory is neither entered nor a file
                elif stat.S_ISLNK(info.st_mode):
                    target = _text(os.readlink(os.path.join(root, path)))
                    yield path, "link", info.st_mode, len(target.encode()), target
                elif stat.S_ISREG(info.st_mode):
                    yield path, "file", info.st_mode, info.st_size, None
                else:
                    yield path, "special", info.st_mode, 0, None
    for place in waiting:
        yield place, "open", 0, 0, None


def list_trees(trees: DataFrame, excluded: Sequence[str] = EXCLUDED_DIRS, directories: int = DIRECTORIES) -> DataFrame:
    """(tree_id, root, path, kind, mode, size, target) of every file below the roots of (tree_id, root) rows.

    ``kind`` is file, link or special; ``mode`` holds the type and permission bits; ``target`` is a link's text.
    """
    kind = trees.schema["tree_id"].dataType.simpleString()
    schema = f"tree_id {kind}, root string, path string, kind string, mode int, size long, target string"
    skipped, cores = frozenset(excluded), trees.sparkSession.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            for tree, root, start in zip(frame["tree_id"], frame["root"], frame["path"]):
                for found in _walk(root, start, skipped, directories):
                    rows.append((tree, root, *found))
                    if len(rows) >= _ROWS:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    waiting, found = trees.select("tree_id", "root", F.lit("").alias("path")), None
    while True:
        listed = store_table(waiting.repartition(cores).mapInPandas(run, schema), "listing")
        files = listed.filter("kind <> 'open'")
        found = files if found is None else found.unionByName(files)
        waiting = listed.filter("kind = 'open'").select("tree_id", "root", "path")
        if waiting.isEmpty():
            return found


def read_contents(listing: DataFrame) -> DataFrame:
    """The rows of a listing in the shape of ``schemas.FILE``: a link's content is its target, a special file's its type."""
    kind = listing.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree_id", "path", "kind", "sha256", "size", "executable", "content"]
        for batch in batches:
            start, out, held = 0, [], 0
            for at, row in enumerate(batch.to_pylist()):
                out.append(_content(row))
                held += len(out[-1])
                if held >= _BYTES or at == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    digests = [hashlib.sha256(_hashed(k, c)).hexdigest() for k, c in zip(part["kind"].to_pylist(), out)]
                    modes = [bool(m & 0o111) for m in part["mode"].to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part["tree_id"], part["path"], part["kind"], pa.array(digests), part["size"], pa.array(modes), pa.array(out, pa.binary())], names
                    )
                    start, out, held = at + 1, [], 0

    schema = f"tree_id {kind}, path string, kind string, sha256 string, size long, executable boolean, content binary"
    return listing.mapInArrow(run, schema)


def _content(row: dict) -> bytes:
    if row["kind"] == "link":
        return row["target"].encode("utf-8")
    if row["kind"] == "special":
        return str(stat.S_IFMT(row["mode"])).encode()
    with open(os.path.join(row["root"], row["path"]), "rb") as stream:
        return stream.read()


def _hashed(kind: str, content: bytes) -> bytes:
    """What a snapshot hashes of a file."""
    return b"special:" + content if kind == "special" else content


def hash_trees(listing: DataFrame) -> DataFrame:
    """(tree_id, path, sha256, size, executable) of a listing, as ``snapshots.build_snapshot`` gives it, a piece of a file at a time."""
    kind = listing.schema["tree_id"].dataType.simpleString()

    def digest(row: dict) -> str:
        if row["kind"] != "file":
            return hashlib.sha256(_hashed(row["kind"], _content(row))).hexdigest()
        found = hashlib.sha256()
        with open(os.path.join(row["root"], row["path"]), "rb") as stream:
            while piece := stream.read(_PIECE):
                found.update(piece)
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            columns = [batch["tree_id"], batch["path"], pa.array([digest(r) for r in rows], pa.string()), batch["size"], pa.array([bool(r["mode"] & 0o111) for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["tree_id", "path", "sha256", "size", "executable"])

    return listing.mapInArrow(run, f"tree_id {kind}, path string, sha256 string, size long, executable boolean")
