"""Canonical JSON, content keys and deterministic seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import iso_utc

SEED_MODULUS = 2147483648


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted names; nulls are written, non-ASCII is kept.

    Payloads that are hashed should hold only strings and integers: floats and
    control characters have no spelling shared by all JSON writers.
    """
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_json_map(entries: Column) -> Column:
    """Compact JSON of a map column, keys sorted."""
    return F.to_json(
        F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"}
    )


def ascii_json(text: Column) -> Column:
    """Escapes the non-ASCII characters of a JSON text as ``\\uXXXX`` (UTF-16 units)."""
    def escape(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike(r"^[\x00-\x7f]"), char).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    return F.when(
        text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(text, ""), escape), "")
    ).otherwise(text)


def seed_from(payload: Column, base_seed: Column) -> Column:
    """``(sha256(payload) + base_seed) mod 2^31``; only the low 32 bits of the digest matter."""
    low_bits = F.conv(F.right(F.sha2(payload, 256), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(low_bits + base_seed.cast("bigint"), F.lit(SEED_MODULUS).cast("bigint"))


def run_seed(base_seed: Column, task_id: Column, agent: Column, repeat: Column) -> Column:
    """Seed of one (task, agent, repeat) cell."""
    return seed_from(F.concat_ws(":", base_seed.cast("string"), task_id, agent, repeat.cast("string")), base_seed)


def check_seed(base_seed: Column, task_id: Column) -> Column:
    """Seed shared by all agents for the checks of one task."""
    return seed_from(F.concat_ws(":", base_seed.cast("string"), task_id, F.lit("checks")), base_seed)


def run_key(
    task_id: Column,
    agent: Column,
    repeat: Column,
    seed: Column,
    task_version_hash: Column,
    env_manifest_hash: Column,
) -> Column:
    """Content key of one cell; equal keys mean the same work."""
    payload = canonical_json(
        task_id=task_id, agent=agent, repeat=repeat, seed=seed,
        task_version_hash=task_version_hash, env_manifest_hash=env_manifest_hash,
    )
    return F.sha2(payload, 256)


def aggregate_key(task_id: Column, agent: Column) -> Column:
    """Content key of one (task, agent) aggregate."""
    return F.sha2(canonical_json(task_id=task_id, agent=agent), 256)


def env_manifest_hash(manifest: Column) -> Column:
    """Hash of a string map that describes an environment."""
    return F.sha2(canonical_json_map(manifest), 256)


def run_id(
    started_at: Column,
    agents: Column,
    tasks: Column,
    repeats: Column,
    sandbox: Column,
    pid: Column,
    sequence: Column,
) -> Column:
    """Sortable id ``YYYYMMDDTHHMMSSZ-xxxxxxxx`` whose suffix hashes the run's parameters."""
    stamp = F.date_format(started_at, "yyyyMMdd'T'HHmmss'Z'")
    payload = canonical_json(
        agents=agents, pid=pid, repeats=repeats, sandbox=sandbox,
        sequence=sequence, tasks=tasks, timestamp=stamp,
    )
    return F.concat_ws("-", stamp, F.left(F.sha2(payload, 256), F.lit(8)))


__all__ = [
    "aggregate_key", "ascii_json", "canonical_json", "canonical_json_map", "check_seed",
    "env_manifest_hash", "iso_utc", "run_id", "run_key", "run_seed", "seed_from",
]
