"""Replay of an append / undo / redo log per entity as a stateful stream.

The value of an entity is a tape of appended pieces and a cursor. A micro-batch
brings a bounded slice of the log, and the state holds the tape, not the log, so
an entity with most of the log never has to fit into one task at once.

Entities are advanced a bucket at a time: a call of the stateful function costs milliseconds however little it
does, and there are at most ``BUCKETS`` calls a micro-batch, whatever the number of entities. A bucket's tapes
are one state row, which is written again when one of its entities changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 2_048  # fixed for a checkpoint, whose state is keyed by them


def replay(tape: list[str], cursor: int, operations: Iterable[tuple[str, str]]) -> tuple[list[str], int]:
    """Tape and cursor after a slice of operations."""
    tape = list(tape)
    for kind, piece in operations:
        if kind == "append":
            tape[cursor:] = [piece]
            cursor += 1
        elif kind == "undo":
            cursor = max(0, cursor - 1)
        elif kind == "redo":
            cursor = min(len(tape), cursor + 1)
    return tape, cursor


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
    log = pd.concat(list(batches)).sort_values("position")
    fresh: dict[str | None, list[tuple[str, str]]] = {}
    for entity, kind, piece in zip(log["entity"], log["kind"], log["piece"]):
        fresh.setdefault(entity, []).append((kind, piece))
    values = []
    for entity, operations in fresh.items():
        tape, cursor, seen = kept.get(entity, ([], 0, 0))
        tape, cursor = replay(list(tape), cursor, operations)
        kept[entity] = tape, cursor, seen + len(operations)
        values.append(("".join(tape[:cursor]), seen + len(operations)))
    state.update((list(kept), *map(list, zip(*kept.values()))))
    texts, counts = zip(*values)
    yield pd.DataFrame({"entity": pd.Series(list(fresh), dtype=object), "value": texts, "operations": counts})


def replay_edits(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Current value per entity whenever a micro-batch brings operations for it.

    ``log(entity, position, kind, piece)`` is a stream whose files arrive in log
    order; within a micro-batch the order is taken from ``position``.
    """
    key = log.schema["entity"].dataType.simpleString()
    # as text, because pandas turns numbers beside a null into floats
    named = log.select(
        F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket"), F.col("entity").cast("string").alias("entity"), "position", "kind", "piece"
    )
    replayed = named.groupBy("bucket").applyInPandasWithState(
        _advance,
        "entity string, value string, operations long",
        "entities array<string>, tapes array<array<string>>, cursors array<int>, seen array<long>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
    return replayed.select(F.col("entity").cast(key).alias("entity"), "value", "operations")
