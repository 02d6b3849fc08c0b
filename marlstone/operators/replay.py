"""Applying a stream of inserts, updates and deletes: per-key ordered replay.

Every change becomes one or two operations on single keys (a correction removes one key and sets another), these are
partitioned by key, sorted by sequence within partitions, and run through a state machine, batch by batch.

Of the operations on a key within any part of the feed, only few can matter to its end: the last removal, the last set
after it, and, for partial updates, the last set after it that gives a column. Every input partition is thinned to these
before the shuffle, so a key that holds much of the feed costs a handful of rows an input partition, however the feed is
ordered and whatever the key's share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMOVE, SET = 0, 1


def _applied_once(table: pa.Table) -> pa.Table:
    """Without operations already applied: those with the key, sequence and kind of the one before."""
    n = table.num_rows
    if n < 2:
        return table
    same = np.ones(n - 1, bool)
    for name in ("_key", "_sequence", "_kind"):
        column = table.column(name).combine_chunks()
        same &= pa.compute.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return table.filter(pa.array(np.concatenate([[True], ~same]))) if same.any() else table


def _step(table: pa.Table, columns: Sequence[str], partial: bool, thin: bool) -> pa.Table:
    """What is left of operations sorted by key, sequence and kind: whole rows that can matter where ``thin``, else each
    key's last removal and its state."""
    table = _applied_once(table)
    n = table.num_rows
    key = table.column("_key").combine_chunks()
    changed = pa.compute.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
    kind, index = table.column("_kind").to_numpy(), np.arange(n)
    removed = np.maximum.reduceat(np.where(kind == REMOVE, index, -1), starts)
    last_set = np.maximum.reduceat(np.where(kind == SET, index, -1), starts)
    alive = last_set > removed
    sources = {}
    for name in columns if partial else ():
        given = (kind == SET) & table.column(name).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        sources[name] = np.maximum.reduceat(np.where(given, index, -1), starts)
    rows = np.concatenate([removed[removed >= 0], last_set[alive]])
    if thin:
        return table.take(pa.array(np.unique(np.concatenate([rows, *(x[x > removed] for x in sources.values())]))))
    order = np.argsort(rows, kind="stable")
    out = table.take(pa.array(rows[order]))
    for name, source in sources.items():
        take = np.concatenate([np.full((removed >= 0).sum(), -1), np.where(source > removed, source, -1)[alive]])[order]
        values = table.column(name).take(pa.array(take, mask=take < 0))
        out = out.set_column(out.schema.get_field_index(name), out.schema.field(name), values)
    return out


def _machine(columns: Sequence[str], partial: bool, *, thin: bool = False, final: bool = False):
    """The state machine over one sorted partition; only the last key's rows are carried from batch to batch."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if final:
            table = table.filter(pa.compute.equal(table.column("_kind"), SET))
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table.cast(carried.schema)]).combine_chunks()
            done = _step(table, columns, partial, thin)
            keys, most = done.column("_key"), 2 + len(columns)
            tail = 1
            while tail < min(most, done.num_rows) and keys[-tail - 1] == keys[-1]:
                tail += 1
            yield from emit(done.slice(0, done.num_rows - tail))
            carried = done.slice(done.num_rows - tail)
        if carried is not None:
            yield from emit(carried)

    return run


def operations(changes: DataFrame, *, key: str, target: str, sequence: str, action: str, columns: Sequence[str]) -> DataFrame:
    """Changes as operations on single keys.

    upsert, or a null action: set ``key``. cancel: remove ``target``, or ``key`` where that is null. correction: remove
    ``target`` if given, then set ``key``. Actions compare without case and blanks; an unknown action does nothing, as
    does an operation on a null key or one with a null sequence.
    """
    verb = F.coalesce(F.lower(F.trim(action)), F.lit("upsert"))
    own, other = F.col(key).cast("string"), F.col(target).cast("string")

    def op(condition: Column, name: Column, kind: int) -> Column:
        return F.when(condition, F.struct(name.alias("key"), F.lit(kind).alias("kind")))

    each = F.array(
        op(verb == "cancel", F.coalesce(other, own), REMOVE),
        op(verb == "correction", other, REMOVE),
        op(verb.isin("upsert", "correction"), own, SET),
    )
    return (
        changes.where(F.col(sequence).isNotNull())
        .select(F.explode(F.filter(each, lambda o: o["key"].isNotNull())).alias("_op"), F.col(sequence).alias("_sequence"), *columns)
        .select(F.col("_op.key").alias("_key"), F.col("_op.kind").alias("_kind"), "_sequence", *columns)
    )


ORDER = ("_key", "_sequence", "_kind")


def _thinned(changes: DataFrame, columns: Sequence[str], partial: bool, **names: str) -> DataFrame:
    """The feed's operations, each input partition thinned to those that can matter, placed by key and sorted."""
    clash = [c for c in columns if c.startswith("_")]
    if clash:
        raise ValueError(f"column names with a leading underscore are reserved: {clash}")
    ops = operations(changes, columns=columns, **names)
    thin = ops.sortWithinPartitions(*ORDER).mapInArrow(_machine(columns, partial, thin=True), ops.schema)
    return thin.repartition("_key").sortWithinPartitions(*ORDER)


def replay(
    changes: DataFrame,
    *,
    key: str = "event_id",
    target: str = "corrected_event_id",
    sequence: str = "sequence",
    action: str = "action",
    columns: Sequence[str] = (),
    partial: bool = False,
) -> DataFrame:
    """The records alive after all changes are applied by ascending sequence: key, sequence of the last set, columns.

    Deliveries repeated with one sequence apply once; the order of rows does not matter. With ``partial`` a null column
    of a later set keeps the value it had since the key was last removed, else a set replaces all columns.
    Extra columns are ignored, also when named like helper columns; an empty feed gives an empty table.
    """
    placed = _thinned(changes, columns, partial, key=key, target=target, sequence=sequence, action=action)
    state = placed.mapInArrow(_machine(columns, partial, final=True), placed.schema)
    return state.select(F.col("_key").alias(key), F.col("_sequence").alias(sequence), *columns)


def compacted(changes: DataFrame, *, columns: Sequence[str] = (), partial: bool = False, settled: int | None = None) -> DataFrame:
    """A change feed in the same form (event_id, corrected_event_id, sequence, action, columns) and with the same outcome,
    reduced to what can matter of each key: a removal, a set, and with ``partial`` a set for each column, to which changes
    of any sequence can be added. Removals up to the sequence ``settled``, before which nothing more is to come, go too.
    """
    placed = _thinned(changes, columns, partial, key="event_id", target="corrected_event_id", sequence="sequence", action="action")
    kept = placed.mapInArrow(_machine(columns, partial, thin=True), placed.schema)
    if settled is not None:
        kept = kept.where((F.col("_kind") == SET) | (F.col("_sequence") > settled))
    verb = F.when(F.col("_kind") == REMOVE, "cancel").otherwise("upsert")
    return kept.select(F.col("_key").alias("event_id"), F.lit(None).cast("string").alias("corrected_event_id"), F.col("_sequence").alias("sequence"), verb.alias("action"), *columns)
