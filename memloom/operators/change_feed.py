"""Replay of a change feed: inserts, updates and deletes, repeated and out of order.

The feed is range-partitioned by key and order and sorted within partitions, so
a key that holds a large part of the feed is cut over several tasks.  Each task
replays its rows in order with a small state machine (apply, patch, delete,
skip what was applied already) over Arrow batches and hands on one partial
state per key; the partial states of a key, at most one per task, are then
folded in order.  Partial states compose, so the cut points don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.keys import trimmed

# The words of the feed's origins for a deletion.
DELETE_WORDS = ("delete", "deleted", "del", "d", "remove", "removed", "rm", "tombstone", "purge", "drop")


def is_delete(op: Column | str, deleted_at: Column | str | None = None) -> Column:
    """True where the operation's word says so or a deletion time is set; never null."""
    said = F.coalesce(F.lower(trimmed(op)).isin(*DELETE_WORDS), F.lit(False))
    if deleted_at is None:
        return said
    at = F.col(deleted_at) if isinstance(deleted_at, str) else deleted_at
    return said | at.isNotNull()


def _replayer(n_order: int, n_values: int, patch: bool):
    """The state machine over sorted Arrow batches.

    Columns: key, order columns, deleted, reset, values.  A row is one change
    or, at the head of a batch, the state carried over from the batch before.
    """

    def replay(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        first_value = 3 + n_order
        carried = None

        def changed(column) -> np.ndarray:
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.fill_null(pc.not_equal(a, b), True)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            return pc.and_not(differs, both_null).to_numpy(zero_copy_only=False)

        def fold(t: pa.Table) -> pa.Table:
            n = t.num_rows
            columns = [t.column(i).combine_chunks() for i in range(t.num_columns)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            new_key = np.ones(n, bool)
            new_key[1:] = changed(columns[0])
            new_event = new_key.copy()
            for i in range(1, 1 + n_order):
                new_event[1:] |= changed(columns[i])
            if not new_event.all():  # changes that were applied already
                keep = pa.array(np.flatnonzero(new_event))
                columns = [c.take(keep) for c in columns]
                new_key = new_key[new_event]
                n = len(new_key)
            start = np.flatnonzero(new_key)
            end = np.append(start[1:], n) - 1
            deleted = columns[1 + n_order].to_numpy(zero_copy_only=False)
            reset = columns[2 + n_order].to_numpy(zero_copy_only=False) | deleted
            at = np.arange(n)
            last_reset = np.maximum.accumulate(np.where(reset, at, -1))[end]
            out = [c.take(pa.array(end)) for c in columns[: 2 + n_order]]
            out.append(pa.array(last_reset >= start))
            for c in columns[first_value:]:
                if patch:
                    valid = c.is_valid().to_numpy(zero_copy_only=False)
                    last = np.maximum.accumulate(np.where(valid, at, -1))[end]
                    # a reset row that carries values (a folded state) keeps its own
                    ok = last >= np.maximum(start, last_reset)
                    out.append(c.take(pa.array(last, mask=~ok)))
                else:
                    out.append(c.take(pa.array(end)))
            return pa.Table.from_arrays(out, names=t.column_names)

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            schema = table.schema
            if carried is not None:
                table = pa.concat_tables([carried, table])
            folded = fold(table).cast(schema)
            if folded.num_rows > 1:
                yield from folded.slice(0, folded.num_rows - 1).combine_chunks().to_batches()
            carried = folded.slice(folded.num_rows - 1)
        if carried is not None:
            yield from carried.combine_chunks().to_batches()

    return replay


def replay_changes(
    feed: DataFrame,
    *,
    key: Column | str,
    order: Sequence[Column | str],
    deleted: Column,
    values: Sequence[str],
    tie: Sequence[str] = (),
    patch: bool = False,
    key_name: str = "key",
    keep_deleted: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """The current state of the table behind a change feed, one row per live key.

    ``order`` ranks the changes of a key, nulls first; a change whose order
    equals the one before it was applied already and is skipped (the first by
    ``tie`` counts).  With ``patch`` a null value leaves the field as it is and a
    delete forgets all fields; otherwise every change writes the whole row.
    Order columns must be integers or timestamps.  ``keep_deleted`` returns the
    deleted keys too, flagged in ``is_deleted``.

    Rows whose key is null or blank are no changes.  An empty feed gives an empty
    table.  The result has ``key_name``, ``order_0``.. and the value columns, so
    names in the feed that clash with these are of no account.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    k = trimmed(as_col(key).cast("string"))
    n_order = len(order)
    ranks = [f"__o{i}" for i in range(n_order)]
    held = [f"__v{i}" for i in range(len(values))]
    ties = [f"__t{i}" for i in range(len(tie))]

    def rank(c: Column | str) -> Column:
        c = as_col(c)
        kind = feed.select(c.alias("c")).schema[0].dataType
        c = F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("long")
        return F.coalesce(c, F.lit(-(2**63)).cast("long"))

    gone = F.coalesce(deleted, F.lit(False))
    changes = feed.select(
        k.alias("__k"),
        *[rank(c).alias(n) for c, n in zip(order, ranks)],
        gone.alias("__deleted"),
        F.lit(False).alias("__reset"),
        *[(F.when(~gone, F.col(f"`{c}`")) if patch else F.col(f"`{c}`")).alias(n) for c, n in zip(values, held)],
        *[F.col(f"`{c}`").alias(n) for c, n in zip(tie, ties)],
    ).filter(F.col("__k") != "")
    by = ["__k", *ranks]
    n = partitions or int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = changes.repartitionByRange(n, *by).sortWithinPartitions(*by, *ties).drop(*ties)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields])
    states = ranged.mapInArrow(_replayer(n_order, len(values), patch), schema)

    state = F.struct(*ranks, "__deleted", "__reset", *held)
    if patch:
        # at most one state per range partition and key
        steps = F.array_sort(F.collect_list(state))
        kinds = {f.name: f.dataType for f in ranged.schema.fields}
        start = F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in [*ranks, "__deleted", "__reset", *held]])

        def step(acc: Column, x: Column) -> Column:
            return F.struct(
                *[x[c].alias(c) for c in [*ranks, "__deleted", "__reset"]],
                *[F.when(x["__reset"], x[c]).otherwise(F.coalesce(x[c], acc[c])).alias(c) for c in held],
            )

        merged = states.groupBy("__k").agg(F.aggregate(steps, start, step).alias("s"))
    else:
        merged = states.groupBy("__k").agg(F.max_by(state, F.struct(*ranks)).alias("s"))
    out = merged.select(
        F.col("__k").alias(key_name),
        *[F.when(F.col(f"s.{r}") != -(2**63), F.col(f"s.{r}")).alias(f"order_{i}") for i, r in enumerate(ranks)],
        F.col("s.__deleted").alias("is_deleted"),
        *[F.col(f"s.{h}").alias(c) for c, h in zip(values, held)],
    )
    return out if keep_deleted else out.filter(~F.col("is_deleted")).drop("is_deleted")


def current_memories(feed: DataFrame) -> DataFrame:
    """The replica's live memories: ``memory_feed`` replayed by (updated_at, seq)."""
    return replay_changes(
        feed,
        key="mem_key",
        order=["updated_at", "seq"],
        tie=["feed_id"],
        deleted=is_delete("op", "deleted_at"),
        values=["seq", "content", "category", "importance", "trust", "source", "origin", "updated_at", "project_id"],
        key_name="mem_key",
    ).drop("order_0", "order_1")
