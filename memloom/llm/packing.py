"""Documents packed into containers of a fixed number of tokens.

Documents are spread over shards of bounded size by a hash of their id; each
shard is packed on its own, which costs at most a part of one container per
shard.  Within a shard the pieces go in descending order to the sequence that is
cheapest so far, by an estimate of linear plus quadratic attention cost, among
those with room for it.  A document is cut only if it is larger than a container.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.tokens import TOKENIZER, with_token_counts

SHARD_DOCS = 8_192
PACKS_MOST = 1_000
#: Cost of a document of n tokens: n + QUADRATIC * n * n; attention equals the rest at 1 / QUADRATIC tokens.
QUADRATIC = 1 / 12_288


def assign_by_cost(sizes, capacity: int, quadratic: float = QUADRATIC):
    """Sequence number of each piece (none larger than ``capacity``), and the number of sequences.

    Starts from as few sequences as the tokens need; a piece that no sequence has
    room for opens a new one.  Pieces of a sequence that stayed nearly empty
    move, tightest fit first, into room left elsewhere if all of them find some.
    """
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out, 0
    used = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(used + len(sizes), capacity, np.int64)
    cost = np.zeros(len(room))
    for i in np.argsort(-sizes, kind="stable"):
        n = sizes[i]
        fits = np.flatnonzero(room[:used] >= n)
        if len(fits):
            s = fits[cost[fits].argmin()]
        else:
            s = used
            used += 1
        out[i] = s
        room[s] -= n
        cost[s] += n + quadratic * n * n
    return _emptied(sizes, out, room, used)


def _emptied(sizes, out, room, used: int):
    import numpy as np

    members: dict[int, list[int]] = {}
    for i, s in enumerate(out.tolist()):
        members.setdefault(s, []).append(i)
    gone: set[int] = set()
    for s in np.argsort(-room[:used], kind="stable").tolist():
        free = room[:used].copy()
        free[[s, *gone]] = -1
        moved = []
        for i in sorted(members.get(s, ()), key=lambda i: -sizes[i]):
            fits = np.flatnonzero(free >= sizes[i])
            if not len(fits):
                break
            to = int(fits[free[fits].argmin()])
            free[to] -= sizes[i]
            moved.append((i, to))
        if len(moved) < len(members.get(s, ())):
            break  # fuller sequences will hardly do better
        for i, to in moved:
            out[i] = to
            room[to] -= sizes[i]
            members.setdefault(to, []).append(i)
        members[s] = []
        gone.add(s)
    order = np.cumsum([s not in gone for s in range(used)]) - 1
    return order[out], used - len(gone)


def _pack_shard(ids, tokens, capacity: int):
    """Rows (container, doc, piece, start, size) of one shard."""
    import numpy as np

    whole = tokens // capacity
    rest = tokens - whole * capacity
    many = whole > 0
    doc = np.repeat(np.arange(len(ids)), whole)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    loose = np.flatnonzero((rest > 0) | ~many)  # an empty text is a piece of no size
    place, _ = assign_by_cost(rest[loose], capacity)
    return (
        np.concatenate([np.arange(len(doc)), len(doc) + place]),
        ids[np.concatenate([doc, loose])],
        np.concatenate([piece, whole[loose]]),
        np.concatenate([piece * capacity, whole[loose] * capacity]),
        np.concatenate([np.full(len(doc), capacity), rest[loose]]),
    )


def pack_documents(
    docs: DataFrame, id_col: str, text_col: str, packs: Sequence[tuple[str, int]], *, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(pack_name, container, doc, piece, start_token, tokens): every text assigned for each (name, capacity).

    ``piece`` counts the pieces of a text from 0; all but texts larger than the
    container have one.  Null and empty texts are pieces of no tokens.  Rows with the
    same id are packed as texts of their own; an empty table gives an empty result.
    """
    if any(c is None or c < 1 for _, c in packs):
        raise ValueError("capacities must be positive")
    packs = [(str(n), int(c)) for n, c in packs]
    shards = max(1, -(-docs.count() // shard_docs))
    sized = with_token_counts(docs, id_col, text_col, tokenizer=tokenizer).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def pack(key, table):
        import numpy as np
        import pyarrow as pa

        ids, tokens = table.column("id").to_numpy(), table.column("tokens").to_numpy()
        order = np.lexsort((tokens, ids))
        out = []
        for name, capacity in packs:
            c, d, p, s, n = _pack_shard(ids[order], tokens[order], capacity)
            out.append(pa.table({"pack_name": pa.array([name] * len(c), pa.string()), "container": (key[0].as_py() << 32) + c, "doc": d, "piece": p, "start_token": s, "tokens": n}))
        return pa.concat_tables(out)

    # a task a shard: packing is slow against its small input, so shards must not be put together by size
    return sized.repartition(shards, "shard").groupBy("shard").applyInArrow(pack, "pack_name string, container long, doc long, piece long, start_token long, tokens long")


def pack_fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill, cost_spread): how full the containers are and how even their cost."""
    each = packed.groupBy("pack_name", "container").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") + F.lit(QUADRATIC) * F.col("tokens") * F.col("tokens")).alias("cost")
    )
    sums = each.groupBy("pack_name").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_spread")
    )
    return sums.join(F.broadcast(capacities.select("pack_name", "capacity_tokens")), "pack_name").select(
        "pack_name", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), "cost_spread"
    )


def pack_list(pack_sizes: DataFrame) -> list[tuple[str, int]]:
    """The rows of a table of pack sizes, at most ``PACKS_MOST``."""
    rows = pack_sizes.select("pack_name", "capacity_tokens").distinct().limit(PACKS_MOST + 1).collect()
    if len(rows) > PACKS_MOST:
        raise ValueError(f"more than {PACKS_MOST} packs")
    return sorted((r.pack_name, r.capacity_tokens) for r in rows)
