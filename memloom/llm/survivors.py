"""One surviving record per group of duplicates, chosen field by field.

Fields are unpivoted to long rows (group, field, value, member), votes are summed
per normalised value, the best value of each (group, field) wins and the winners
are pivoted back.  All is aggregated as it comes (partial aggregation before
the shuffle), so a group may hold any part of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.keys import has_value, trimmed, unit_interval


def member_rank(key: str, trust: str = "trust", importance: str = "importance", updated_at: str = "updated_at") -> Column:
    """A struct that is smallest for the first member: highest trust, highest importance, latest, smallest key.

    Trust or importance that is null, NaN or outside 0..1 ranks last, so does a null time.
    """
    return F.struct(
        F.coalesce(-unit_interval(trust), F.lit(2.0)).alias("t"),
        F.coalesce(-unit_interval(importance), F.lit(2.0)).alias("i"),
        F.coalesce(-F.unix_micros(F.col(updated_at)), F.lit(2**63 - 1)).alias("u"),
        F.col(key).alias("k"),
    )


def unpivot_fields(members: DataFrame, group: str, key: str, fields: Mapping[str, tuple[Column, Column]], rank: Column, weight: Column) -> DataFrame:
    """Long rows (group_key, field_name, field_value, cost, rank, weight, from_key); rows without a value are left out.

    ``fields`` gives each field its value as a string (null: none) and a number
    that is smaller the better the value suits the field; ties go to the better rank.
    """
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("field_value"), cost.cast("double").alias("cost"))
            for name, (value, cost) in fields.items()
        ]
    )
    return (
        members.select(F.col(f"`{group}`").alias("group_key"), F.col(f"`{key}`").alias("from_key"), rank.alias("rank"), weight.alias("weight"), F.explode(rows).alias("f"))
        .select("group_key", "f.*", "rank", "weight", "from_key")
        .filter(F.col("field_value").isNotNull())
    )


def winning_values(long: DataFrame, weight: Column, *, by_votes: bool = True) -> DataFrame:
    """(group_key, field_name, field_value, from_key, votes, members): of each group and field the value that wins, and how many members have one.

    A vote is ``weight`` of its row, summed per normalised value: values are the
    same if they are equal when trimmed and lower-cased.  Of a value's spellings the one
    with the smallest (cost, rank) stands for it.  The value with the most votes wins, equal
    votes go to the better stand-in; or, without ``by_votes``, the value with the best
    stand-in wins and its votes are reported.
    """
    stands = F.struct("cost", "rank", "field_value", "from_key")
    votes = (
        long.withColumn("norm", F.lower(trimmed("field_value")))
        .withColumns({"n1": F.xxhash64("norm"), "n2": F.xxhash64(F.lit(7), "norm")})  # long texts are told apart by 128 bits
        .groupBy("group_key", "field_name", "n1", "n2")
        .agg(F.round(F.sum(weight), 9).alias("votes"), F.count("*").alias("n"), F.min(stands).alias("best"))
    )
    score = F.struct((-F.col("votes")).alias("minus"), "best.rank") if by_votes else F.struct("best.cost", "best.rank")
    won = votes.groupBy("group_key", "field_name").agg(F.min_by(F.struct("best.field_value", "best.from_key", "votes"), score).alias("w"), F.sum("n").alias("members"))
    return won.select("group_key", "field_name", "w.*", "members")


def pivot_fields(winners: DataFrame, fields: Sequence[str], columns: Sequence[str] = ("field_value",)) -> DataFrame:
    """One row per group: for each field a column, or, with several ``columns``, a struct of them; null where no member has a value."""
    held = F.first(columns[0]) if len(columns) == 1 else F.first(F.struct(*columns))
    return winners.groupBy("group_key").pivot("field_name", list(fields)).agg(held)


def grouped_members(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """Live memories with the ``group_key`` of their key; groups: mem_key, group_key."""
    needed = ["mem_id", "mem_key", "content", "category", "importance", "trust", "source", "updated_at", "project_id"]
    live = memories.filter(F.col("deleted_at").isNull()).select(*[c for c in needed if c in memories.columns])
    return live.join(groups.select("mem_key", "group_key"), "mem_key")


def vote_weight(as_of: str, half_life_days: float = 90.0) -> Column:
    """A member's vote: its trust (0.5 if unusable), halved for every ``half_life_days`` since its update; a null time counts as very old."""
    age = F.greatest(F.lit(0.0), (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("updated_at")) / 86400.0)
    return F.coalesce(unit_interval("trust"), F.lit(0.5)) * F.pow(F.lit(0.5), F.coalesce(age, F.lit(3650.0)) / half_life_days)


def memory_fields() -> dict[str, tuple[Column, Column]]:
    """The fields of a surviving memory with what a value costs: canonical key, longest content, source and latest project."""
    latest = F.coalesce(-F.unix_micros("updated_at").cast("double"), F.lit(float("inf")))
    value = lambda c: F.when(has_value(c), F.col(c))
    return {
        "canonical": (F.col("mem_key"), F.lit(0.0)),
        "content": (value("content"), -F.char_length("content")),
        "source": (value("source"), F.lit(0.0)),
        "project_id": (value("project_id"), latest),
    }


def choose_survivors(memories: DataFrame, groups: DataFrame, *, least_members: int = 2, as_of: str = "2026-12-31 00:00:00") -> DataFrame:
    """One row per group with enough live members: a struct (field_value, from_key, votes) for each field of :func:`memory_fields`.

    Fields are unpivoted, votes summed per normalised value, the winners pivoted back.  Winners
    are the values of the best (cost, rank): fixed rules, which no sum of votes can
    follow; the votes say how far the members agree.  Fields without any value are null; groups
    without live members, and an empty table, give no rows.  Every member has a canonical value, so ``canonical.members`` is the size of the group.
    """
    weight = vote_weight(as_of)
    members = grouped_members(memories, groups)
    fields = memory_fields()
    long = unpivot_fields(members, "group_key", "mem_key", fields, member_rank("mem_key"), weight)
    wide = pivot_fields(winning_values(long, F.col("weight"), by_votes=False), list(fields), ("field_value", "from_key", "votes", "members"))
    return wide.filter(F.col("canonical.members") >= least_members)


def survivor_fields(survivors: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(group_key, field_name, field_value, from_key, votes): the fields of survivors as long rows, those without a value left out."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in fields])
    long = survivors.select("group_key", F.explode(rows).alias("r")).filter("r.v IS NOT NULL")
    return long.select("group_key", "r.field_name", "r.v.field_value", "r.v.from_key", "r.v.votes")


def vote_survivors(memories: DataFrame, groups: DataFrame, *, as_of: str, half_life_days: float = 90.0) -> DataFrame:
    """One row per group: each field's value by source trust times recency decay, summed per normalised value (:func:`vote_weight`)."""
    members = grouped_members(memories, groups)
    names = ["canonical", "content", "category", "source", "project_id"]
    fields = {n: (F.col("mem_key") if n == "canonical" else F.when(has_value(n), F.col(n)), F.lit(0.0)) for n in names}
    long = unpivot_fields(members, "group_key", "mem_key", fields, member_rank("mem_key"), vote_weight(as_of, half_life_days))
    return pivot_fields(winning_values(long, F.col("weight")), names)
