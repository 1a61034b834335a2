"""Session logs: pairs, timelines, batches, verdicts, patterns of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import estimate_tokens, mask_secrets
from memloom.functions.keys import trimmed
from memloom.operators.ordering import global_rank, running


def parsed_time(c: Column | str) -> Column:
    """An RFC 3339 time, or null for what is none."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def timeline(entries: DataFrame, time: Column, tie: list[str]) -> DataFrame:
    """The entries with their 1-based position ``pos`` by time (undated first), then the ``tie`` columns.

    Positions are formed over ranges of the order, so a day with very many entries,
    and the undated ones, lie in many tasks.
    """
    return global_rank(entries.withColumn("__t", time), [F.asc_nulls_first("__t"), *map(F.col, tie)], "pos").drop("__t")


def resolve_anchor(placed: DataFrame, anchor: str, texts: list[str], time: Column) -> DataFrame:
    """One row ``anchor``: position of the first entry of a day (ISO date), or of the first that contains the text; null without one."""
    import re

    a = anchor.strip()
    if re.match(r"\d{4}-\d{2}-\d{2}", a):
        hit = F.to_date(time) == F.lit(a[:10]).cast("date")
    else:
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.coalesce(F.contains(F.lower(t), F.lit(a.lower())), F.lit(False))
    return placed.agg(F.min(F.when(hit, F.col("pos"))).alias("anchor"))


def window_around(placed: DataFrame, anchor: DataFrame, before: int, after: int) -> DataFrame:
    """Entries from ``before`` ahead of the anchor to ``after`` behind it; without an anchor the last ``before`` entries."""
    last = placed.agg(F.max("pos").alias("last"))
    one = F.broadcast(anchor.join(last))  # one row
    low = F.when(F.col("anchor").isNull(), F.col("last") - before + 1).otherwise(F.col("anchor") - before)
    high = F.when(F.col("anchor").isNull(), F.col("last")).otherwise(F.col("anchor") + after)
    return placed.join(one).filter((F.col("pos") >= low) & (F.col("pos") <= high)).drop("anchor", "last")


def beyond_prefix(placed: DataFrame, done: int, most: int = 40) -> DataFrame:
    """The next ``most`` entries after those already summarised."""
    return placed.filter(F.col("pos") > done).orderBy("pos").limit(most)


def log_messages(entries: DataFrame) -> DataFrame:
    """Log entries as chat messages (session, turn, role, content): the user's, then the assistant's; null and empty texts are none."""
    each = F.array(F.struct(F.lit(0).alias("o"), F.lit("user").alias("role"), F.col("user_text").alias("content")), F.struct(F.lit(1).alias("o"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("content")))
    m = entries.select(F.coalesce(F.col("meta.session_id"), F.lit("")).alias("session"), "entry_id", F.explode(each).alias("m"))
    return m.filter("m.content <> ''").select("session", (F.col("entry_id") * 2 + F.col("m.o")).alias("turn"), "m.role", "m.content")


def conversation_pairs(messages: DataFrame, *, already: DataFrame | None = None) -> DataFrame:
    """(session, turn, user_text, assistant_text): each answer with what was asked before it.

    messages: session, turn, role, content.  Other roles are ignored; several user
    turns in a row are joined by line breaks, all of them; a
    question without an answer waits.  ``already`` (session, turn) names the last turn that was
    taken in before; only later ones count.  Secrets are masked.
    """
    m = messages.filter(F.col("role").isin("user", "assistant"))
    if already is not None:
        m = m.join(already.select("session", F.col("turn").alias("__done")), "session", "left").filter(F.col("__done").isNull() | (F.col("turn") > F.col("__done"))).drop("__done")
    said = (F.col("role") == "assistant").cast("long")
    m = running(m.select("session", "turn", "role", "content"), ["session"], [F.asc("turn")], totals={"pair": said})
    m = m.withColumn("pair", F.col("pair") - said).withColumn("content", mask_secrets("content"))
    pair = m.groupBy("session", "pair").agg(
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turn"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "content")))), lambda x: x["content"]), "\n").alias("user_text"),
        F.max(F.when(F.col("role") == "assistant", F.col("content"))).alias("assistant_text"),
    )
    return pair.filter("turn IS NOT NULL").select("session", "turn", "user_text", "assistant_text")


def pair_batches(messages: DataFrame, most: int = 60) -> DataFrame:
    """Messages (session, turn, role, ..) with their ``batch``: about ``most`` messages each, never ending on a question that has an answer.

    A message that follows a question stays in the question's batch.
    """
    m = running(messages, ["session"], [F.asc("turn")], totals={"__n": F.lit(1).cast("long")}, before={"__role": F.col("role")})
    keeps = (F.col("__role") == "user") & (F.col("__n") % most == 1)
    return m.withColumn("batch", F.floor((F.col("__n") - 1 - F.when(keeps, 1).otherwise(0)) / most).cast("long")).drop("__n", "__role")


def consolidation_rounds(messages: DataFrame, budget: int, *, rounds: int = 5, most: int = 60) -> DataFrame:
    """Messages with ``batch`` and whether it is summarised: the first batches, up to ``rounds``, while the tokens left exceed the budget."""
    batched = pair_batches(messages.withColumn("tokens", estimate_tokens("content")), most)
    sizes = batched.groupBy("session", "batch").agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy("session").orderBy("batch")
    left = F.sum("tokens").over(w.rowsBetween(0, Window.unboundedFollowing))
    return sizes.select("session", "batch", "tokens", ((left > budget) & (F.col("batch") < rounds)).alias("summarised"))


def auto_verdict(summary: Column | str) -> Column:
    """failed if any test failed, verified if any passed, else unconfirmed (also for what isn't JSON)."""
    v = F.try_parse_json(F.col(summary) if isinstance(summary, str) else summary)
    n = lambda f: F.coalesce(F.try_variant_get(v, f"$.{f}", "long"), F.lit(0))
    return F.when(n("failed") > 0, "failed").when(n("passed") > 0, "verified").otherwise("unconfirmed")


def repeat_failures(iterations: DataFrame, by: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """One row (pairs, repeats, rate): consecutive iterations of a task and how many of them failed alike."""
    rows = iterations.select(*by, *order, F.col(fingerprint).alias("f"))
    m = running(rows, by, [F.asc(o) for o in order], totals={"n": F.lit(1).cast("long")}, before={"b": F.col("f")})
    m = m.select(F.when(F.col("n") > 1, (F.col("b") == F.col("f")).cast("int")).alias("same"), (F.col("n") > 1).cast("int").alias("pair"))
    sums = m.agg(F.sum("pair").alias("pairs"), F.sum(F.coalesce("same", F.lit(0))).alias("repeats"))
    return sums.withColumn("rate", F.when(F.col("pairs") > 0, F.round(F.col("repeats") / F.col("pairs"), 6)).otherwise(0.0))


def day_patterns(entries: DataFrame, day: Column, texts: list[str]) -> DataFrame:
    """(day, entries, todo_lines, error_lines): per day its entries, different TODO lines (200 characters) and lines that speak of errors."""
    each = entries.select(day.alias("day"), F.explode(F.array(*[F.coalesce(t, F.lit("")) for t in texts])).alias("t")).select("day", F.explode(F.split("t", "\n")).alias("line"))
    low = F.lower("line")
    counts = each.groupBy("day").agg(
        F.count_distinct(F.when(F.contains(low, F.lit("todo")), F.substring(trimmed("line"), 1, 200))).alias("todo_lines"),
        F.sum((F.contains(low, F.lit("error")) | F.contains(low, F.lit("ошибка"))).cast("int")).alias("error_lines"),
    )
    return entries.groupBy(day.alias("day")).agg(F.count("*").alias("entries")).join(counts, "day", "left").select("day", "entries", F.coalesce("todo_lines", F.lit(0)).alias("todo_lines"), F.coalesce("error_lines", F.lit(0)).alias("error_lines"))


def cited_sources(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, source_ref, found): the log lines a record cites (``daily/F#L<n>``), and whether they exist."""
    refs = records.select("id", F.explode(F.array_distinct("source_refs")).alias("source_ref"))
    known = entries.select(F.concat("log_file", F.lit("#L"), F.col("line_no").cast("string")).alias("source_ref")).distinct().withColumn("found", F.lit(True))
    return refs.join(known, "source_ref", "left").select("id", "source_ref", F.coalesce("found", F.lit(False)).alias("found"))


def trigger_policy(entries: DataFrame, came: Column, last: str, now: str, *, least_hours: float = 24.0, least_new: int = 10) -> DataFrame:
    """One row (hours, fresh, run, reason): whether consolidation should run ``now``.

    It should if ``least_hours`` have gone by since it ran ``last`` and ``least_new`` entries came
    since; entries without a time don't count.  The reason names the first condition that fails.
    """
    since = F.lit(last).cast("timestamp")
    hours = F.round((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(since)) / 3600.0, 3)
    row = entries.agg(F.coalesce(F.sum((came > since).cast("long")), F.lit(0)).alias("fresh")).withColumn("hours", hours)
    reason = F.when(F.col("hours") < least_hours, "too soon").when(F.col("fresh") < least_new, "too few entries").otherwise("due")
    return row.select("hours", "fresh", (reason == "due").alias("run"), reason.alias("reason"))


def fresh_values(writes: DataFrame, key: str, time: str, as_of: str, *, ttl_minutes: int = 30) -> DataFrame:
    """The last write of each key, where it is no older than ``ttl_minutes`` at ``as_of``; later writes and those without a time don't count.

    Writes of equal times are told apart by their other columns, so that the result is defined.
    """
    at = F.lit(as_of).cast("timestamp")
    known = writes.filter(F.col(key).isNotNull() & (F.col(time) <= at))
    rest = [c for c in writes.columns if c != key]
    last = known.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("__w")).select(key, "__w.*")
    return last.filter(F.col(time) >= at - F.expr(f"INTERVAL {ttl_minutes} MINUTES"))
