"""What follows extraction of entities and relations from text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.containment import names_within
from memloom.operators.ordering import running
from memloom.session import materialize

# Labels that are no entities.
JUNK_LABELS = (
    "который", "которая", "которое", "которые", "этот", "эта", "это", "эти",
    "также", "где", "что", "как", "или", "для", "при", "все", "весь", "вся", "однако", "кроме", "только", "очень", "когда", "тогда", "такой", "такая",
    "it", "the", "this", "that", "and", "for",
)
# Words in a description and the relation they speak of; the first that occurs counts.
RELATION_WORDS = (
    ("отец", "father_of"), ("мать", "mother_of"), ("сын", "son_of"), ("дочь", "daughter_of"), ("брат", "brother_of"), ("сестра", "sister_of"),
    ("муж", "husband_of"), ("жена", "wife_of"), ("работает в", "works_at"), ("работает на", "works_at"), ("работал в", "worked_at"),
    ("сотрудник", "employee_of"), ("руководит", "manages"), ("директор", "directs"), ("возглавляет", "heads"), ("основал", "founded"),
    ("основала", "founded"), ("основатель", "founded"), ("входит в", "part_of"), ("является частью", "part_of"), ("расположен в", "located_in"),
    ("находится в", "located_in"), ("столица", "capital_of"), ("город", "city_of"), ("создал", "created"), ("разработал", "developed"),
    ("написал", "wrote"), ("использует", "uses"), ("применяет", "uses"), ("партнёр", "partner_of"), ("сотрудничает", "collaborates_with"),
    ("конкурент", "competitor_of"), ("владеет", "owns"), ("произошёл в", "occurred_in"), ("произошла в", "occurred_in"), ("состоялся в", "held_in"),
    ("начался в", "started_in"), ("связан с", "related_to"), ("относится к", "related_to"), ("включает", "includes"), ("содержит", "contains"),
    ("производит", "produces"), ("выпускает", "produces"), ("установлен в", "installed_in"), ("выполняет", "performs"),
)


def without_junk(entities: DataFrame) -> DataFrame:
    """Entities whose label is no stop word and has 3 characters at least."""
    return entities.filter(~F.lower("label").isin(*JUNK_LABELS) & (F.char_length("label") >= 3))


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities (by label) and differ."""
    labels = entities.select("doc", "label").distinct()
    r = relations.filter("source <> target")
    return r.join(labels.withColumnRenamed("label", "source"), ["doc", "source"], "left_semi").join(labels.withColumnRenamed("label", "target"), ["doc", "target"], "left_semi")


def infer_relations(entities: DataFrame) -> DataFrame:
    """(doc, source, target, label, context): from each description the first pattern in it, towards every other entity of the document that it contains.

    A label is contained wherever it stands in the small-lettered description, within
    words too, however long it is.  Descriptions are searched where they lie for the labels of their document
    (see :func:`names_within`); only what was found is shuffled, once a task and
    relation, so a document isn't paired with itself.  Null and empty labels and descriptions give nothing.
    """
    text = F.lower("description")
    relation = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(r)) for w, r in RELATION_WORDS])
    spoken = entities.select("doc", F.col("label").alias("source"), "description", relation.alias("label")).filter("source IS NOT NULL AND label IS NOT NULL")
    others, _ = materialize(entities.filter("label <> ''").select("doc", F.col("label").alias("target"), F.lower("label").alias("name")).distinct(), "labels")
    within = names_within(others, "name", "doc")
    context = F.concat(F.lit("inferred: "), F.substring("description", 1, 200))
    met = spoken.select("doc", "source", "label", context.alias("context"), F.explode(within(text, "doc")).alias("name"))
    # of the descriptions that speak of a relation the smallest text counts
    out = met.groupBy("doc", "source", "label", "name").agg(F.min("context").alias("context")).join(others, ["doc", "name"])
    return out.filter("source <> target").select("doc", "source", "target", "label", "context")


def merged_entities(entities: DataFrame, most: int = 1000) -> DataFrame:
    """One row per (label, type): its different descriptions joined in order, cut at ``most`` characters, and how often it was seen.

    Only descriptions that begin before the cut are gathered, at most half of ``most``; where
    they begin is a running sum over ranges, so a label may have any number of them.
    """
    each = entities.groupBy("label", "type", "description").agg(F.count("*").alias("n"))
    upto = running(each.filter("description <> ''").select("label", "type", "description"), ["label", "type"], [F.asc("description")], totals={"upto": (F.char_length("description") + 1).cast("long")})
    first = upto.filter(F.col("upto") - F.char_length("description") - 1 <= most)
    text = first.groupBy("label", "type").agg(F.substring(F.array_join(F.array_sort(F.collect_list("description")), " "), 1, most).alias("description"))
    seen = each.groupBy("label", "type").agg(F.sum("n").alias("seen"))
    return seen.join(text, ["label", "type"], "left")


def upsert_nodes(existing: DataFrame, incoming: DataFrame, most: int = 2000) -> DataFrame:
    """Nodes (node_id, val, description) after adding incoming ones: val counts up, a description is appended unless contained, cut at ``most``."""
    add = incoming.groupBy("node_id").agg(F.count("*").alias("more"), F.min("description").alias("extra"))
    both = existing.join(add, "node_id", "full")
    text, extra = F.coalesce("description", F.lit("")), F.coalesce("extra", F.lit(""))
    joined = F.when(F.contains(text, extra), text).when(text == "", extra).otherwise(F.concat(text, F.lit(" "), extra))
    return both.select("node_id", (F.coalesce("val", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("val"), F.substring(joined, 1, most).alias("description"))


def upsert_edges(existing: DataFrame, incoming: DataFrame, most: int = 20) -> DataFrame:
    """Edges (src, dst, label, weight, contexts) after adding incoming ones: weight counts up, contexts are united, at most ``most``."""
    from memloom.operators.similarity import nth_of

    keys = ["src", "dst", "label"]
    weight = existing.select(*keys, "weight").unionByName(incoming.select(*keys, F.lit(1.0).alias("weight"))).groupBy(*keys).agg(F.sum("weight").alias("weight"))
    each = existing.select(*keys, F.explode_outer("contexts").alias("c"), F.lit(0).alias("o")).unionByName(incoming.select(*keys, F.explode_outer("contexts").alias("c"), F.lit(1).alias("o")))
    distinct = each.filter("c IS NOT NULL").groupBy(*keys, "c").agg(F.min("o").alias("o"))
    kept = nth_of(distinct, keys, [F.asc("o"), F.asc("c")], most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("contexts"))
    return weight.join(kept, keys, "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def first_json_value(text: Column | str) -> Column:
    """The first balanced JSON object or array in prose, code fences removed; null without one."""
    c = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("string")
    def find(texts):
        return texts.map(lambda t: _first_json(t) if isinstance(t, str) else None)

    return find(c)


_MARKS = re.compile(r"""["{}\[\]]|\\["\\]""")


def _first_json(text: str) -> str | None:
    """In one pass: brackets are matched on a stack; one that doesn't fit makes all open ones fail.

    Of the values that close the one that begins first counts, so one inside of
    brackets that never close is found.  Quotes count within brackets only.
    """
    open_: list[tuple[str, int]] = []
    first: tuple[int, int] | None = None
    quoted = False
    for m in _MARKS.finditer(text):
        ch, i = m[0], m.start()
        if ch == '"':
            quoted = bool(open_) and not quoted
        elif ch in "{[" and not quoted:
            open_.append(("}" if ch == "{" else "]", i))
        elif ch in "}]" and open_ and not quoted:
            closes, start = open_.pop()
            if closes != ch:
                if first:
                    break
                open_.clear()
                continue
            first = min(first or (start, i + 1), (start, i + 1))
            if not open_:
                break
    return text[slice(*first)] if first else None
