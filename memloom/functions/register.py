"""Extension points: expressions as SQL functions, and functions of the user over batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import NO_VALUE_WORDS


def register_functions(spark: SparkSession) -> list[str]:
    """Makes some expressions callable from SQL as functions of the session; returns their names.

    They are SQL functions, inlined by Catalyst, not Python.
    """
    words = ", ".join(f"'{w}'" for w in NO_VALUE_WORDS)
    functions = {
        "memory_key": ("s STRING", "STRING", "concat('m_', substr(sha2(trim(s), 256), 1, 12))"),
        "estimate_tokens": ("s STRING", "BIGINT", "greatest(1, char_length(s) div 3)"),
        "has_value": ("s STRING", "BOOLEAN", f"coalesce(trim(s) <> '' AND lower(trim(s)) NOT IN ({words}), false)"),
        "access_saturation": ("n BIGINT", "DOUBLE", "least(1.0D, log1p(greatest(0, n)) / ln(50))"),
    }
    for name, (arguments, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(functions)


def register_batch_function(spark: SparkSession, name: str, f: Callable[[pd.Series], pd.Series], returns: str) -> None:
    """A function of the user over Arrow batches of one column, callable from SQL: an embedding model, a parser, a classifier."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def extract_chunks(chunks, id_col: str, text_col: str, extract: Callable[[Sequence[str]], Sequence[list[tuple[str, str, str]]]]):
    """(id, label, type, description) from chunks by a pluggable extractor, called once per batch of texts.

    A batch that the extractor fails on is tried text by text; a text that fails
    gives one row of type ``failed``, so failures can be counted.
    """
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            try:
                found = list(extract(texts))
            except Exception:
                found = []
                for t in texts:
                    try:
                        found += list(extract([t]))
                    except Exception as e:
                        found.append([("", "failed", str(e)[:200])])
            rows = [(i, *x) for i, xs in zip(pdf[id_col], found) for x in xs]
            yield pd.DataFrame(rows, columns=["id", "label", "type", "description"])

    return chunks.select(id_col, text_col).mapInPandas(run, f"id {kind}, label string, type string, description string")
