"""Sizes of texts in tokens of a public tokenizer, counted batch by batch."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file; a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("MEMLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a ``.tiktoken`` rank file, loaded once per process."""
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_token_counts(docs: DataFrame, id_col: str, text_col: str, *, keep: dict | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens, kept columns..): the number of tokens of every text; 0 for null and empty ones.

    ``keep`` gives further columns (name: expression) to hand through.
    """
    keep = keep or {}
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *[c.alias(n) for n, c in keep.items()])
    rest = chosen.drop("text").schema.fields
    schema = "id long, tokens long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest[1:])

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encode = load_tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tokens", *(f.name for f in rest[1:])])

    return chosen.mapInArrow(count, schema)
