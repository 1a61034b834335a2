"""Text expressions: keys, identifiers, sentences, chunks, masking of secrets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.keys import trimmed

_MARK = "\x01"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def memory_key(content: Column | str) -> Column:
    """``m_`` and 12 hex digits of the trimmed content's SHA-256."""
    return F.concat(F.lit("m_"), F.substring(F.sha2(trimmed(content), 256), 1, 12))


def node_key(label: Column | str, node_type: Column | str) -> Column:
    """24 hex digits of the SHA-256 of label, bar and type."""
    return F.substring(F.sha2(F.concat(_c(label), F.lit("|"), _c(node_type)), 256), 1, 24)


def lesson_fingerprint(content: Column | str) -> Column:
    """``lsn_`` and 16 hex digits of the SHA-256 of the trimmed, lower-cased content."""
    return F.concat(F.lit("lsn_"), F.substring(F.sha2(F.lower(trimmed(content)), 256), 1, 16))


def decompose_identifier(c: Column | str) -> Column:
    """Lower-cased parts of an identifier, split at ``_ - .``, blanks, camel-case borders and after acronyms."""
    parted = F.regexp_replace(F.regexp_replace(_c(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(parted), "[_. -]+", " "))


def normalize_entity(c: Column | str) -> Column:
    """A name for comparison: small letters, no punctuation, no one-letter words, hyphenated words joined."""
    plain = F.regexp_replace(F.translate(F.lower(_c(c)), "ё", "е"), r"[^\p{L}\p{N}_-]+", " ")
    words = F.transform(F.split(F.trim(plain), " +"), lambda t: F.regexp_replace(t, "[_-]", ""))
    return F.array_join(F.filter(words, lambda t: F.char_length(t) > 1), " ")


def split_sentences(c: Column | str) -> Column:
    """Sentences with their end marks: cut after ``. ! ? …`` and white space, and at line breaks."""
    marked = F.regexp_replace(F.regexp_replace(_c(c), r"([.!?…])\s+", "$1" + _MARK), r"\n+", _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), trimmed), lambda s: s != "")


def hard_split(sentences: Column, most: int) -> Column:
    """Sentences with those longer than ``most`` characters cut into parts of that length."""
    parts = F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most))))
    return F.flatten(parts)


def split_into_chunks(c: Column | str, most: int = 3000, overlap: int = 300) -> Column:
    """Sentences packed greedily into chunks of at most ``most`` characters; each next chunk begins with the last ``overlap`` ones.

    Null gives null, a text without sentences an empty array.
    """
    parts = hard_split(split_sentences(c), most)
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        over = (F.char_length(joined) > most) & (acc["cur"] != "")
        tail = F.concat(F.right(acc["cur"], F.lit(overlap)), F.lit(" "), s) if overlap > 0 else s
        return F.struct(
            F.when(over, F.array_append(acc["chunks"], acc["cur"])).otherwise(acc["chunks"]).alias("chunks"),
            F.when(over, tail).otherwise(joined).alias("cur"),
        )

    finish = lambda acc: F.when(trimmed(acc["cur"]) != "", F.array_append(acc["chunks"], acc["cur"])).otherwise(acc["chunks"])
    return F.aggregate(parts, start, step, finish)


def fixed_window_chunks(c: Column | str, window: int = 40, overlap: int = 10) -> Column:
    """Windows of ``window`` lines, each starting max(1, window - overlap) lines after the one before, until the last line is in."""
    lines = F.split(_c(c), "\n")
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(lines) - window) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(lines, i * step + 1, window), "\n"))


def scoped_chunk(path: Column | str, scope: Column | str, body: Column | str, most: int = 1500) -> Column:
    """A header line with file and scope, and as many whole lines of the body as ``most`` characters allow."""
    head = F.concat(F.lit("// "), _c(path), F.when(_c(scope) != "", F.concat(F.lit(" :: "), _c(scope))).otherwise(F.lit("")))
    lines = F.split(_c(body), "\n")
    start = F.struct(head.alias("text"), F.lit(True).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.concat(acc["text"], F.lit("\n"), line)
        ok = acc["open"] & (F.char_length(joined) <= most)
        return F.struct(F.when(ok, joined).otherwise(acc["text"]).alias("text"), ok.alias("open"))

    return F.aggregate(lines, start, step, lambda acc: acc["text"])


def worth_extracting(chunk: Column | str) -> Column:
    """At least 80 characters, and a sentence mark or 300 characters."""
    t = trimmed(chunk)
    return (F.char_length(t) >= 80) & (t.rlike("[.!?…]") | (F.char_length(t) >= 300))


def estimate_tokens(c: Column | str) -> Column:
    """A third of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(_c(c)) / 3)).cast("long")


def trim_chars(c: Column | str, most: int) -> Column:
    """The first ``most`` characters, with an ellipsis if there were more."""
    return F.when(F.char_length(_c(c)) > most, F.concat(F.substring(_c(c), 1, most), F.lit("…"))).otherwise(_c(c))


def normalize_spaces(c: Column | str) -> Column:
    """Small letters, white space collapsed to single blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"\s+", " "))


def normalize_api_path(c: Column | str) -> Column:
    """An API path with its parameters as ``:param``, without slashes at the end, in small letters."""
    return F.lower(F.rtrim(F.regexp_replace(_c(c), "[{<][^}>]*[}>]?|(?<![/:]):[^/]*", ":param"), F.lit("/")))


def mentioned_environments(c: Column | str) -> Column:
    """Environment tags named as whole words: prod, dev, staging, local, vps, windows, linux, macos."""
    words = F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+")
    # Words and their tags.
    tags = {"prod": "prod", "production": "prod", "dev": "dev", "development": "dev", "staging": "staging", "local": "local", "vps": "vps", "windows": "windows", "linux": "linux", "macos": "macos"}
    found = [F.when(F.array_contains(words, w), F.lit(t)) for w, t in tags.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def numbers_in(c: Column | str) -> Column:
    """Runs of ASCII digits, in order."""
    return F.regexp_extract_all(_c(c), F.lit("([0-9]+)"), 1)


def named_entities(content: Column | str, meta: Column | str | None = None) -> Column:
    """Words with a capital letter or one of ``/ _ .``, lower-cased, with subject fields of the JSON meta."""
    words = F.filter(F.split(_c(content), r"[\s,;:()\"']+"), lambda t: (F.octet_length(t) >= 2) & (t.rlike(r"\p{Lu}") | t.rlike("[/_.]")))
    words = F.transform(words, F.lower)
    if meta is not None:
        v = F.try_parse_json(_c(meta))
        fields = F.array(*[F.lower(trimmed(F.try_variant_get(v, f"$.{f}", "string"))) for f in ("file_path", "subject", "entity")])
        many = F.transform(F.coalesce(F.try_variant_get(v, "$.entities", "array<string>"), F.array().cast("array<string>")), lambda x: F.lower(trimmed(x)))
        words = F.concat(words, F.filter(F.array_compact(F.concat(fields, many)), lambda x: x != ""))
    return F.array_sort(F.array_distinct(words))


def mask_secrets(c: Column | str, vault_names: Sequence[str] = ()) -> Column:
    """Secrets masked token by token, white space untouched.

    ``sk-`` keys, GitHub tokens, ``user:password@`` in URLs, vault names with a
    value, assignments to names ending in KEY, TOKEN, SECRET or PASSWORD, and
    what follows ``Bearer``.
    """
    out = _c(c)
    rules = [
        (r"(?i)(?<!\S)(bearer\s+)\S+", "$1[REDACTED:bearer]"),
        (r"(?<!\S)sk-(?=(?:\S*?[\p{L}\p{N}_-]){16})\S+", "[REDACTED:sk-key]"),
        (r"(?<!\S)gh[posu]_(?=(?:\S*?[\p{L}\p{N}]){20})\S+", "[REDACTED:gh-token]"),
        (r"(?<!\S)(\S*?://)(?=[^\s/@]*:)[^\s/@]*(@\S*)", "$1[REDACTED]$2"),
    ]
    quoted = "|".join(_quote(n) for n in vault_names if n)
    if quoted:
        rules.append((rf"(?<!\S)({quoted})([=:])(?!\[REDACTED)\S*", "$1$2[REDACTED:vault]"))
    rules.append((r"(?i)(?<!\S)(?!\S*://)((?:[^\s=]*_)?(?:key|token|secret|password|passwd))=(?!\[REDACTED)\S*", "$1=[REDACTED]"))
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return out


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
