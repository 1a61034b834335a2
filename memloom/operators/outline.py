"""Blocks and edges of source texts: where symbols end, whom they belong to, what they call, extend, serve and ask for.

A line scanner per family of languages: Python's blocks end by indent, those of
the others by braces.  Strings and comments are blanked first, so that brackets
and names in them don't count.  What a name means is left to the resolution of
calls and imports, which sees all files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.ordering import spread_out
from memloom.operators.parsers import CAP_BYTES, NOTEBOOK_CAP_BYTES, format_column, line_patterns

INDENTED = frozenset({"python"})
BRACED = frozenset({"rust", "ts-js", "go", "java", "csharp", "c-cpp", "kotlin", "swift", "php", "dart", "scala", "solidity", "zig", "sfc"})
_TYPES = frozenset({"Class", "Struct", "Interface", "Trait", "Contract", "Impl"})
_CODE = frozenset({"Function", "Method"})
# Words before a bracket that call nothing.
_NO_CALLS = frozenset(
    "if for while switch match return catch fn func function def class struct enum trait impl interface sizeof typeof new await yield in not and or when with else elif assert raise throw throws "
    "super lambda print_r isset empty array list unset use import from as except case do loop where let var const static public private protected go defer select chan map range".split()
)
_NO_DEFS = frozenset("if for while switch match return catch else elif do throw await".split())
_STRING = {True: re.compile(r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'"""), False: re.compile(r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""")}
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::|->|\?\.)\s*)?([A-Za-z_$][\w$]*)!?\s*(?:::<[^<>]*>\s*)?\(")
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)")
_GO_OWNER = re.compile(r"^func\s+\(\s*\w*\s*\*?\s*(\w+)")
_BASES = (
    (frozenset({"python"}), re.compile(r"^\s*class\s+(\w+)\s*\(([^)]*)\)")),
    (frozenset({"ts-js", "java", "php", "dart", "sfc"}), re.compile(r"\b(?:class|interface)\s+(\w+)(?:<[^{]*?>)?((?:\s+(?:extends|implements|with)\s+[\w\s,.<>\\]+)+)")),
    (frozenset({"scala"}), re.compile(r"\b(?:class|object|trait)\s+(\w+)[^{]*?((?:\s+(?:extends|with)\s+[\w.]+)+)")),
    (frozenset({"csharp", "kotlin", "swift", "c-cpp"}), re.compile(r"\b(?:class|struct|interface|object|record)\s+(\w+)(?:\([^)]*\))?\s*:\s*([\w\s,.<>():]+)")),
    (frozenset({"solidity"}), re.compile(r"\b(?:contract|interface)\s+(\w+)\s+is\s+([\w\s,.]+)")),
)
_VERB = r"(get|post|put|patch|delete)"
_ROUTES = (
    re.compile(rf"""(?i)(?:@?\b(?:app|router|api|server|bp|blueprint|mux|engine)\.|\bRoute::){_VERB}\(\s*["'`](?P<path>/[^"'`]*)"""),
    re.compile(rf"""(?i)@{_VERB}Mapping\(\s*(?:(?:value|path)\s*=\s*)?"(?P<path>/[^"]*)"""),
    re.compile(rf"""(?i)\.route\(\s*"(?P<path>/[^"]*)"\s*,\s*(?:\w+::)?{_VERB}\("""),
    re.compile(r"""(?i)\bHandle(?:Func)?\(\s*"(?:(GET|POST|PUT|PATCH|DELETE) )?(?P<path>/[^"]*)"""),
)
_CLIENTS = (
    re.compile(rf"""(?i)\b(?:axios|requests|httpx|client|session|http)\.{_VERB}\(\s*f?["'`](?P<path>/(?!/)[^"'`]*)"""),
    re.compile(r"""\bfetch\(\s*["'`](?P<path>/(?!/)[^"'`]*)["'`](?:[^)]*?method:\s*["'](\w+))?"""),
)
_STATEMENT = re.compile(r"(?i)\b(?:select\b.*?\bfrom|insert\s+into|update|delete\s+from|join)\s+[\"`\[]?([A-Za-z_][\w.]*)")
_SQL_START = re.compile(r"(?i)^\s*(?:select|insert|update|delete|with)\b")


class Symbol(NamedTuple):
    kind: str
    name: str
    line: int
    end: int
    owner: str | None


class Edge(NamedTuple):
    label: str
    src: str | None
    dst: str
    owner: str | None
    method: str | None
    line: int


def _blanked(lines: list[str], lang: str) -> list[str]:
    """The lines without strings and comments, as long as they were."""
    comment = re.compile(r"#.*") if lang in INDENTED else re.compile(r"//.*|(?<!\S)#(?!\[).*" if lang == "php" else r"//.*")
    string, closes, out = _STRING[lang == "rust"], None, []
    opens = re.compile('"""|' + "'''") if lang in INDENTED else re.compile(r"/\*")
    hide = lambda m: '"' + " " * (len(m[0]) - 2) + '"' if len(m[0]) > 1 else " "
    for line in lines:
        kept, at = "", 0
        while True:
            if closes:
                end = line.find(closes, at)
                if end < 0:
                    kept += " " * (len(line) - at)
                    break
                kept += " " * (end + len(closes) - at)
                at, closes = end + len(closes), None
            rest = line[at:]
            if lang not in INDENTED:
                rest = string.sub(hide, rest)
            start = opens.search(rest)
            quick = comment.search(rest)
            if start and not (quick and quick.start() < start.start()):
                kept += rest[: start.start()] + " " * len(start[0])
                at += start.end()
                closes = "*/" if start[0] == "/*" else start[0]
                continue
            if lang in INDENTED:
                rest = string.sub(hide, rest)
            kept += comment.sub(lambda m: " " * len(m[0]), rest)
            break
        out.append(kept)
    return out


def outline(text: str, lang: str) -> tuple[list[Symbol], list[Edge]]:
    """Symbols with their last line and owner, and edges; of languages without a scanner, symbols of one line and imports.

    Owners are the innermost type around a symbol (the receiver's type in Go, the type of an ``impl`` block in
    Rust).  The owner of a call is the type it is called on, where the text tells.
    """
    lines = text.split("\n")
    patterns = line_patterns(lang)
    scanned = lang in INDENTED or lang in BRACED
    code = _blanked(lines, lang) if scanned else lines
    found: list[list] = []  # kind, name, line, end, owner
    edges: list[Edge] = []
    open_: list[tuple[int, int, bool]] = []  # index into found, depth or indent, entered
    depth, last = 0, 0
    for n, (raw, line) in enumerate(zip(lines, code), 1):
        if not line.strip():
            if raw.strip() and scanned:
                _strings_of(raw, n, _around(found, open_, _CODE), edges)
            continue
        indent = len(line) - len(line.lstrip())
        if lang in INDENTED:
            while open_ and indent <= open_[-1][1]:
                found[open_.pop()[0]][3] = last
        begun = []
        for kind, pattern in patterns:
            for m in pattern.finditer(line if scanned and kind != "Import" else raw):
                if not m[1] or (scanned and kind in _CODE and m[1] in _NO_DEFS):
                    continue
                if kind == "Import":
                    edges.append(Edge("IMPORTS", None, m[1], None, None, n))
                    continue
                if any(found[i][1] == m[1] for i in begun):
                    continue  # a line that two patterns fit
                owner = _around(found, open_, _TYPES)
                if lang == "go" and kind == "Function" and (receiver := _GO_OWNER.match(line)):
                    owner = receiver[1]
                begun.append(len(found))
                found.append([kind, m[1], n, n, owner])
                edges.append(Edge("DEFINES", owner, m[1], owner, None, n))
        if lang == "rust" and (m := _IMPL.match(line)):
            kept = m[2].rsplit("::", 1)[-1]
            begun.append(len(found))
            found.append(["Impl", kept, n, n, None])
            if m[1]:
                edges.append(Edge("INHERITS", kept, m[1].rsplit("::", 1)[-1], None, None, n))
        for langs, pattern in _BASES:
            if lang in langs and (m := pattern.search(line)):
                for base in re.split(r"[\s,]+", re.sub(r"\b(?:extends|implements|with|public|private|protected|virtual)\b|<[^<>]*>|\([^)]*\)|\w+\s*=\s*\w+", " ", m[2])):
                    if re.fullmatch(r"[A-Za-z_][\w.:\\]*", base):
                        edges.append(Edge("INHERITS", m[1], re.split(r"[.:\\]", base)[-1], None, None, n))
        if scanned:
            before = depth
            if lang in BRACED:
                depth += line.count("{") - line.count("}")
            open_ += [(i, indent if lang in INDENTED else before, False) for i in begun]
            caller = _around(found, open_, _CODE)
            names = {found[i][1] for i in begun}
            own = _around(found, open_, _TYPES)
            if lang == "go" and (inner := [i for i, *_ in open_ if found[i][0] in _CODE]):
                own = found[inner[-1]][4]
            if caller is not None:
                for m in _CALL.finditer(line):
                    on, name = m[1], m[2]
                    if (name in _NO_CALLS and on is None) or (name in names and on is None) or re.search(r"\b(?:fn|def|func|function|class|new)\s+$", line[: m.start()]) and name in names:
                        continue
                    owner = own if on in ("self", "this", "Self", "cls") else on if on and on[:1].isupper() else None
                    edges.append(Edge("CALLS", caller, name, owner, None if on is None else on, n))
            _strings_of(raw, n, caller, edges)
            if lang in BRACED:
                still = []
                for i, level, entered in open_:
                    entered = entered or depth > level or "{" in line and i in begun
                    if (entered and depth <= level) or (not entered and line.rstrip().endswith(";")):
                        found[i][3] = n
                    else:
                        still.append((i, level, entered))
                open_ = still
        last = n
    for i, *_ in open_:
        found[i][3] = last
    return [Symbol(*x) for x in found if x[0] != "Impl"], edges


def _around(found: list[list], open_: list[tuple[int, int, bool]], kinds: frozenset) -> str | None:
    """The name of the innermost open symbol of these kinds."""
    return next((found[i][1] for i, *_ in reversed(open_) if found[i][0] in kinds), None)


def _strings_of(raw: str, n: int, caller: str | None, edges: list[Edge]) -> None:
    """Edges that a line's strings tell: routes, client calls, tables of statements."""
    if '"' not in raw and "'" not in raw and "`" not in raw:
        return
    verbs = lambda m: next((g for g in m.groups() if g and g[0] != "/"), "get").upper()
    for label, patterns in (("ROUTE", _ROUTES), ("HTTP_CALL", _CLIENTS)):
        for pattern in patterns:
            edges += [Edge(label, caller, m["path"], None, verbs(m), n) for m in pattern.finditer(raw)]
    for m in _STRING[False].finditer(raw):
        if _SQL_START.match(m[0][1:-1]):
            edges += [Edge("QUERIES_TABLE", caller, t[1], None, None, n) for t in _STATEMENT.finditer(m[0][1:-1])]


def _each(files: DataFrame, id_col: str, path_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    chosen = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), format_column(path_col).alias("lang"), F.col(text_col).alias("text"))
    cap = F.when(F.col("lang") == "notebook", NOTEBOOK_CAP_BYTES).otherwise(CAP_BYTES)
    chosen = chosen.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= cap))
    kind = chosen.schema["id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(i, path, lang, *x) for i, path, lang, text in zip(*(c.to_pylist() for c in batch.columns)) for x in rows_of(text, lang)]
            if rows:
                c = list(zip(*rows))
                types = [batch.schema.field(0).type, *(pa.int64() if t.endswith(" long") else pa.string() for t in ("path string, lang string, " + schema).split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["file_id", "path", "lang", *names])

    return spread_out(chosen).mapInArrow(parse, f"file_id {kind}, path string, lang string, {schema}")


def parse_sources(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """(file_id, path, lang, kind, name, line, line_end, owner): what the files define and import, see :func:`outline`.

    Files of no known format, without text or larger than the format's cap have no rows.
    """

    def rows(text: str, lang: str) -> list[tuple]:
        symbols, edges = outline(text, lang)
        return [*symbols, *(("Import", e.dst, e.line, e.line, None) for e in edges if e.label == "IMPORTS")]

    return _each(files, id_col, path_col, text_col, "kind string, name string, line long, line_end long, owner string", rows)


def parse_edges(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """(file_id, path, lang, label, src, dst, owner, method, line): DEFINES, IMPORTS, INHERITS, CALLS, ROUTE, HTTP_CALL and QUERIES_TABLE edges.

    ``src`` is the symbol an edge leaves, null for the file; ``method`` is the HTTP verb, or of a call what it is called on.
    """
    return _each(files, id_col, path_col, text_col, "label string, src string, dst string, owner string, method string, line long", lambda t, lang: outline(t, lang)[1])
