"""Readers: texts, source trees, session logs, golden sets, other graphs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.ordering import running
from memloom.session import materialize

LOG_SCHEMA = "timestamp string, user_text string, assistant_text string, meta struct<session_id:string,author:string,source:string>"
HISTORY_SCHEMA = "cursor long, timestamp string, content string"
# Folders of a source tree that hold no sources.
SKIP_FOLDERS = (".git", "target", "node_modules", "dist", "build", "venv", ".venv", "vendor", "data", "logs", "backups", "__pycache__")
_LOG_NAME = r"/(?:day=)?(\d{4}-\d{2}-\d{2})(?:\.jsonl$|(?:\.jsonl)?/[^/]+$)"


def decode_bytes(raw: bytes) -> str:
    """UTF-8, else windows-1251 if every byte has a character there, else UTF-8 with replacement marks."""
    for charset in ("utf-8", "cp1251"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def decoded(content: Column | str) -> Column:
    """Bytes as text, see :func:`decode_bytes`; what is UTF-8 already, most of all, stays in the JVM."""
    c = F.col(content) if isinstance(content, str) else content

    @F.pandas_udf("string")
    def other(raws):
        return raws.map(lambda r: decode_bytes(bytes(r)) if r is not None else None)

    plain = F.is_valid_utf8(c.cast("string"))
    return F.when(plain, c.cast("string")).otherwise(other(F.when(~plain, c)))


def read_texts(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """(path, file_name, format, size_bytes, text) of all files below a folder; formats without a parser are read as text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.col("length").alias("size_bytes"), decoded("content").alias("text"))


def ignore_pattern(line: str, folder: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it ignores) of a line of an ignore file in ``folder``; null for blank lines and comments."""
    rule = line.rstrip("\r\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    ignores, rule = not rule.startswith("!"), rule.lstrip("!")
    inner = rule.rstrip("/")
    anchored, inner = "/" in inner, inner.lstrip("/")
    parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", inner)
    wild = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(wild.get(p) or (p if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts if p)
    base = re.escape(folder + "/") if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/' if rule.endswith('/') else '(?:/|$)'}", ignores


def _ignored(paths: Column, rules: list[tuple[str, bool]]) -> Column:
    """True for paths that the last rule that fits ignores."""

    @F.pandas_udf("boolean")
    def ignored(values):
        compiled = [(re.compile(p), flag) for p, flag in reversed(rules)]
        return values.map(lambda v: next((flag for p, flag in compiled if p.search(v)), False))

    return ignored(paths)


#: Rules of all ignore files of a tree, and files of a tree, at most.
RULES_MOST = 20_000
FILES_MOST = 5_000_000


def _file_system(root: str):
    """(file system, path in it) of a folder; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def _contents(root: str):
    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        files, base = _file_system(root)
        for batch in batches:
            for i, rel in enumerate(batch.column(0).to_pylist()):
                with files.open_input_stream(f"{base}/{rel}") as f:
                    content = f.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=["path", "lang", "size_bytes", "content"])

    return read


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, size_bytes, hash, text) of the files of a source tree that a format of the registry takes, relative to its root.

    Hidden files and folders, folders without sources, what ``.gitignore`` files name, generated protocol modules
    and files above the format's cap are left out before any content is read.  Of the ignore
    rules the last that fits counts, deeper files after higher ones.  The tree is listed here and
    its files are read by the tasks, as Spark's own readers pass over names like ``__init__.py``.
    """
    from pyarrow.fs import FileSelector, FileType

    from memloom.operators.parsers import CAP_BYTES, NOTEBOOK_CAP_BYTES, format_column

    files, base = _file_system(root)
    found = [(x.path[len(base) :].lstrip("/"), x.size) for x in files.get_file_info(FileSelector(base, recursive=True)) if x.type == FileType.File]
    if len(found) > FILES_MOST:
        raise ValueError(f"more than {FILES_MOST} files; read the tree folder by folder")
    left_out = lambda rel: any(p in SKIP_FOLDERS for p in rel.split("/")[:-1])
    rules: list[tuple[str, bool]] = []
    for rel, _ in sorted((x for x in found if x[0].split("/")[-1] == ".gitignore" and not left_out(x[0])), key=lambda x: (x[0].count("/"), x[0])):
        with files.open_input_stream(f"{base}/{rel}") as f:
            rules += [r for line in decode_bytes(f.read()).split("\n") if (r := ignore_pattern(line, rel.rpartition("/")[0]))]
    if len(rules) > RULES_MOST:
        raise ValueError(f"more than {RULES_MOST} ignore rules")
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    sourceless = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_FOLDERS)))
    tree = spark.createDataFrame(found, "path string, size_bytes long").withColumn("lang", format_column("path"))
    cap = F.when(F.col("lang") == "notebook", NOTEBOOK_CAP_BYTES).otherwise(CAP_BYTES)
    kept = tree.filter(F.col("lang").isNotNull() & ~hidden & ~sourceless & ~F.col("path").rlike("_pb2(?:_grpc)?\\.py$") & (F.col("size_bytes") <= cap))
    if rules:
        kept = kept.filter(~_ignored(F.col("path"), rules))
    kept = kept.select("path", "lang", "size_bytes").mapInArrow(_contents(root), "path string, lang string, size_bytes long, content binary")
    return kept.select("path", "lang", "size_bytes", F.sha2("content", 256).alias("hash"), decoded("content").alias("text"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """Log entries from (value, log_file, line_no): lines that aren't JSON objects or have no time are skipped; ``source_ref`` names the line."""
    j = F.from_json("value", LOG_SCHEMA)
    rows = lines.withColumn("j", j).filter(F.col("j.timestamp").isNotNull())
    return rows.select("log_file", "line_no", F.concat("log_file", F.lit("#L"), F.col("line_no").cast("string")).alias("source_ref"), "j.*")


def read_daily_logs(spark: SparkSession, folder: str, *, session: str | None = None, most: int | None = None) -> DataFrame:
    """Entries of all ``YYYY-MM-DD.jsonl`` files of a folder; foreign files and broken lines are skipped.

    A log is one day: a file of that name, or a folder of that name (or ``day=`` and the date) whose files
    follow each other by name.  Lines are numbered within the day, over ranges of them, so
    a day may be of any size.  With ``session`` lines are searched for the id before they are
    parsed; ``most`` caps the rows.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(folder)
    day = F.regexp_extract(F.col("_metadata.file_path"), _LOG_NAME, 1)
    at = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__i": F.monotonically_increasing_id()}
    lines = lines.select("value", F.concat(F.lit("daily/"), day, F.lit(".jsonl")).alias("log_file"), *[c.alias(n) for n, c in at.items()]).filter("log_file <> 'daily/.jsonl'")
    # the numbers of a partition's rows ascend but may change when it is read again, so they are kept
    lines, _ = materialize(lines, "lines")
    lines = running(lines, ["log_file"], [F.asc(n) for n in at], totals={"line_no": F.lit(1).cast("long")}).drop(*at).filter("value <> ''")
    if session is not None:
        lines = lines.filter(F.contains("value", F.lit(session)))
    out = parsed_log(lines)
    if session is not None:
        out = out.filter(F.col("meta.session_id") == session)
    return out.limit(most) if most is not None else out


def read_history(spark: SparkSession, path: str, cursor: int, most: int) -> DataFrame:
    """The next ``most`` history entries after a cursor."""
    return spark.read.schema(HISTORY_SCHEMA).json(path).filter(F.col("cursor") > cursor).orderBy("cursor").limit(most)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases (query, expect_keys, note); raises if there are none or one has no query or no keys."""
    cases = spark.read.schema("query string, expect_keys array<string>, note string").json(path)
    bad = F.col("query").isNull() | (F.trim("query") == "") | (F.size("expect_keys") <= 0)
    counts = cases.agg(F.count("*").alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad")).first()
    if not counts["n"] or counts["bad"]:
        raise ValueError(f"{counts['bad'] or 0} of {counts['n']} golden cases are unusable")
    return cases


def import_graph(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of another graph as those of a project; edges without both ends are left out."""
    n = nodes.withColumns({"project_id": F.lit(project), "provenance": F.coalesce("provenance", F.lit("SYNTAX")) if "provenance" in nodes.columns else F.lit("SYNTAX")})
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e.withColumn("project_id", F.lit(project))

