"""Symbols and imports of source texts, by line patterns per language.

A registry maps file names to formats; every format has patterns for
definitions and imports.  What goes beyond a line is in :mod:`memloom.operators.outline`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAP_BYTES, NOTEBOOK_CAP_BYTES = 2 * 1024 * 1024, 5 * 1024 * 1024
_ID = r"[A-Za-z_$][\w$]*"
_C_FUN = r"^\s*(?:[A-Za-z_][\w:<>,*&\s]*[\s*&])?([A-Za-z_~]\w*)\s*\([^;{}]*\)\s*(?:const)?\s*\{"
_JVM_TYPE = r"(?:public|private|protected|internal|abstract|final|sealed|static|data|open|partial|\s)*\b(?:class|record|object|enum(?:\s+class)?)\s+(\w+)"
_JVM_FUN = r"(?:public|private|protected|internal|static|final|override|async|virtual|abstract|\s)+[\w<>\[\],.?\s]+\s+(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{?$"

# Formats with file names, and for each the patterns of what a line defines or imports.
FORMATS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "rust": (r"\.rs$", (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("Struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(\w+)"), ("Trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("Import", r"^\s*(?:pub\s+)?use\s+([\w:]+)"))),
    "python": (r"\.pyi?$", (("Function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("Class", r"^\s*class\s+(\w+)"), ("Import", r"^\s*from\s+([\w.]+)\s+import\b"), ("Import", r"^\s*import\s+([\w.]+)"))),
    "ts-js": (r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", (("Function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("Function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*=>"), ("Method", rf"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*#?(?!(?:if|for|while|switch|catch|return|function|await|constructor)\b)({_ID})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^={{]+)?\{{\s*$"), ("Class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"), ("Interface", rf"^\s*(?:export\s+)?(?:interface|type)\s+({_ID})"), ("Import", r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]"""), ("Import", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""))),
    "go": (r"\.go$", (("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("Struct", r"^type\s+(\w+)\s+struct\b"), ("Interface", r"^type\s+(\w+)\s+interface\b"), ("Import", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'))),
    "sql": (r"\.sql$", (("Table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)"), ("Function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)"), ("Table", r"(?i)^\s*with\s+(?:recursive\s+)?(\w+)\s+as\b"))),
    "php": (r"\.php$", (("Function", r"^\s*(?:public|private|protected|static|abstract|final|\s)*function\s+&?(\w+)"), ("Class", r"^\s*(?:abstract\s+|final\s+)*(?:class|trait|enum)\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Import", r"^\s*use\s+([\w\\]+)"))),
    "dart": (r"\.dart$", (("Class", r"^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(\w+)"), ("Function", r"^\s*(?:[\w<>?,\s]+\s)?(\w+)\([^;]*\)\s*(?:async\*?\s*)?(?:\{|=>)"), ("Import", r"""^\s*import\s+['"]([^'"]+)['"]"""))),
    "java": (r"\.java$", (("Class", rf"^\s*{_JVM_TYPE}"), ("Interface", r"^\s*(?:public\s+)?(?:sealed\s+)?@?interface\s+(\w+)"), ("Method", rf"^\s*{_JVM_FUN}"), ("Import", r"^\s*import\s+(?:static\s+)?([\w.]+)"))),
    "csharp": (r"\.cs$", (("Class", rf"^\s*{_JVM_TYPE}"), ("Struct", r"^\s*(?:public|internal|readonly|\s)*struct\s+(\w+)"), ("Interface", r"^\s*(?:public|internal|\s)*interface\s+(\w+)"), ("Method", rf"^\s*{_JVM_FUN}"), ("Import", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"))),
    "c-cpp": (r"\.(?:c|h|cc|cpp|cxx|hpp|hh)$", (("Struct", r"^\s*(?:typedef\s+)?(?:struct|union|enum(?:\s+class)?)\s+(\w+)"), ("Class", r"^\s*class\s+(\w+)"), ("Function", _C_FUN), ("Import", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'))),
    "kotlin": (r"\.kts?$", (("Function", r"^\s*(?:[\w@]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(\w+)"), ("Class", rf"^\s*{_JVM_TYPE}"), ("Interface", r"^\s*(?:sealed\s+|fun\s+)?interface\s+(\w+)"), ("Import", r"^\s*import\s+([\w.]+)"))),
    "swift": (r"\.swift$", (("Function", r"^\s*(?:[\w@]+\s+)*func\s+(\w+)"), ("Class", r"^\s*(?:[\w@]+\s+)*(?:class|actor)\s+(\w+)"), ("Struct", r"^\s*(?:[\w@]+\s+)*(?:struct|enum)\s+(\w+)"), ("Interface", r"^\s*(?:\w+\s+)*protocol\s+(\w+)"), ("Import", r"^\s*import\s+(\w+)"))),
    "ruby": (r"\.rb$", (("Method", r"^\s*def\s+(?:self\.)?([\w?!]+)"), ("Class", r"^\s*(?:class|module)\s+([\w:]+)"), ("Import", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""))),
    "sfc": (r"\.(?:vue|svelte)$", (("Function", rf"^\s*(?:async\s+)?function\s+({_ID})"), ("Function", rf"^\s*const\s+({_ID})\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"), ("Import", r"""^\s*import\b[^'"]*['"]([^'"]+)['"]"""))),
    "html": (r"\.html?$", (("Element", r"""<[a-zA-Z][\w-]*[^>]*\sid=["']([\w-]+)["']"""), ("Import", r"""<(?:script|img|iframe)[^>]*\ssrc=["']([^"']+)["']"""), ("Import", r"""<(?:link|a)[^>]*\shref=["']([^"'#]+)["']"""))),
    "css": (r"\.(?:css|scss|sass|less)$", (("CssClass", r"\.([A-Za-z_][\w-]*)[^;{}]*\{"), ("CssId", r"#([A-Za-z_][\w-]*)[^;{}]*\{"), ("CssVar", r"(--[\w-]+)\s*:"), ("Import", r"""@import\s+(?:url\()?['"]([^'"]+)['"]"""))),
    "notebook": (r"\.ipynb$", (("Function", r'"\s*(?:async\s+)?def\s+(\w+)'), ("Class", r'"\s*class\s+(\w+)'), ("Import", r'"\s*(?:from|import)\s+([\w.]+)'))),
    "solidity": (r"\.sol$", (("Contract", r"^\s*(?:abstract\s+)?(?:contract|library)\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Function", r"^\s*(?:function|modifier|event)\s+(\w+)"), ("Struct", r"^\s*(?:struct|enum)\s+(\w+)"), ("Import", r"""^\s*import\b[^'"]*['"]([^'"]+)['"]"""))),
    "zig": (r"\.zig$", (("Function", r"^\s*(?:pub\s+|export\s+|inline\s+)*fn\s+(\w+)"), ("Struct", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"), ("Import", r'@import\("([^"]+)"\)'))),
    "asm": (r"\.(?:asm|s|S|nasm)$", (("Function", r"^([A-Za-z_.$][\w.$]*):"), ("Macro", r"^\s*(?:%macro|\.macro)\s+(\w+)"), ("Import", r'^\s*(?:%include|\.include|include)\s+"?([^"\s]+)"?'))),
    "proto": (r"\.proto$", (("Service", r"^\s*service\s+(\w+)"), ("Endpoint", r"^\s*rpc\s+(\w+)"), ("Schema", r"^\s*(?:message|enum)\s+(\w+)"), ("Import", r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"'))),
    "graphql": (r"\.(?:graphql|gql)$", (("Schema", r"^\s*(?:extend\s+)?(?:type|input|enum|union|scalar)\s+(\w+)"), ("Interface", r"^\s*interface\s+(\w+)"), ("Function", r"^\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+"))),
    "openapi": (r"(?:openapi|swagger)[\w.-]*\.(?:ya?ml|json)$", (("Endpoint", r"""^\s*["']?(/[\w{}/.-]*)["']?\s*:"""), ("Schema", r"""["']?\$ref["']?\s*:\s*["']#/(?:components/schemas|definitions)/(\w+)"""))),
    "terraform": (r"\.tf$", (("Resource", r'^\s*(?:resource|data)\s+"[\w-]+"\s+"([\w-]+)"'), ("Resource", r'^\s*(?:module|variable|output|provider)\s+"([\w-]+)"'), ("Import", r'^\s*source\s*=\s*"([^"]+)"'))),
    "dockerfile": (r"(?:^|/)(?:Dockerfile[\w.-]*|[\w.-]+\.dockerfile)$", (("BaseImage", r"(?i)^\s*FROM\s+(?:--platform=\S+\s+)?(\S+)"), ("Service", r"(?i)^\s*FROM\s+\S+\s+AS\s+(\S+)"))),
    "compose": (r"(?:docker-)?compose[\w.-]*\.ya?ml$", (("Service", r"^  ([A-Za-z][\w.-]*):\s*$"), ("BaseImage", r"^\s*image:\s*[\"']?([^\s\"']+)"))),
    "k8s": (r"(?:^|/)(?:k8s|kubernetes|manifests|deploy)/.*\.ya?ml$", (("K8sResource", r"^\s*kind:\s*(\w+)"), ("K8sResource", r"^\s{0,2}name:\s*([\w.-]+)"), ("BaseImage", r"^\s*-?\s*image:\s*[\"']?([^\s\"']+)"))),
    "cargo": (r"(?:^|/)Cargo\.toml$", (("ExternalPackage", r"^([\w-]+)\s*=\s*(?:\"[\d^~=*]|\{)"),)),
    "npm": (r"(?:^|/)package\.json$", (("ExternalPackage", r'^\s*"(@?[\w./-]+)"\s*:\s*"[\^~]?\d'),)),
    "pyproject": (r"(?:^|/)pyproject\.toml$", (("ExternalPackage", r"^\s*\"([A-Za-z][\w.-]*)\s*(?:[<>=!~\[;]|\")"),)),
    "requirements": (r"(?:^|/)requirements[\w.-]*\.txt$", (("ExternalPackage", r"^([A-Za-z][\w.-]*)"),)),
    "gomod": (r"(?:^|/)go\.mod$", (("ExternalPackage", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v"),)),
    "pubspec": (r"(?:^|/)pubspec\.yaml$", (("ExternalPackage", r"^  (\w+):\s*[\^\d]"),)),
    "composer": (r"(?:^|/)composer\.json$", (("ExternalPackage", r'^\s*"([\w.-]+/[\w.-]+)"\s*:'),)),
    "scala": (r"\.(?:scala|sc)$", (("Function", r"^\s*(?:[\w\[\]]+\s+)*def\s+(\w+)"), ("Class", r"^\s*(?:[\w\[\]]+\s+)*(?:class|object)\s+(\w+)"), ("Trait", r"^\s*(?:sealed\s+)?trait\s+(\w+)"), ("Import", r"^\s*import\s+([\w.]+)"))),
    "lua": (r"\.lua$", (("Function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("Function", r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\b"), ("Import", r"""require\s*\(?\s*['"]([^'"]+)['"]"""))),
    "elixir": (r"\.exs?$", (("Function", r"^\s*defp?\s+([\w?!]+)"), ("Class", r"^\s*defmodule\s+([\w.]+)"), ("Interface", r"^\s*defprotocol\s+([\w.]+)"), ("Import", r"^\s*(?:alias|import|use|require)\s+([\w.]+)"))),
    "shell": (r"\.(?:sh|bash|zsh)$", (("Function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"), ("Import", r"^\s*(?:source|\.)\s+([\w./-]+)"))),
    "markdown": (r"\.(?:md|markdown)$", (("Section", r"^#{1,6}\s+(.{1,120}?)\s*#*$"), ("Import", r"\]\(([^)\s#]+)"))),
}
_COMPILED: dict[str, tuple] = {}


def format_of(path: str | None) -> str | None:
    """The first format whose file-name pattern fits the path."""
    return next((name for name, (files, _) in FORMATS.items() if path and re.search(files, path)), None)


def registry(spark: SparkSession) -> DataFrame:
    """(format, files, patterns, cap_bytes): the formats as a small table."""
    rows = [(n, f, len(p), NOTEBOOK_CAP_BYTES if n == "notebook" else CAP_BYTES) for n, (f, p) in FORMATS.items()]
    return spark.createDataFrame(rows, "format string, files string, patterns int, cap_bytes long")


def format_column(path: Column | str) -> Column:
    """The format of a path as an expression."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(*[F.when(c.rlike(files), F.lit(name)) for name, (files, _) in FORMATS.items()])


def line_patterns(name: str) -> tuple:
    """(kind, compiled pattern) of a format, compiled once."""
    if name not in _COMPILED:
        _COMPILED[name] = tuple((kind, re.compile(p)) for kind, p in FORMATS[name][1])
    return _COMPILED[name]
