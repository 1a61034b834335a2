"""The registry, without the subpackage for training text as well as with it."""

import ast
from pathlib import Path

import __spark_entry__ as entry
from memloom.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in registry.queries()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["mem_key", "seq"] and df.count() > 0


def test_core_never_imports_the_subpackage():
    for path in (ROOT / "memloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("memloom.llm") for n in names), path
