"""Code graphs: classification, package names, import and call resolution, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import normalize_api_path

# Edge labels that mean use, and node types that are symbols.
USAGE_LABELS = ("CALLS", "IMPORTS", "IMPLEMENTS", "DEPENDS_ON")
SYMBOL_TYPES = ("Function", "Struct", "Class", "Interface", "Trait", "Method")
# Node id prefixes and the types of the nodes they name.
TYPE_BY_PREFIX = (
    ("route:", "Route"), ("table:", "Table"), ("file:", "File"), ("css:", "Stylesheet"), ("service:", "Service"), ("svc:", "Service"),
    ("endpoint:", "Endpoint"), ("contract:", "Contract"), ("schema:", "Schema"), ("pkg:", "ExternalPackage"), ("cssclass:", "CssClass"),
    ("cssid:", "CssId"), ("cssvar:", "CssVar"), ("resource:", "Resource"), ("k8s:", "K8sResource"), ("image:", "BaseImage"), ("el:", "Element"),
)
# Names and words that mark entry points.
_LIFECYCLE_NAMES = ("upgrade", "downgrade", "setup", "teardown", "setup_module", "teardown_module", "setup_class", "teardown_class", "__init__", "__main__")
_PUBLIC_WORDS = ("pub fn", "pub async fn", "pub struct", "pub enum", "pub trait", "export ")
_PLAIN_DECORATORS = (
    "@property", "@staticmethod", "@classmethod", "@abstractmethod", "@lru_cache", "@cache", "@overload", "@contextmanager", "@setter", "@getter", "@cached_property",
)


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def entrypoint_reason(label: Column | str, path: Column | str, description: Column | str) -> Column:
    """Why a symbol is an entry point, by the first rule that holds; null if it is none."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    name = F.coalesce(col(label), F.lit(""))
    file, text = F.lower(F.coalesce(col(path), F.lit(""))), F.lower(F.coalesce(col(description), F.lit("")))
    decorated = _has(text, "декоратор", "decorator") & ~_has(text, *_PLAIN_DECORATORS)
    return (
        F.when(name.isin("main", "Main") | name.endswith("::main"), "main")
        .when(_has(file, "alembic/", "migrations/", "/migration", "conftest"), "migration or environment")
        .when(name.isin(*_LIFECYCLE_NAMES), "lifecycle name")
        .when(_has(file, "tests/", "/test", "_test."), "test path")
        .when(file.startswith("test_"), "test file")
        .when(name.startswith("test_") | name.startswith("should_") | name.startswith("Test"), "test name")
        .when(_has(text, *_PUBLIC_WORDS), "public API")
        .when(_has(text, "pydantic", "dataclass"), "model")
        .when(decorated, "decorator")
    )


def node_type_of_id(node_id: Column | str) -> Column:
    """(node_type, label) by the prefix of a node id; ExternalModule and the whole id without a known one."""
    c = F.col(node_id) if isinstance(node_id, str) else node_id
    out = F.struct(F.lit("ExternalModule").alias("node_type"), c.alias("label"))
    for prefix, kind in reversed(TYPE_BY_PREFIX):
        out = F.when(c.startswith(prefix), F.struct(F.lit(kind).alias("node_type"), F.substr(c, F.lit(len(prefix) + 1)).alias("label"))).otherwise(out)
    return out


def package_of_module(lang: Column | str, module: Column | str) -> Column:
    """``pkg:<ecosystem>:<name>`` of an imported module; null for inner and relative ones and for unknown languages."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    m = F.trim(F.col(module) if isinstance(module, str) else module)
    first = lambda sep: F.element_at(F.split(m, sep), 1)
    named = lambda eco, name: F.when(name != "", F.concat(F.lit(f"pkg:{eco}:"), name))
    php = F.filter(F.split(F.lower(m), r"\\"), lambda p: p != "")
    return (
        F.when(m == "", None)
        .when(lang == "rust", F.when(~m.rlike("^(crate|self|super)::"), named("rust", first("::"))))
        .when(lang == "python", F.when(~m.startswith("."), named("pypi", first("[.]"))))
        .when(lang.isin("ts-js", "sfc"), F.when(m.rlike("^@[^/]*/"), named("npm", first("/"))).when(~m.rlike("^[./@]"), named("npm", first("/"))))
        .when(lang == "go", F.when(~F.contains(m, F.lit("://")), named("go", F.regexp_replace(m, '^"+|"+$', ""))))
        .when(lang == "php", F.when(F.size(php) >= 2, F.concat(F.lit("pkg:composer:"), F.array_join(F.slice(php, 1, 2), "/"))))
        .when(lang == "dart", F.when(m.startswith("package:"), named("pub", F.element_at(F.split(F.substr(m, F.lit(9)), "/"), 1))))
    )


def manifest_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): unchanged, changed, new or deleted between two manifests (path, hash)."""
    j = before.select("path", F.col("hash").alias("b")).join(after.select("path", F.col("hash").alias("a")), "path", "full")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return j.select("path", state.alias("state"))


def resolve_symbol(nodes: DataFrame, wanted: str) -> DataFrame:
    """The one node meant by a name: equal label, else equal path, else label containing it; the shortest label, then the smallest id."""
    how = F.when(F.col("label") == wanted, 0).when(F.col("file_path") == wanted, 1).when(F.contains(F.lower("label"), F.lit(wanted.lower())), 2)
    return nodes.withColumn("how", how).filter("how IS NOT NULL").orderBy("how", F.char_length("label"), "id").limit(1).drop("how")


def module_paths(module: Column | str, from_file: Column | str) -> Column:
    """Files a module could be, best first: Rust ``::`` paths, relative and absolute Python modules, relative scripts."""
    m = F.trim(F.col(module) if isinstance(module, str) else module)
    file = F.col(from_file) if isinstance(from_file, str) else from_file
    folder = F.when(F.contains(file, F.lit("/")), F.regexp_replace(file, "/[^/]*$", "")).otherwise("")
    up = lambda d, n: F.aggregate(F.sequence(F.lit(1), n), d, lambda a, _: F.when(F.contains(a, F.lit("/")), F.regexp_replace(a, "/[^/]*$", "")).otherwise(""))
    within = lambda d, rel: F.when(d == "", rel).otherwise(F.concat(d, F.lit("/"), rel))
    parts = F.filter(F.split(F.regexp_replace(m, "^((crate|self|super)::)+", ""), "::"), lambda p: p != "")
    ups = F.regexp_count(m, F.lit("super::"))
    root = F.when(m.startswith("crate::"), F.lit("src")).when(ups > 0, up(folder, ups)).otherwise("")
    rust = F.flatten(
        F.transform(
            F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
            lambda k: F.array(F.concat(within(root, F.array_join(F.slice(parts, F.lit(1), k), "/")), F.lit(".rs")), F.concat(within(root, F.array_join(F.slice(parts, F.lit(1), k), "/")), F.lit("/mod.rs"))),
        )
    )
    dots = F.char_length(F.regexp_extract(m, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(m, r"^\.+", ""), ".", "/")
    base = F.when(dots > 1, up(folder, dots - 1)).otherwise(folder)
    relative = F.when(rest == "", F.array(within(base, F.lit("__init__.py")))).otherwise(F.array(within(base, F.concat(rest, F.lit(".py"))), within(base, F.concat(rest, F.lit("/__init__.py")))))
    flat = F.translate(m, ".", "/")
    # Folders under which a Python module may lie.
    folders = ("backend/app/services/", "backend/app/", "backend/", "app/", "")
    absolute = F.array(*[F.concat(F.lit(f), flat, F.lit(e)) for f in folders for e in (".py", "/__init__.py")])
    script = F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ""))), lambda e: F.concat(within(folder, F.regexp_replace(m, r"^\./", "")), e))
    none = F.array().cast("array<string>")
    return F.when(m == "", none).when(F.contains(m, F.lit("::")), F.when(F.size(parts) > 0, rust).otherwise(none)).when(m.startswith("./"), script).when(m.startswith("."), relative).when(m.rlike("[/ ]"), none).otherwise(absolute)


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges (id, src, dst) with ``module:`` targets moved to the file that exists; others stay as they are."""
    from memloom.operators.joins import first_existing

    modules = edges.filter(F.col("dst").startswith("module:"))
    wanted = modules.select("id", module_paths(F.substr("dst", F.lit(8)), F.regexp_replace("src", "^file:", "")).alias("paths"))
    found = first_existing(wanted, files, "id", "paths")
    return edges.join(found, "id", "left").select("id", "src", F.coalesce(F.concat(F.lit("file:"), "path"), "dst").alias("dst"), F.col("path").isNotNull().alias("resolved"))


def consolidate_external(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, lang) with remaining ``module:`` targets moved to the package node of their ecosystem."""
    package = F.when(F.col("src").startswith("file:") & F.col("dst").startswith("module:"), package_of_module("lang", F.substr("dst", F.lit(8))))
    return edges.withColumn("dst", F.coalesce(package, F.col("dst")))


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, label): nodes for edge targets that have none."""
    absent = edges.select(F.col("dst").alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    return absent.select("node_id", node_type_of_id("node_id").alias("t")).select("node_id", "t.node_type", "t.label")


def resolve_calls(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct (caller, target, provenance): each call site's best symbol of that name.

    sites: id, file, caller, name, owner (null: bare); symbols: id, file, name, owner;
    imports: file, target_file.  The same owner in the same file comes first, then
    the same file, then an imported file; a name that only one symbol has is taken
    as a heuristic.  Candidates join by name; no more than the symbols of a name meet a site.
    """
    s = symbols.select(F.col("id").alias("target"), F.col("file").alias("t_file"), "name", F.col("owner").alias("t_owner"))
    one = s.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    unique = one.filter("n = 1").select("name", "target")
    near = sites.join(s, (sites["name"] == s["name"]) & (sites["file"] == s["t_file"])).select(
        sites["id"], "caller", "target", F.when(sites["owner"].eqNullSafe(s["t_owner"]), 0).otherwise(1).alias("p")
    )
    over = sites.join(imports.withColumnRenamed("file", "i_file"), F.col("file") == F.col("i_file"))
    over = over.join(s, (over["name"] == s["name"]) & (over["target_file"] == s["t_file"])).select(over["id"], "caller", "target", F.lit(2).alias("p"))
    far = sites.join(unique, "name").select("id", "caller", "target", F.lit(3).alias("p"))
    best = near.unionByName(over).unionByName(far).groupBy("id", "caller").agg(F.min(F.struct("p", "target")).alias("b"))
    return best.select("caller", "b.target", F.when(F.col("b.p") == 3, "HEURISTIC").otherwise("RESOLVED").alias("provenance")).filter("caller <> target").distinct()


def contract_bridges(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(client, route): client calls and contract routes with the same method and normalised path."""
    key = lambda df: df.withColumns({"__p": normalize_api_path("path"), "__m": F.upper("method")})
    a, b = key(clients).select(F.col("id").alias("client"), "__p", "__m"), key(routes).select(F.col("id").alias("route"), "__p", "__m")
    return a.join(b, ["__p", "__m"]).select("client", "route").distinct()


def snake_case(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def rpc_bridges(rpcs: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rpc, handler): rpc methods and functions whose names agree in snake case."""
    a, b = rpcs.select(F.col("id").alias("rpc"), snake_case("name").alias("k")), handlers.select(F.col("id").alias("handler"), snake_case("name").alias("k"))
    return a.join(b, "k").select("rpc", "handler").distinct()


def span_chunk(files: DataFrame, spans: DataFrame, most: int = 1500, lines: int = 40) -> DataFrame:
    """(id, chunk): lines line_start..line_end (default ``lines`` more) of each span's file under a header."""
    from memloom.functions.text import scoped_chunk

    j = spans.join(files, "path")
    end = F.coalesce("line_end", F.col("line_start") + lines)
    body = F.array_join(F.slice(F.split("content", "\n"), F.greatest(F.lit(1), F.col("line_start")).cast("int"), (end - F.col("line_start") + 1).cast("int")), "\n")
    return j.select("id", scoped_chunk("path", F.coalesce("scope", F.lit("")), body, most).alias("chunk"))
