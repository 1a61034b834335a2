from memloom.operators.outline import outline, parse_edges, parse_sources
from memloom.plans import golden_code as GC

FORMAT = {"py": "python", "rs": "rust", "ts": "ts-js", "go": "go"}


def test_golden_sources():
    symbols, calls = set(), set()
    for path, text in GC.SOURCES.items():
        s, e = outline(text, FORMAT[path.rsplit(".", 1)[1]])
        symbols |= {(path, *x) for x in s}
        calls |= {(path, x.src, x.dst, x.owner) for x in e if x.label == "CALLS"}
    assert symbols == set(GC.SYMBOLS) and calls == set(GC.CALLS)


def edges(text, lang, label):
    return [(e.src, e.dst, e.method) for e in outline(text, lang)[1] if e.label == label]


def test_other_edges():
    py, rs, ts = GC.SOURCES["store/cache.py"], GC.SOURCES["src/graph.rs"], GC.SOURCES["web/client.ts"]
    assert edges(py, "python", "INHERITS") == [("Cache", "Backend", None), ("Cache", "Sized", None)] and edges(rs, "rust", "INHERITS") == [("Graph", "Walk", None)]
    assert edges(py, "python", "HTTP_CALL") == [("load", "/rows/{key}", "GET")] and edges(ts, "ts-js", "HTTP_CALL") == [("load", "/rows/{id}", "PUT")]
    assert edges(py, "python", "ROUTE") == [(None, "/rows", "POST")] and edges(py, "python", "QUERIES_TABLE") == [("create_row", "rows", None)]
    assert edges('@GetMapping("/a/b")\nclass C {}\n', "java", "ROUTE") == [(None, "/a/b", "GET")]


def test_broken_and_long_texts(spark):
    for lang in ("python", "rust", "ts-js", "go", "java", "c-cpp", "markdown"):
        for text in ("", "}}}}", "{" * 1000, "'" * 999, '"""' * 7, "/* x", "def f(:\n" * 50, "x(" * 20_000):
            outline(text, lang)
    files = spark.createDataFrame([(1, "a.py", None), (2, None, "def f(): pass"), (3, "b.py", ""), (4, "c.py", "def f(): pass")], "i long, p string, t string").selectExpr("*", "1 AS id", "'x' AS path", "2 AS line")
    assert [(r.file_id, r.name, r.line_end) for r in parse_sources(files, "i", "p", "t").collect()] == [(4, "f", 1)]
    assert parse_edges(files.limit(0), "i", "p", "t").count() == 0
