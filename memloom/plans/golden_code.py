"""A small golden set for the outline of source texts: sources, and by hand the symbols and calls in them."""

SOURCES = {
    "store/cache.py": '''\
import os
from store.base import Backend

class Cache(Backend, Sized):
    """A cache. Not a call: load(key)"""

    def __init__(self, size):
        self.size = limit(size)

    def get(self, key):
        # evict(key) is no call
        if key in self.rows:
            return self.rows[key]
        return self.load(key)

    async def load(self, key):
        row = await requests.get("/rows/{key}")
        return decode(row)

def decode(raw):
    text = "encode(raw)"
    return json.loads(raw, strict=False)

@app.post("/rows")
def create_row(body):
    cache = Cache(10)
    cache.get(body.key)
    return db.run("INSERT INTO rows VALUES (1)")
''',
    "src/graph.rs": '''\
use std::collections::HashMap;

pub struct Graph {
    nodes: HashMap<u64, Node>,
}

pub trait Walk {
    fn step(&mut self) -> bool;
}

impl Walk for Graph {
    fn step(&mut self) -> bool {
        let c = '{';
        self.visit(c) && helper::ready("{ not a block")
    }
}

impl Graph {
    pub fn new() -> Self {
        Graph { nodes: HashMap::new() }
    }

    fn visit(&self, c: char) -> bool {
        /* skip(c) */
        check(c)
    }
}

fn check(c: char) -> bool {
    c.is_alphabetic()
}
''',
    "web/client.ts": '''\
import { Base } from "./base";

export interface Row {
  id: number;
}

export class RowClient extends Base implements Closable {
  static async load(id: number) {
    return fetch("/rows/{id}", { method: "PUT" });
  }
}

export const format = (row: Row) => {
  return pad(row.id);
};

async function main() {
  const row = await RowClient.load(1);
  console.log(format(row), `format(${row})`);
}

app.get("/health", main);
''',
    "cmd/server.go": '''\
package main

import "net/http"

type Server struct {
	rows map[string]string
}

type Handler interface {
	Serve(path string) error
}

func (s *Server) Serve(path string) error {
	s.log(path)
	return check(path)
}

func (s *Server) log(path string) {
	// check(path)
	println(path)
}

func check(path string) error {
	return nil
}

func main() {
	s := newServer()
	http.HandleFunc("/rows", s.handle)
}

func newServer() *Server {
	return &Server{}
}
''',
    "app/jobs.py": '''\
from store.cache import decode

def nightly(raw):
    rows = decode(raw)
    return create_row(rows)
''',
}

#: (path, kind, name, line, line_end, owner)
SYMBOLS = [
    ("store/cache.py", "Class", "Cache", 4, 18, None), ("store/cache.py", "Function", "__init__", 7, 8, "Cache"), ("store/cache.py", "Function", "get", 10, 14, "Cache"),
    ("store/cache.py", "Function", "load", 16, 18, "Cache"), ("store/cache.py", "Function", "decode", 20, 22, None), ("store/cache.py", "Function", "create_row", 25, 28, None),
    ("src/graph.rs", "Struct", "Graph", 3, 5, None), ("src/graph.rs", "Trait", "Walk", 7, 9, None), ("src/graph.rs", "Function", "step", 8, 8, "Walk"), ("src/graph.rs", "Function", "step", 12, 15, "Graph"),
    ("src/graph.rs", "Function", "new", 19, 21, "Graph"), ("src/graph.rs", "Function", "visit", 23, 26, "Graph"), ("src/graph.rs", "Function", "check", 29, 31, None),
    ("web/client.ts", "Interface", "Row", 3, 5, None), ("web/client.ts", "Class", "RowClient", 7, 11, None), ("web/client.ts", "Method", "load", 8, 10, "RowClient"),
    ("web/client.ts", "Function", "format", 13, 15, None), ("web/client.ts", "Function", "main", 17, 20, None),
    ("cmd/server.go", "Struct", "Server", 5, 7, None), ("cmd/server.go", "Interface", "Handler", 9, 11, None), ("cmd/server.go", "Function", "Serve", 13, 16, "Server"),
    ("cmd/server.go", "Function", "log", 18, 21, "Server"), ("cmd/server.go", "Function", "check", 23, 25, None), ("cmd/server.go", "Function", "main", 27, 30, None), ("cmd/server.go", "Function", "newServer", 32, 34, None),
    ("app/jobs.py", "Function", "nightly", 3, 5, None),
]

#: (path, caller, name, owner)
CALLS = [
    ("store/cache.py", "__init__", "limit", None), ("store/cache.py", "get", "load", "Cache"), ("store/cache.py", "load", "get", None), ("store/cache.py", "load", "decode", None),
    ("store/cache.py", "decode", "loads", None), ("store/cache.py", "create_row", "Cache", None), ("store/cache.py", "create_row", "get", None), ("store/cache.py", "create_row", "run", None),
    ("src/graph.rs", "step", "visit", "Graph"), ("src/graph.rs", "step", "ready", None), ("src/graph.rs", "new", "new", "HashMap"), ("src/graph.rs", "visit", "check", None), ("src/graph.rs", "check", "is_alphabetic", None),
    ("web/client.ts", "load", "fetch", None), ("web/client.ts", "format", "pad", None), ("web/client.ts", "main", "load", "RowClient"), ("web/client.ts", "main", "log", None), ("web/client.ts", "main", "format", None),
    ("cmd/server.go", "Serve", "log", None), ("cmd/server.go", "Serve", "check", None), ("cmd/server.go", "log", "println", None), ("cmd/server.go", "main", "newServer", None), ("cmd/server.go", "main", "HandleFunc", None),
    ("app/jobs.py", "nightly", "decode", None), ("app/jobs.py", "nightly", "create_row", None),
]
