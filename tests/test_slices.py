"""Extraction, resolution, slices, patches on small source trees of our own."""

from __future__ import annotations

import pytest

from quarrylake.functions.extract import extract, facts_of
from quarrylake.operators import patching, resolve
from quarrylake.operators.closure import bounded_closure
from quarrylake.plans import slices

FILES = {
    ("app/models.ts", "typescript"): "export interface User { id: string; role: Role }\nexport type Role = 'a' | 'b';\n",
    ("app/index.ts", "typescript"): "export * from './models';\nexport { User as Person } from './models';\n",
    ("app/loop.ts", "typescript"): "export * from './loop';\nexport * from './models';\n",
    ("app/service.ts", "typescript"): "import { Person } from './index';\nimport { Role } from './loop';\n\n/** Finds. */\nexport class Service {\n  find(id: string): Person { return this.load(id); }\n  load(id: string): Person { return make(id); }\n}\nfunction make(id: string): Person { return { id } as Person; }\n",
    ("pkg/schemas.py", "python"): "class Invoice:\n    total: int\n\nclass Line:\n    invoice: 'Invoice'\n",
    ("pkg/billing.py", "python"): "from .schemas import Invoice as Bill\nimport json\n\ndef charge(x):\n    \"\"\"Charges.\"\"\"\n    b = Bill()\n    return helper(b, missing(x))\n\ndef helper(a, b):\n    return a\n",
    ("pkg/broken.py", "python"): "def ok(a):\n    return a\n\ndef bad(:\n    return 1\n",
    ("cmd/main.go", "go"): 'package main\n\nimport "corp/cmd"\n\ntype Server struct {\n\tpool *Pool\n}\n\nfunc (s *Server) Run(c Config) error {\n\treturn dial(c)\n}\n',
    ("cmd/pool.go", "go"): "package main\n\ntype Pool struct {\n\tn int\n}\n\nfunc dial(c Config) error { return nil }\n",
    ("src/lib.rs", "rust"): "use crate::item::{Item, Kind as K};\n\npub struct Store { items: Vec<Item> }\n\nimpl Store {\n    pub fn first(&self) -> Option<Item> { pick(self) }\n}\n\nfn pick(s: &Store) -> Option<Item> { None }\n",
    ("src/item.rs", "rust"): "pub struct Item { kind: Kind }\npub enum Kind { A, B }\n",
    ("empty.ts", "typescript"): "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, lang, len(t), t) for (p, lang), t in FILES.items()], "path string, language string, size long, content string").cache()


@pytest.fixture(scope="module")
def facts(files):
    return extract(files).cache()


def test_symbols(facts):
    found = {(r["path"], r["container"], r["name"], r["kind"]) for r in facts.where("fact = 'symbol'").collect()}
    assert {("app/service.ts", None, "Service", "class"), ("app/service.ts", "Service", "find", "method"), ("pkg/billing.py", None, "charge", "function"), ("pkg/broken.py", None, "ok", "function"), ("cmd/main.go", "Server", "Run", "method"), ("src/lib.rs", "Store", "first", "method"), ("src/item.rs", None, "Kind", "enum")} <= found
    assert not [x for x in found if x[0] == "empty.ts"]


def test_byte_ranges(facts):
    for r in facts.where("fact = 'symbol'").collect():
        text = next(t for (p, _), t in FILES.items() if p == r["path"]).encode()
        assert text[r["start_byte"] : r["end_byte"]].decode().strip() == r["body"].strip()


def test_imports(facts, files):
    got = {(r["path"], r["fact"], r["local"], r["target"]) for r in resolve.resolve_imports(facts, files).collect()}
    assert ("app/service.ts", "import", "Person", "app/index.ts") in got
    assert ("pkg/billing.py", "import", "Bill", "pkg/schemas.py") in got
    assert ("src/lib.rs", "import", "Item", "src/item.rs") in got
    assert ("cmd/main.go", "import", "cmd", "cmd/pool.go") in got


def test_reexports_end_on_cycles(facts, files):
    linked = resolve.follow_reexports(resolve.resolve_imports(facts, files), facts.where("fact = 'symbol'"))
    got = {(r["path"], r["local"]): (r["target"], r["name"]) for r in linked.collect()}
    assert got["app/service.ts", "Person"] == ("app/models.ts", "User")
    assert got["app/service.ts", "Role"] == ("app/models.ts", "Role")


def test_slices(spark, facts, files):
    q = spark.createDataFrame([(1, "app/service.ts", "Service.find"), (2, "pkg/billing.py", "charge"), (3, "cmd/main.go", "Server.Run"), (4, "src/lib.rs", "Store.first"), (5, "pkg/billing.py", "chrge")], "query long, path string, symbol string")
    got = {r["query"]: r for r in slices.slices(facts, files, q).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [t["name"] for t in got[1]["types"]] == ["Person", "Role"]
    assert [c["name"] for c in got[1]["calls"]] == ["load"]
    calls = {c["name"]: c["signature"] for c in got[2]["calls"]}
    assert calls["missing"] == "def missing(*args, **kwargs): ..." and calls["helper"].startswith("def helper")
    assert "dial" in {c["name"] for c in got[3]["calls"]}
    assert {"Item", "Kind"} <= {t["name"] for t in got[4]["types"]}
    assert [(r["query"], r["suggestion"]) for r in slices.not_found(facts, q).collect()] == [(5, "charge")]


def test_depth_and_flags(spark, facts, files):
    q = spark.createDataFrame([(1, "app/service.ts", "Service.find")], "query long, path string, symbol string")
    bare = slices.slices(facts, files, q, depth=0, include_calls=False).first()
    assert bare["types"] == [] and bare["calls"] == []


def test_budget(spark, facts, files):
    q = spark.createDataFrame([(1, "app/service.ts", "Service")], "query long, path string, symbol string")
    s = slices.slices(facts, files, q)
    assert slices.fit_budget(s, 10000).first()["fitted"]["level"] == "0"
    tight = slices.fit_budget(s, 2).first()
    assert tight["fitted"]["level"] == "5" and not tight["fits"]


def test_batch_and_overview(spark, facts, files):
    q = spark.createDataFrame([(1, "app/service.ts", "Service.find"), (2, "app/service.ts", "Service.load")], "query long, path string, symbol string")
    b = slices.batch(slices.slices(facts, files, q)).first()
    assert len(b["symbols"]) == 2 and sorted(t["name"] for t in b["types"]) == ["Person", "Role"]
    o = slices.overview(facts, files).collect()
    assert [r["path"] for r in o] == sorted(p for p, _ in FILES) and o[-1]["symbols"] and not next(r for r in o if r["path"] == "empty.ts")["symbols"]


def test_changed_symbols(spark, facts):
    lines = spark.createDataFrame([("app/service.ts", 6), ("app/service.ts", 100), ("none.ts", 1)], "file string, line long")
    assert sorted(r["name"] for r in slices.changed_symbols(facts, lines).collect()) == ["Service", "find"]


def test_routes(spark):
    text = "app.get('/users/:id', auth, showUser);\n@router.post(\"/login\")\n@limit(3)\nasync def login(x):\n    pass\nr.GET(\"/health\", h.Health)\n"
    got = slices.routes(spark.createDataFrame([("a", text)], "path string, content string")).collect()
    assert [(r["line"], r["method"], r["route"], r["handler"]) for r in sorted(got, key=lambda r: r["line"])] == [(1, "GET", "/users/:id", "showUser"), (2, "POST", "/login", "login"), (6, "GET", "/health", "Health")]


def test_patch(spark, files, tmp_path):
    edits = spark.createDataFrame([("pkg/billing.py", "helper", "def helper(a):\n    return None"), ("pkg/billing.py", "nope", "x"), ("pkg/billing.py", "charge", "def charge(:")], "path string, symbol string, replacement string")
    got = {r["symbol"]: r for r in patching.patch(files, edits).collect()}
    assert got["helper"]["status"] == "applied" and got["helper"]["after"].endswith("def helper(a):\n    return None\n") and "+def helper(a):" in got["helper"]["diff"]
    assert got["nope"]["status"] == "not_found" and got["charge"]["status"].startswith("invalid")
    target = tmp_path / "x.py"
    target.write_text("old")
    patching.replace_file(str(target), "new")
    assert target.read_text() == "new" and len(list(tmp_path.iterdir())) == 1


def test_method_patch_keeps_indent():
    source = FILES["app/service.ts", "typescript"]
    got = patching.patch_source("app/service.ts", "typescript", source, "Service.load", "load(id: string): Person {\n  return make(id + 'x');\n}")
    assert "  load(id: string): Person {\n    return make(id + 'x');\n  }\n}" in got["after"]


def test_closure_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "src string, dst string")
    got = dict(map(tuple, bounded_closure(edges, spark.createDataFrame([("a",)], "node string"), 10).collect()))
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_malformed_never_raises():
    for lang in ("python", "typescript", "go", "rust"):
        for text in ("", "{{{", "def f(:", "class {", "export * from", '"unclosed', "func (", "impl<T"):
            facts_of("x", lang, text)
