"""The public entry on temporary trees: slices, diffs, routes, tests, patches, errors, the time limit and the log."""

from __future__ import annotations

import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quarrylake import errors, tools
from quarrylake.functions import show
from quarrylake.functions.extract import facts_of
from quarrylake.operators import lookup, resolve
from quarrylake.plans import context, render
from quarrylake.sources import events
from quarrylake.sources.files import ScanOptions, scan_files

FILES = {
    "shop/orders.py": "from .models import Order\nimport api\n\n\ndef total(order: Order):\n    \"\"\"Adds up.\"\"\"\n    return add(order.lines)\n\n\ndef add(lines):\n    return sum(lines)\n\n\n@app.post(\"/orders/{id}\")\ndef place(id):\n    return total(id)\n\n\n@app.get(\n    \"/health\",\n)\ndef health():\n    return 1\n",
    "shop/models.py": "class Order:\n    lines: list\n\n    def empty(self):\n        return not self.lines\n",
    "shop/tests/test_orders.py": "def test_total():\n    assert True\n",
    "web/cart.ts": "import { Store } from './store';\n\nexport class Cart {\n  constructor(private readonly store: Store) {}\n  private note: Note;\n  fill(id: string): number { return this.store.load(id) + this.note.size(); }\n}\nexport class Note {\n  size(): number { return 1; }\n}\n",
    "web/store.ts": "export class Store {\n  load(id: string): number { return 1; }\n}\nexport function pick<T extends Base>(x: T): Result2 { return x; }\n",
    "web/jest.config.js": "module.exports = {};\n",
    "web/cart.test.ts": "it('fills', () => {});\n",
    "go.mod": "module corp/app\n",
    "cmd/main.go": 'package main\n\nimport "corp/app/store"\n\nfunc main() { store.Open() }\n',
    "store/open.go": "package store\n\nfunc Open() {}\n",
    "other/store/open.go": "package store\n\nfunc Open() {}\n",
    "out/skip.py": "x = 1\n",
    "gen/.gitignore": "*.py\n!keep.py\n",
    "gen/a.py": "a = 1\n",
    "gen/keep.py": "k = 1\n",
    ".gitignore": "secret/\n",
    "secret/s.py": "s = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    (at / "web" / "link.ts").symlink_to(at / "web" / "store.ts")
    return str(at)


@pytest.fixture(scope="module")
def w(spark, root):
    return tools.Workspace(spark, root)


def test_trees_own_rules_and_links(spark, root):
    found = lambda o=ScanOptions(): {r["path"] for r in scan_files(spark, root, o).select("path").collect()}
    got = found()
    assert "gen/keep.py" in got and not got & {"gen/a.py", "secret/s.py", "out/skip.py", "web/link.ts"}
    assert "web/link.ts" in found(ScanOptions(follow_links=True)) and "secret/s.py" in found(ScanOptions(ignore_files=()))
    assert found(ScanOptions(languages=("go",))) == {"cmd/main.go", "store/open.go", "other/store/open.go"}
    one = scan_files(spark, f"{root}/out/skip.py", ScanOptions(max_bytes=1)).collect()
    assert [(r["path"], r["content"]) for r in one] == [("skip.py", "x = 1\n")]
    assert scan_files(spark, f"{root}/nowhere").count() == 0


def test_slice_and_fields(w):
    r = w.slice("web/cart.ts", "Cart.fill").first()
    assert {c["name"]: c["signature"] for c in r["calls"]} == {"load": "load(id: string): number", "size": "size(): number"}
    assert r["markdown"].startswith("# web/cart.ts:Cart.fill\n") and "## Types" in r["markdown"] and r["savings_pct"] >= 0
    assert w.slice("shop/orders.py", "total", types=False, calls=False).select("types", "calls").first() == ([], [])


def test_generic_parameters_are_no_references():
    refs = {f[5] for f in facts_of("a.ts", "typescript", FILES["web/store.ts"]) if f[2] == "ref"}
    assert refs == {"Base", "Result2"}
    assert {f[5] for f in facts_of("a.rs", "rust", "fn pick<K: Ord, V>(m: Map2<K, V>) -> V { m }") if f[2] == "ref"} == {"Map2"}
    assert {f[5] for f in facts_of("a.go", "go", "func Pick[K comparable](k K) Item {\n\treturn Item{}\n}\n") if f[2] == "ref"} == {"Item"}


def test_modules_of_go_and_candidates(w):
    targets = {(r["path"], r["target"]) for r in resolve.resolve_imports(w.facts, w.files).where("path = 'cmd/main.go'").collect()}
    assert targets == {("cmd/main.go", "store/open.go")}
    assert resolve.candidate_paths("a/b.py", "python", "c", 1)[:2] == ["a/c.py", "a/c/__init__.py"] and resolve.candidate_paths("a/b.py", "python", "c", 1, package_first=True)[0] == "a/c/__init__.py"
    assert {"a/c.ts", "a/c.rs"} & set(resolve.candidate_paths("a/b.x", None, "./c", 0))


def test_batch_and_budget(w):
    whole = w.batch("shop/orders.py", "total, add").first()
    assert [s["symbol"] for s in whole["symbols"]] == ["total", "add"] and whole["markdown"].count("## Symbols") == 1
    tight = w.batch("shop/orders.py", ["total", "add"], budget=1).first()
    assert tight["level"] == 2 and tight["calls"] == [] and not tight["fits"] and all(s["doc"] is None for s in tight["symbols"])
    report = context.budget_report(w.slice("shop/orders.py", "total"), 5).first()
    assert report["level"] == "5" and report["tokens_cut"] == report["tokens_before"] - report["tokens_after"]
    assert render.joined_markdown(w.slice("shop/orders.py", "total,add")).first()["markdown"].count("\n---\n") == 1


def test_overview(w):
    full, none, least = (w.overview(b).first() for b in (None, 10**6, 1))
    assert full["level"] == none["level"] == 0 and least["level"] == 2 and not least["fits"]
    assert ": Adds up." in full["markdown"] and "`def total(order: Order):`" in full["markdown"] and "`" not in least["markdown"] and full["files"] == least["files"] >= 8
    assert full["markdown"].index("## cmd/main.go") < full["markdown"].index("## web/cart.ts") and "* python: " in full["markdown"]


def test_routes(w):
    r = w.route("post", "/orders/:x").first()
    assert (r["path"], r["symbol"], r["line"]) == ("shop/orders.py", "place", 14)
    assert w.route("GET", "/health").first()["symbol"] == "health"
    with pytest.raises(errors.NoRoute):
        w.route("GET", "/nowhere")


def test_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("class A:\n    def one(self):\n        return 1\n\n\ndef two():\n    return 2\n")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("class A:\n    def one(self):\n        return 11\n\n\ndef two():\n    return 2\n")
    d = tools.Workspace(spark, str(tmp_path)).diff()
    assert [r["symbol"] for r in d.collect()] == ["A.one"]


def test_stats(w):
    deep = {r["path"]: r for r in w.stats(deep=True).collect()}
    fast = {r["path"]: r for r in w.stats().collect()}
    assert set(deep) == set(fast) and deep["gen/keep.py"]["sliced_tokens"] == fast["gen/keep.py"]["sliced_tokens"]
    cut = [r["sliced_tokens"] for r in w.slice("shop/models.py", "Order,Order.empty").collect()]
    assert abs(deep["shop/models.py"]["sliced_tokens"] - sum(cut) // len(cut)) <= max(cut)
    assert "files " in render.stats_text(w.stats(), "path").first()["text"]


def test_stats_within_a_time(w):
    some, whole = w.quick_stats(0)
    assert not whole and 0 < some.count() < w.stats().count()
    every, whole = w.quick_stats(600)
    assert whole and {r["path"]: r["raw_tokens"] for r in every.collect()} == {r["path"]: r["raw_tokens"] for r in w.stats().collect()}


def test_test_context(w):
    py = w.tests("shop/orders.py", "total").first()
    assert py["runner"] == "pytest" and "MagicMock" in py["mocks"] and "def test_total" in py["template"] and [f["fixture"] for f in py["fixtures"]] == ["shop/tests/test_orders.py"]
    ts = w.tests("web/cart.ts", "Cart.fill").first()
    assert ts["runner"] == "jest" and "jest.fn()" in ts["mocks"] and "describe('Cart.fill'" in ts["template"] and [f["fixture"] for f in ts["fixtures"]] == ["web/cart.test.ts"]


def test_errors(w, root):
    with pytest.raises(errors.UnknownSymbol, match="Is total meant"):
        w.slice("shop/orders.py", "totl")
    with pytest.raises(errors.UnsupportedLanguage):
        w.slice("go.mod", "x")
    with pytest.raises(errors.UnreadableFile):
        w.slice("shop/none.py", "x")
    with pytest.raises(errors.InvalidPatch, match="line"):
        w.patch("shop/orders.py", "add", "def add(:", dry=True)
    assert "+def add(lines, more):" in w.patch("shop/orders.py", "add", "def add(lines, more):\n    return 1", dry=True)["diff"]
    assert errors.snippet("añb\nc".encode(), 0, 3) == "añ" and errors.edit_distance("kitten", "sitting") == 3


def test_tools_answer_and_never_raise(w, tmp_path, monkeypatch):
    log = tools.ToolLog(str(tmp_path / "deep" / "log.jsonl"))
    assert tools.call(w, "slice", {"path": "shop/orders.py", "symbols": "add"}, 120, log)["ok"][0]["symbol"] == "add"
    assert tools.call(w, "slice", {"path": "shop/orders.py", "symbols": "ad0"}, 120, log)["error"] == "not_found"
    assert tools.call(w, "nothing", {}, 5, log)["error"] == "unknown_tool" and tools.call(w, "route", {"x": 1}, 60, log)["error"] == "bad_arguments"
    assert "no telemetry" in tools.call(w, "metrics", {"path": str(tmp_path / "none")}, 60, log)["ok"]
    monkeypatch.setitem(tools.TOOLS, "slow", lambda ws: ws.spark.range(10**4, numPartitions=4).mapInPandas(lambda b: (time.sleep(30) or x for x in b), "id long").count())
    began = time.monotonic()
    assert tools.call(w, "slow", {}, 3, log)["error"] == "timeout" and time.monotonic() - began < 15
    kinds = [json.loads(x) for x in (tmp_path / "deep" / "log.jsonl").read_text().splitlines()]
    assert [k["event"] for k in kinds].count("request") == 6 and {k.get("status") for k in kinds} >= {"ok", "not_found", "timeout", "unknown_tool"}
    tools.ToolLog("/proc/none/x").write("request")
    assert {d["name"] for d in tools.describe()} >= {"slice", "diff", "stats", "overview", "patch", "tests", "route", "metrics"}


def test_targets_and_lists():
    assert tools.parse_target("a/b.ts:X.y") == ("a/b.ts", "X.y") and tools.parse_target("C:\\a.ts:X") == ("C:\\a.ts", "X") and tools.parse_target("none") is None
    assert tools.symbol_names(" a, ,b ") == ["a", "b"]


def test_dashboard_and_summary(spark, w, tmp_path):
    e = context.telemetry_of(w.slice("shop/orders.py", "total,add"), "test")
    events.append_events(e, str(tmp_path / "log"))
    log = events.read_events(spark, str(tmp_path / "log"))
    text = render.dashboard(log, "here")
    assert "telemetry of here" in text and "Python" in text and "last 2" in text and "shop/orders.py:add" in text
    s = json.loads(tools.TOOLS["metrics"](w, "json", str(tmp_path / "log")))
    assert s["requests"] == 2 and s["by_language"][0]["language"] == "Python" and len(s["recent"]) == 2


def test_suggestions_both_ways(spark):
    names = spark.createDataFrame([(n,) for n in ("charge", "Charge2", "refund", "ref", "x", "", None, "refundAll")], "name string")
    q = spark.createDataFrame([(n,) for n in ("chrge", "refun", "y", "CHARGE", "refundall")], "query string")
    one, two = (sorted(map(tuple, lookup.suggest(names, q, "name", "query", few=n).collect())) for n in (10, 0))
    assert one == two and ("charge", "chrge", 2) in one


def test_what_is_shown(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(show.unquoted(F.lit("'''a 'b' c'''"))) == "a 'b' c" and one(show.unquoted(F.lit('rb"x"'))) == "x" and one(show.unquoted(F.lit("plain"))) == "plain"
    assert one(show.receiver_type(F.lit("(s *Server[T])"))) == "Server" and one(show.receiver_type(F.lit("Vec<T>"))) == "Vec"
    assert one(show.last_identifier(F.lit("auth, h.Show);"))) == "Show" and one(show.inner_identifier(F.lit("post(checkout)"), "post")) == "checkout"
    assert one(show.tag_name(F.lit("<Foo.Bar x>"))) == "Foo.Bar" and one(show.rfc3339(F.lit("1960-01-01").cast("timestamp"))) == "1970-01-01T00:00:00Z"
    assert tuple(one(show.route_of(F.lit("r.GET(\"/a/:b\", h)")))) == ("GET", "/a/:b") and one(show.route_of(F.lit("x"))) is None


def test_slices_budget_strips_blocks(spark):
    from quarrylake.functions import text as T

    body = "/* one\n two\n three */\n# note\ncode\n\"\"\"doc\"\"\"\n/* one line */\nmore // kept"
    assert spark.range(1).select(T.strip_comments(F.lit(body)).alias("x")).first()["x"] == "code\nmore // kept"


def test_adapters():
    from quarrylake.functions.languages import for_language, for_path

    ts = for_path("web/cart.ts")
    source = FILES["web/cart.ts"]
    assert ts.names(source)[:3] == ["Cart", "Cart.constructor", "Cart.fill"] and ts.locate(source, "Cart.fill")["kind"] == "method" and ts.locate(source, "nope") is None
    assert [s["name"] for s in ts.inside(source, "method", ts.locate(source, "Note"))] == ["size"] and "load" in ts.calls(source, "Cart.fill") and "Store" in ts.references(source, "Cart")
    py = for_language("Python")
    assert py.locate(FILES["shop/models.py"], "empty")["container"] == "Order" and py.imports(FILES["shop/orders.py"])[0][0] == "Order"
    assert for_language("rust").names("impl A {\n    fn b() {}\n}\n") == ["A::b"]
    assert [f["line"] for f in ts.faults("function a() {\n  b(];\n}")] == [2] and ts.faults("class A { }") == [] and ts.faults("a {")[0]["kind"] == "{ is never closed"
    assert py.faults("x = (1\n")[0]["line"] == 1 and py.faults("x = 1\n") == []
    with pytest.raises(errors.UnsupportedLanguage):
        for_path("a.txt")


def test_rpc(w):
    import io

    from quarrylake import rpc

    lines = ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"jsonrpc":"2.0","method":"notifications/x"}', "", "{bad", '{"jsonrpc":"2.0","id":2,"method":"tools/list"}', '{"jsonrpc":"2.0","id":3,"method":"nope"}',
             '{"jsonrpc":"2.0","id":4,"method":"tools/call","params":{"name":"tests","arguments":{"path":"shop/none.py","symbol":"x"},"timeout":60}}']
    out = io.StringIO()
    assert rpc.serve(w, io.StringIO("\n".join(lines) + "\n"), out) == 5
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, None, 2, 3, 4] and got[1]["error"]["code"] == -32700 and got[3]["error"]["code"] == -32601
    assert got[4]["result"]["isError"] and "unreadable" in got[4]["result"]["content"][0]["text"] and len(got[2]["result"]["tools"]) >= 8


def test_command_line(spark, root, tmp_path, capsys, monkeypatch):
    from quarrylake.__main__ import arguments, main, parser

    commands = {"slice": ["a.py:x"], "diff": [], "stats": [], "overview": [], "patch": ["a.py:x"], "tests": ["a.py:x"], "route": ["get", "/x"], "metrics": [], "clear": [], "list": [], "serve": []}
    for c, rest in commands.items():
        assert parser().parse_args([c, *rest]).command == c
    assert arguments(parser().parse_args(["slice", "C:\\a.py:x,y", "--budget", "5"])) == {"depth": 1, "budget": 5, "unified": False, "path": "C:\\a.py", "symbols": "x,y"}
    assert main(["list"]) == 0 and "overview" in capsys.readouterr().out
    out = tmp_path / "o.md"
    assert main(["--root", root, "--out", str(out), "slice", "shop/models.py:Order"], spark) == 0 and out.read_text().startswith("# shop/models.py:Order")
    assert main(["--root", root, "slice", "shop/models.py:Nope"], spark) == 1 and "not_found" in capsys.readouterr().err
    assert main(["--root", root, "metrics", "--path", str(tmp_path / "none")], spark) == 0


def test_sinks(tmp_path):
    at = tmp_path / "deep" / "log.jsonl"
    assert events.append_event({"a": 1}, str(at)) and events.append_event({"b": 2}, str(at)) and len(at.read_text().splitlines()) == 2
    assert not events.append_event({"a": 1}, "/proc/none/x")
    c = tmp_path / "c.json"
    assert events.merge_json(str(c), ("servers", "own"), {"x": 1}) == "made" and events.merge_json(str(c), ("servers", "own"), {"x": 1}) == "same"
    c.write_text('{"keep": [1], "servers": {"other": 2}}')
    assert events.merge_json(str(c), ("servers", "own"), 3) == "changed" and json.loads(c.read_text()) == {"keep": [1], "servers": {"other": 2, "own": 3}}
    c.write_text("{broken")
    assert events.merge_json(str(c), ("a",), 1) == "changed" and json.loads(c.read_text()) == {"a": 1} and (tmp_path / "c.json.bak").read_text() == "{broken"
