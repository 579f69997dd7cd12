"""What queries do as their tables grow: work dealt out to tasks, and joins whose rows are bounded."""

import duckdb
import pytest

from quarrylake.functions.extract import extract
from quarrylake.operators import lookup, resolve
from quarrylake.plans import catalogue, catalogue_sources

CUSTOMERS = 25_000


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Tables of which customers and suppliers are one row group each, however many."""
    at = tmp_path_factory.mktemp("shop")
    con = duckdb.connect()
    for name, sql in {
        "region": "SELECT i AS r_regionkey FROM range(2) t(i)",
        "nation": "SELECT i AS n_nationkey, i % 2 AS n_regionkey FROM range(20) t(i)",
        "customer": f"SELECT i AS c_custkey, i % 20 AS c_nationkey, CASE WHEN i % 50 > 0 THEN i % 7 * 50.5e0 - 99 END AS c_acctbal FROM range({CUSTOMERS}) t(i)",
        "supplier": "SELECT i % 90 AS s_suppkey, CASE WHEN i % 30 > 0 THEN i % 40 * 10e0 - 300 END AS s_acctbal FROM range(100) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 1000000)")
    return str(at)


def test_source_files_are_dealt_out_to_tasks(spark, shop):
    sizes = catalogue_sources.source_files(spark, shop).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == CUSTOMERS + 20 + 2 + 1
    assert max(sizes) <= 12_000


def test_specifiers_and_names_are_followed_once_for_all_importers(spark, monkeypatch):
    nations, importers = 20, 60
    files = [("types/index.ts", "".join(f"export * from './n{k}';\n" for k in range(nations)))]
    files += [(f"types/n{k}.ts", f"export interface N{k} {{\n  a: string;\n}}\n") for k in range(nations)]
    files += [(f"shop/c{k}.ts", f"import {{ N{k % 2} }} from '../types/index';\n") for k in range(importers)]
    files = spark.createDataFrame([(p, "typescript", t) for p, t in files], "path string, language string, content string").cache()
    settle, sizes = resolve.settle, []

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    facts = settle(extract(files))
    monkeypatch.setattr(resolve, "settle", counted)
    imports = resolve.resolve_imports(facts, files)
    assert {(r["path"], r["target"]) for r in imports.collect()} == {(f"shop/c{k}.ts", "types/index.ts") for k in range(importers)} | {("types/index.ts", f"types/n{k}.ts") for k in range(nations)}
    links = resolve.follow_reexports(imports, facts.where("fact = 'symbol'"))
    assert {tuple(r) for r in links.select("path", "local", "target", "name").collect()} == {(f"shop/c{k}.ts", f"N{k % 2}", f"types/n{k % 2}.ts", f"N{k % 2}") for k in range(importers)}
    assert max(sizes) == importers + nations  # not importers times nations


def test_facts_of_some_kinds_are_those_of_all(spark):
    text = "import { A } from './a';\nexport class B {\n  a: A;\n  go(x: A): A { return this.find(x); }\n}\nexport * from './c';\n"
    files = spark.createDataFrame([("b.ts", "typescript", text), ("e.ts", "typescript", ""), ("n.ts", None, text), ("x.py", "python", "def f(a: B):\n    return g(a)\n")], "path string, language string, content string")
    every = {tuple(r) for r in extract(files).collect()}
    assert {r[0] for r in every} == {"b.ts", "x.py"} and {r[2] for r in every} == {"symbol", "ref", "call", "field", "import", "reexport"}
    for kinds in (("symbol",), ("import", "reexport"), ("symbol", "call"), ("ref", "field")):
        assert {tuple(r) for r in extract(files, kinds).collect()} == {r for r in every if r[2] in kinds}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _same(spark, name, at, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS FROM '{at}/{t}.parquet'")
    out = catalogue.QUERIES[name](spark, at)
    theirs = con.execute(f"SELECT {', '.join(out.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(theirs) and theirs
    return out


def test_points_are_counted_by_place_before_the_interval_join(spark, shop):
    plan = _plan(_same(spark, "interval_join", shop, ("customer", "supplier")))
    assert "Aggregate" in plan[plan.rindex("Join") :]
    points = spark.createDataFrame([(x,) for x in (1, 1, 5, 9, -4, 10)], "at long")
    intervals = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", -4, 10), ("d", 6, 8), ("e", None, 5)], "k string, low long, high long")
    assert {r["k"]: (r["n"], r["total"]) for r in lookup.interval_sums(points, intervals, "at", "low", "high", 3).collect()} == {"a": (3, 7), "b": (3, 7), "c": (6, 22)}


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """Documents whose ids repeat or are null."""
    at = str(tmp_path_factory.mktemp("words"))
    rows = [(k, "Six six the end", "en") for k in range(6)] + [(k, "five", "de") for k in range(5)] + [(None, "five eins six", None), (None, "five", "xx"), (1, "Six neu neu", "en"), (90, None, "en"), (91, "", "fr")]
    rows += [(100 + k % 3, "drei", "es") for k in range(9)] + [(200 + k // 2, "neu alt", "en") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{at}/d")
    duckdb.connect().execute(f"COPY (FROM '{at}/d/*.parquet') TO '{at}/documents.parquet' (FORMAT parquet)")
    return at


def test_words_of_documents_whose_ids_repeat_or_are_null(spark, words):
    out = _same(spark, "builtin_anti_join", words, ("documents",))
    assert {r["word"]: (r["uses"], r["docs"]) for r in out.collect()} == {"six": (14, 6), "end": (6, 6), "neu": (14, 7), "alt": (12, 6)}


def test_texts_are_not_shuffled_for_their_weights(spark, words):
    out = catalogue.QUERIES["estimate_sliced"](spark, words)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 37
