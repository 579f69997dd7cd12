"""Queries over source files that the driver's tables spell out: what the readers of sources find must be what the rows say.

Each customer is a class that imports its nation's type through a barrel, each nation a type that imports
its region's, and each nation a route, view, component and controller as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions.extract import FACTS, extract
from quarrylake.operators import resolve
from quarrylake.operators.settle import settle
from quarrylake.operators.spread import spread
from quarrylake.plans import frameworks, slices
from quarrylake.plans.catalogue import _query, _t


def _lines(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, size, content) of the tree."""
    n, r, c, k = F.col("n_nationkey"), F.col("n_regionkey"), F.col("c_custkey"), F.col("c_nationkey")
    nation, region, customer = (_t(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    of = lambda df, path, text: df.select(path.alias("path"), F.lit("typescript").alias("language"), text.alias("content"))
    nations = of(nation, _lines("types/nation", n, ".ts"), _lines("import { Region", r, " } from './region", r, "';\n\nexport interface Nation", n, " {\n  region: Region", r, ";\n}\n"))
    rk = F.col("r_regionkey")
    regions = of(region, _lines("types/region", rk, ".ts"), _lines("export interface Region", rk, " {\n  name: string;\n}\n"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", _lines("export * from './nation", n, "';\n").alias("line"))))
    barrel = of(nation.agg(F.array_join(F.transform(rows, lambda x: x["line"]), "").alias("text")), F.lit("types/index.ts"), F.col("text"))
    # Before contents are spelled, so only keys are shuffled; readers of the files then have tasks of a size.
    customers = of(
        spread(customer.select("c_custkey", "c_nationkey")), _lines("shop/customer", c, ".ts"),
        _lines("import { Nation", k, " } from '../types/index';\n\n/** Customer ", c, ". */\nexport class Customer", c, " {\n  home(x: Nation", k, "): Nation", k, " { return this.find(x); }\n  find(x: Nation", k, "): Nation", k, " { return pick", c, "(x); }\n}\nfunction pick", c, "(x: Nation", k, ") { return x; }\n"),
    )
    out = nations.unionByName(regions).unionByName(barrel).unionByName(customers)
    return out.select("path", "language", F.octet_length("content").cast("long").alias("size"), "content")


def _facts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The files' facts, or those of these kinds."""
    return settle(extract(source_files(spark, sf_dir), kinds or FACTS))


def _links(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    imports = resolve.resolve_imports(facts, source_files(spark, sf_dir))
    return resolve.follow_reexports(imports, facts.where("fact = 'symbol'"))


_CUSTOMER = "'shop/customer' || c_custkey || '.ts'"
_ALL = f"""symbols(path, container, name, kind, start_line, end_line, doc) AS (
  SELECT {_CUSTOMER}, NULL, 'Customer' || c_custkey, 'class', 4, 7, 'Customer ' || c_custkey || '.' FROM customer
  UNION ALL SELECT {_CUSTOMER}, 'Customer' || c_custkey, 'home', 'method', 5, 5, NULL FROM customer
  UNION ALL SELECT {_CUSTOMER}, 'Customer' || c_custkey, 'find', 'method', 6, 6, NULL FROM customer
  UNION ALL SELECT {_CUSTOMER}, NULL, 'pick' || c_custkey, 'function', 8, 8, NULL FROM customer
  UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', NULL, 'Nation' || n_nationkey, 'interface', 3, 5, NULL FROM nation
  UNION ALL SELECT 'types/region' || r_regionkey || '.ts', NULL, 'Region' || r_regionkey, 'interface', 1, 3, NULL FROM region)"""


@_query(f"WITH {_ALL} SELECT * FROM symbols")
def source_symbols(spark, sf_dir):
    return _facts(spark, sf_dir, "symbol").where("fact = 'symbol'").select("path", "container", "name", "kind", "start_line", "end_line", "doc")


@_query(f"""SELECT {_CUSTOMER} AS path, s.symbol, 'Nation' || c_nationkey AS name FROM customer, LATERAL (VALUES ('Customer' || c_custkey), ('home'), ('find'), ('pick' || c_custkey)) s(symbol)
UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', 'Nation' || n_nationkey, 'Region' || n_regionkey FROM nation""")
def source_references(spark, sf_dir):
    f = _facts(spark, sf_dir, "symbol", "ref")
    s = f.where("fact = 'symbol'").select("path", F.col("ord").alias("symbol_ord"), F.col("name").alias("symbol"))
    return f.where("fact = 'ref'").select("path", "symbol_ord", "name").join(s, ["path", "symbol_ord"]).select("path", "symbol", "name")


@_query(f"""SELECT {_CUSTOMER} AS path, 'home' AS symbol, 'this' AS receiver, 'find' AS name FROM customer UNION ALL SELECT {_CUSTOMER}, 'find', NULL, 'pick' || c_custkey FROM customer""")
def source_calls(spark, sf_dir):
    f = _facts(spark, sf_dir, "symbol", "call")
    s = f.where("fact = 'symbol' and kind = 'method'").select("path", F.col("ord").alias("symbol_ord"), F.col("name").alias("symbol"))
    return f.where("fact = 'call'").select("path", "symbol_ord", "receiver", "name").join(s, ["path", "symbol_ord"]).select("path", "symbol", "receiver", "name")


@_query(f"""SELECT {_CUSTOMER} AS path, 'import' AS fact, 'Nation' || c_nationkey AS local, 'Nation' || c_nationkey AS imported, '../types/index' AS specifier FROM customer
UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', 'import', 'Region' || n_regionkey, 'Region' || n_regionkey, './region' || n_regionkey FROM nation
UNION ALL SELECT 'types/index.ts', 'reexport', NULL, NULL, './nation' || n_nationkey FROM nation""")
def source_imports(spark, sf_dir):
    return _facts(spark, sf_dir, "import", "reexport").where("fact in ('import', 'reexport')").select("path", "fact", F.col("name").alias("local"), "imported", "specifier")


@_query(f"""SELECT {_CUSTOMER} AS path, 'import' AS fact, 'types/index.ts' AS target FROM customer
UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', 'import', 'types/region' || n_regionkey || '.ts' FROM nation
UNION ALL SELECT 'types/index.ts', 'reexport', 'types/nation' || n_nationkey || '.ts' FROM nation""")
def imports_to_files(spark, sf_dir):
    facts = _facts(spark, sf_dir, "import", "reexport")
    return resolve.resolve_imports(facts, source_files(spark, sf_dir)).select("path", "fact", "target")


@_query(f"""SELECT {_CUSTOMER} AS path, 'Nation' || c_nationkey AS local, 'types/nation' || c_nationkey || '.ts' AS target, 'Nation' || c_nationkey AS name FROM customer
UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', 'Region' || n_regionkey, 'types/region' || n_regionkey || '.ts', 'Region' || n_regionkey FROM nation""")
def imports_through_barrels(spark, sf_dir):
    return _links(spark, sf_dir, _facts(spark, sf_dir, "symbol", "import", "reexport")).select("path", "local", "target", "name")


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("query"), _lines("shop/customer", F.col("c_custkey"), ".ts").alias("path"), _lines("Customer", F.col("c_custkey"), ".home").alias("symbol"))


@_query("""SELECT c_custkey AS query, 'Nation' || c_nationkey AS name, 0 AS level, 'types/nation' || c_nationkey || '.ts' AS target FROM customer
UNION ALL SELECT c_custkey, 'Region' || n_regionkey, 1, 'types/region' || n_regionkey || '.ts' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def types_of_methods(spark, sf_dir):
    f = _facts(spark, sf_dir, "symbol", "ref", "import", "reexport")
    seeds = settle(slices.find_symbols(f, _homes(spark, sf_dir)).select("query", "path", "symbol_ord"))
    return resolve.type_closure(f, _links(spark, sf_dir, f), seeds, 1).select("query", "name", "level", "target")


@_query("""SELECT c_custkey AS query, 'this' AS receiver, 'find' AS name, 'find(x: Nation' || c_nationkey || '): Nation' || c_nationkey AS signature FROM customer""")
def calls_of_methods(spark, sf_dir):
    f = _facts(spark, sf_dir, "symbol", "call", "field", "import", "reexport")
    seeds = settle(slices.find_symbols(f, _homes(spark, sf_dir)).select("query", "path", "symbol_ord"))
    return resolve.call_stubs(f, _links(spark, sf_dir, f), seeds).select("query", "receiver", "name", "signature")


@_query("""SELECT c_custkey AS query, 'shop/customer' || c_custkey || '.ts' AS path, 'method' AS kind, 'Nation' || c_nationkey || ',Region' || n_regionkey AS types, 'find' AS calls, 8 AS raw_lines
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def slices_of_methods(spark, sf_dir):
    s = slices.slices(_facts(spark, sf_dir), source_files(spark, sf_dir), _homes(spark, sf_dir))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return s.select("query", "path", "kind", names("types").alias("types"), names("calls").alias("calls"), "raw_lines")


@_query(f"""WITH hit AS (SELECT c_custkey, 5 + CAST(c_custkey % 4 AS INTEGER) AS line FROM customer), {_ALL}
SELECT s.path, s.name, s.container, 1 AS changed FROM symbols s JOIN hit ON s.path = 'shop/customer' || c_custkey || '.ts' AND line BETWEEN start_line AND end_line""")
def symbols_of_changed_lines(spark, sf_dir):
    c = F.col("c_custkey")
    lines = _t(spark, sf_dir, "customer").select(_lines("shop/customer", c, ".ts").alias("file"), (5 + c % 4).alias("line"))
    return slices.changed_symbols(_facts(spark, sf_dir, "symbol"), lines).select("path", "name", "container", "changed")


@_query(f"""WITH {_ALL}, files(path, lines) AS (SELECT {_CUSTOMER}, 8 FROM customer UNION ALL SELECT 'types/nation' || n_nationkey || '.ts', 5 FROM nation UNION ALL SELECT 'types/region' || r_regionkey || '.ts', 3 FROM region
  UNION ALL SELECT 'types/index.ts', count(*) FROM nation)
SELECT f.path, CAST(f.lines AS BIGINT) AS lines, coalesce(string_agg(s.kind || ' ' || s.name, ',' ORDER BY start_line), '') AS symbols FROM files f LEFT JOIN symbols s ON s.path = f.path AND s.container IS NULL GROUP BY f.path, f.lines""")
def overview_of_files(spark, sf_dir):
    o = slices.overview(_facts(spark, sf_dir, "symbol"), source_files(spark, sf_dir))
    return o.select("path", "lines", F.array_join(F.transform("symbols", lambda s: F.concat(s["kind"], F.lit(" "), s["name"])), ",").alias("symbols"))


@_query("""SELECT c_custkey AS query, CASE c_custkey % 3 WHEN 0 THEN 'Customer' || c_custkey WHEN 1 THEN 'find' ELSE NULL END AS suggestion FROM customer""")
def misspelt_symbols(spark, sf_dir):
    """A symbol of each file with an edit, a third of them like nothing."""
    c = F.col("c_custkey")
    wrong = F.when(c % 3 == 0, _lines("Custmer", c)).when(c % 3 == 1, F.lit("fnd")).otherwise(F.lit("zzzzzz"))
    q = _t(spark, sf_dir, "customer").select(c.alias("query"), _lines("shop/customer", c, ".ts").alias("path"), wrong.alias("symbol"))
    return slices.not_found(_facts(spark, sf_dir, "symbol"), q).select("query", "suggestion")


def _framework_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    texts = {
        ("api/nation", ".py"): _lines("from fastapi import APIRouter, Depends\nrouter = APIRouter()\n\n@router.get(\"/nations/", n, "\", response_model=Region", r, ")\nasync def get_", n, "(body: Nation", n, ", db=Depends(open_", r, ")) -> Region", r, ":\n    return body\n"),
        ("views/nation", ".py"): _lines("from rest_framework import viewsets\n\nclass Nation", n, "View(viewsets.ModelViewSet):\n    queryset = Nation", n, ".objects.all()\n    serializer_class = Region", r, "Serializer\n    permission_classes = [IsIn", r, "]\n"),
        ("ui/nation", ".tsx"): _lines("export function Nation", n, "Card({ id }: Nation", n, "Props) {\n  const r = useRegion", r, "(id);\n  const [a, b] = useState(1);\n  return <p>{r}</p>;\n}\n"),
        ("web/nation", ".ts"): _lines("import express from 'express';\nrouter.post('/n/", n, "', inRegion", r, ", check(Region", r, "Schema), save", n, ");\n"),
        ("nest/nation", ".ts"): _lines("@Controller('n')\n@UseGuards(Region", r, "Guard)\nexport class Nation", n, "Controller {\n  @Post()\n  add(@Body() x: Nation", n, "Dto): Promise<Region", r, "Dto> {\n    return 1;\n  }\n}\n"),
        ("java/Nation", ".java"): _lines("@RestController\npublic class Nation", n, " {\n    @Secured(\"REGION_", r, "\")\n    public ResponseEntity<Region", r, "View> add(@RequestBody Nation", n, "Body body) {\n        return null;\n    }\n}\n"),
    }
    out = None
    for (path, end), text in texts.items():
        one = _t(spark, sf_dir, "nation").select(_lines(path, n, end).alias("path"), text.alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


_REFS = {
    "fastapi": ("'api/nation' || n || '.py'", "'get_' || n", [("route", "'get'"), ("response", "'Region' || r"), ("parameter", "'Nation' || n"), ("dependency", "'open_' || r")]),
    "django": ("'views/nation' || n || '.py'", "'Nation' || n || 'View'", [("model", "'Nation' || n"), ("serializer", "'Region' || r || 'Serializer'"), ("permission", "'IsIn' || r")]),
    "react": ("'ui/nation' || n || '.tsx'", "'Nation' || n || 'Card'", [("props", "'Nation' || n || 'Props'"), ("hook", "'useRegion' || r")]),
    "express": ("'web/nation' || n || '.ts'", "'save' || n", [("route", "'post'"), ("middleware", "'inRegion' || r"), ("middleware", "'check(Region' || r || 'Schema)'"), ("dto", "'Region' || r || 'Schema'")]),
    "nest": ("'nest/nation' || n || '.ts'", "'add'", [("guard", "'Region' || r || 'Guard'"), ("dto", "'Nation' || n || 'Dto'"), ("dto", "'Region' || r || 'Dto'")]),
    "spring": ("'java/Nation' || n || '.java'", "'add'", [("security", "'@Secured(\"REGION_' || r || '\")'"), ("dto", "'Nation' || n || 'Body'"), ("dto", "'Region' || r || 'View'")]),
}


def _refs_of(name: str, query: str):
    path, symbol, rows = _REFS[name]
    sql = "WITH t AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation) " + " UNION ALL ".join(f"SELECT {path} AS path, {symbol} AS symbol, '{role}' AS role, {what} AS name FROM t" for role, what in rows)

    def run(spark, sf_dir):
        refs = frameworks.framework_refs(_framework_files(spark, sf_dir))
        return refs.where(F.col("analyzer") == name).select("path", "symbol", "role", "name")

    run.__name__ = query
    return _query(sql)(run)


fastapi_routes = _refs_of("fastapi", "fastapi_routes")
django_views = _refs_of("django", "django_views")
react_components = _refs_of("react", "react_components")
express_routes = _refs_of("express", "express_routes")
nest_controllers = _refs_of("nest", "nest_controllers")
spring_controllers = _refs_of("spring", "spring_controllers")


@_query("""SELECT 'api/nation' || n_nationkey || '.py' AS path, 4 AS line, 'GET' AS method, '/nations/' || n_nationkey AS route, 'get_' || n_nationkey AS handler FROM nation
UNION ALL SELECT 'web/nation' || n_nationkey || '.ts', 2, 'POST', '/n/' || n_nationkey, 'save' || n_nationkey FROM nation""")
def declared_routes(spark, sf_dir):
    return slices.routes(_framework_files(spark, sf_dir))
