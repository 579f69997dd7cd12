"""Context slices: a symbol with the types that it mentions and the signatures that it calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import resolve
from quarrylake.operators.lookup import alike, first_match
from quarrylake.operators.settle import settle


def find_symbols(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (query, path, symbol), where symbol is a name or ``Container.member``, with their symbol.

    A member of the container first, then a top-level symbol, then any member; the first in the file.
    """
    s = facts.where("fact = 'symbol'").select(F.col("path").alias("p"), F.col("ord").alias("symbol_ord"), F.col("name").alias("found"), "kind", "container", "start_line", "end_line", "signature", "body", "doc", "language")
    name = F.element_at(F.split("symbol", r"\.|::"), -1)
    owner = F.when(F.col("symbol").rlike(r"\.|::"), F.element_at(F.split("symbol", r"\.|::"), -2))
    hits = queries.withColumn("_name", name).withColumn("_owner", owner).join(s, (F.col("path") == F.col("p")) & (F.col("_name") == F.col("found")))
    hits = hits.where(F.col("_owner").isNull() | (F.col("container") == F.col("_owner")))
    tier = F.when(F.col("_owner").isNotNull(), 0).when(F.col("container").isNull(), 1).otherwise(2)
    return first_match(hits.withColumn("tier", tier), ["query"], ["tier", "symbol_ord"]).drop("_name", "_owner", "p", "found", "tier")


def not_found(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without a symbol, with the nearest name of the file, if one is near."""
    missing = queries.join(find_symbols(facts, queries).select("query"), "query", "left_anti")
    names = facts.where("fact = 'symbol'").select(F.col("path").alias("p"), "name", "ord")
    like, tier = alike(F.col("name"), F.col("symbol"))
    near = names.join(missing, F.col("p") == F.col("path")).where(like).withColumn("tier", tier)
    best = first_match(near, ["query"], ["tier", "ord"]).select("query", F.col("name").alias("suggestion"))
    return missing.join(best, "query", "left")


def slices(facts: DataFrame, files: DataFrame, queries: DataFrame, *, depth: int = 1, include_types: bool = True, include_calls: bool = True) -> DataFrame:
    """A row per query: symbol, types and calls as arrays, and token statistics against the whole file."""
    links = resolve.follow_reexports(resolve.resolve_imports(facts, files), facts.where("fact = 'symbol'"))
    found = settle(find_symbols(facts, queries))
    seeds = found.select("query", "path", "symbol_ord")
    out = found
    kinds = []
    if include_types:
        t = resolve.type_closure(facts, links, seeds, depth).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("level", "name", "kind", "target", "body"))).alias("types"))
        out, kinds = out.join(t, "query", "left"), [*kinds, "types"]
    else:
        out = out.withColumn("types", F.expr("cast(array() as array<struct<level:int,name:string,kind:string,target:string,body:string>>)"))
    if include_calls:
        c = resolve.call_stubs(facts, links, seeds).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("call_ord", "receiver", "name", "signature"))).alias("calls"))
        out, kinds = out.join(c, "query", "left"), [*kinds, "calls"]
    else:
        out = out.withColumn("calls", F.expr("cast(array() as array<struct<call_ord:bigint,receiver:string,name:string,signature:string>>)"))
    for k in kinds:
        out = out.withColumn(k, F.coalesce(k, F.array().cast(dict(out.dtypes)[k])))
    out = settle(out)
    whole = files.select("path", T.count_tokens(F.col("content")).alias("raw_tokens"), T.count_lines(F.col("content")).alias("raw_lines"))
    out = out.join(whole, "path").withColumn("markdown", markdown(out))
    out = out.withColumn("sliced_tokens", T.count_tokens(F.col("markdown"))).withColumn("sliced_lines", T.count_lines(F.col("markdown")))
    return out.withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens")))


def markdown(df: DataFrame) -> Column:
    """The slice as Markdown: symbol, then types, then calls, sections only where there is something."""
    fence = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"))
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {title}\n"), fence, F.array_join(items, "\n"), F.lit("\n```"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("# "), F.col("path"), F.lit(":"), F.col("symbol"), F.lit("\n"), fence, F.col("body"), F.lit("\n```"),
        section("Types", F.transform("types", lambda x: x["body"])), section("Calls", F.transform("calls", lambda x: x["signature"])),
    )


def fit_budget(sliced: DataFrame, budget: int) -> DataFrame:
    """The first reduction that fits: all; no comments; short types; two types; call names; two calls; folded body; signature."""
    bare = T.strip_comments(F.col("body"))
    types = F.transform("types", lambda x: T.minify_definition(x["body"]))
    calls = F.transform("calls", lambda x: T.first_line(x["signature"]))
    full_types, full_calls = F.transform("types", lambda x: x["body"]), F.transform("calls", lambda x: x["signature"])
    none = F.array().cast("array<string>")
    states = [
        ("0", F.col("body"), full_types, full_calls), ("1", bare, full_types, full_calls), ("2", bare, types, full_calls), ("2b", bare, F.slice(types, 1, 2), full_calls),
        ("3", bare, F.slice(types, 1, 2), calls), ("3b", bare, F.slice(types, 1, 2), F.slice(calls, 1, 2)), ("4", T.fold_body(bare), F.slice(types, 1, 2), F.slice(calls, 1, 2)), ("5", F.col("signature"), none, none),
    ]
    each = []
    for level, body, t, c in states:
        rendered = F.array_join(F.concat(F.array(body), t, c), "\n")
        each.append(F.struct(F.lit(level).alias("level"), rendered.alias("text"), T.count_tokens(rendered).alias("tokens")))
    out = sliced.withColumn("_all", F.array(*each))
    out = out.withColumn("fitted", F.coalesce(F.get(F.filter("_all", lambda x: x["tokens"] <= budget), F.lit(0)), F.element_at("_all", -1)))
    return out.drop("_all").withColumn("fits", F.col("fitted.tokens") <= budget)


def batch(sliced: DataFrame) -> DataFrame:
    """One row per path: symbols in order, with types distinct by name and calls by (receiver, name)."""
    first = lambda column, keys: F.aggregate(
        F.flatten(F.collect_list(column)), F.array().cast(dict(sliced.dtypes)[column]), lambda acc, x: F.when(F.exists(acc, lambda y: F.reduce(F.array(*[x[k].eqNullSafe(y[k]) for k in keys]), F.lit(True), lambda p, q: p & q)), acc).otherwise(F.concat(acc, F.array(x)))
    )
    return sliced.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("symbol_ord", "symbol", "body"))).alias("symbols"), first("types", ["name"]).alias("types"), first("calls", ["receiver", "name"]).alias("calls"))


def overview(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: language, lines, tokens and its top-level symbols in order, by path."""
    items = facts.where("fact = 'symbol' and container IS NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "signature", "doc", "start_line", "end_line"))).alias("symbols"))
    out = files.select("path", "language", T.count_lines(F.col("content")).alias("lines"), T.count_tokens(F.col("content")).alias("tokens")).join(items, "path", "left")
    return out.withColumn("symbols", F.coalesce("symbols", F.array().cast(dict(out.dtypes)["symbols"]))).orderBy("path")


def changed_symbols(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols that changed lines (file, line) fall in: the bodies are cut in buckets of lines for an equi-join."""
    from quarrylake.operators.lookup import interval_join

    s = facts.where("fact = 'symbol'").select("path", "ord", "name", "kind", "container", "start_line", "end_line")
    hits = interval_join(lines.withColumnRenamed("file", "_file"), s, "line", "start_line", "end_line", 64).where(F.col("_file") == F.col("path"))
    return hits.groupBy("path", "ord", "name", "kind", "container", "start_line", "end_line").agg(F.count("*").alias("changed"))


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes declared in source lines: path, line, method, route, handler (the next def for a decorator).

    A decorator may go over several lines: its route is in its first string.
    """
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    # In descending order the frame only grows, so a file's lines are passed once.
    w = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda pattern, inner: F.last(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", inner, 1)), ignorenulls=True).over(w)
    following = nearest(r"^\s*(async\s+)?def\s", r"def\s+(\w+)")
    string = nearest(r"""^\s*["']/""", r"""^\s*["'](/[^"']*)""")
    verbs = r"\.(get|post|put|patch|delete|GET|POST|PUT|PATCH|DELETE)\("
    call = verbs + r"""\s*["'`](/[^"'`]*)["'`]\s*(?:,\s*(.*?))?\)?;?\s*$"""
    opened = r"^\s*@[\w.]+" + verbs + r"\s*$"
    rows = rows.withColumn("following", following).withColumn("string", string).where(F.col("text").rlike(call) | F.col("text").rlike(opened))
    handler = F.when(F.ltrim("text").startswith("@"), F.col("following")).otherwise(F.regexp_extract(F.regexp_extract("text", call, 3), r"([A-Za-z_]\w*)\W*$", 1))
    route = F.when(F.col("text").rlike(opened), F.col("string")).otherwise(F.regexp_extract("text", call, 2))
    return rows.select("path", (F.col("line") + 1).alias("line"), F.upper(F.regexp_extract("text", verbs, 1)).alias("method"), route.alias("route"), handler.alias("handler")).where("route is not null")
