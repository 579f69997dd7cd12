"""Slices with what their frameworks tie to them: schemas and classes that roles lead to, dependencies, guards, hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrylake.functions.frameworks import TYPE_ROLES, Registry, collapsed_jsx, local_type, minified_class
from quarrylake.operators import resolve
from quarrylake.operators.lookup import first_per_key
from quarrylake.operators.settle import settle

REFS = "path string, analyzer string, analyzer_ord int, ord long, symbol string, container string, role string, name string, detail string"
_COLUMNS = [c.split()[0] for c in REFS.split(", ")]


def framework_refs(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """References of all files (path, content) by all matching analyzers, in the registry's order.

    Files that no analyzer can match are left out by their names and marks before any text is read by Python.
    """
    registry = registry or Registry()
    some = F.lit(False)
    for a in registry.analyzers:
        some = some | a.matching(F.col("path"), F.col("content"))

    def scan(frames):
        for pdf in frames:
            yield pd.DataFrame([(p, *r) for p, text in zip(pdf["path"], pdf["content"]) for r in registry.refs(p, text or "")], columns=_COLUMNS)

    return files.where("content is not null").where(some).select("path", "content").mapInPandas(scan, REFS)


def role_closure(facts: DataFrame, links: DataFrame, refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Classes that roles of seeds (query, path, symbol, container) lead to, and those these lead to, without a bound.

    A name is visited once per query, so cycles end. Returns query, name, level, role, target, kind, body.
    """
    of = refs.where(F.col("role").isin(*TYPE_ROLES)).select("path", F.col("symbol").alias("s"), F.col("container").alias("c"), "role", "name")
    links_ = refs.where("role = 'link'").select(F.col("path").alias("target"), F.col("symbol").alias("name"), F.col("name").alias("next"), F.col("detail").alias("next_role"))
    joined = seeds.join(of, ["path"]).where((F.col("symbol") == F.col("s")) & F.col("container").eqNullSafe(F.col("c")))
    frontier = settle(first_per_key(joined.select("query", "path", "name", "role"), ["query", "name"], F.struct("role", "path")))
    visited, level = None, 0
    while not frontier.isEmpty():
        found = frontier.join(resolve.declarations(facts, frontier.select("path", "name").distinct(), links), ["path", "name"])
        found = settle(found.select("query", "name", F.lit(level).alias("level"), "role", "target", "kind", "body"))
        visited = found if visited is None else visited.unionByName(found)
        on = found.join(links_, ["target", "name"]).select("query", F.col("target").alias("path"), F.col("next").alias("name"), F.col("next_role").alias("role"))
        on = on.join(visited.select("query", "name"), ["query", "name"], "left_anti")
        frontier, level = settle(first_per_key(on, ["query", "name"], F.struct("role", "path"))), level + 1
    return visited if visited is not None else frontier.select("query", "name", F.lit(0).alias("level"), "role", F.col("path").alias("target"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("body"))


@F.pandas_udf(StringType())
def _minified(body: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([minified_class(b) if b and x == "python" else b for b, x in zip(body, language)])


@F.pandas_udf(StringType())
def _local(source: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([local_type(s, n) if s and n else None for s, n in zip(source, name)])


@F.pandas_udf(StringType())
def _collapsed(body: pd.Series) -> pd.Series:
    return body.map(lambda b: collapsed_jsx(b) if b else b)


def enhance(sliced: DataFrame, facts: DataFrame, files: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """``sliced`` (query, path, name in ``symbol``, container, language, body, types, calls) with what frameworks add.

    Types: the closure over roles, and types of the same file for files without facts; Python classes
    without bodies. Calls: signatures of dependencies and own hooks, and notes on middleware, guards and
    security. What a slice has by name already isn't added. Components' plain markup is folded.
    """
    seeds = sliced.select("query", "path", F.element_at(F.split("symbol", r"\.|::"), -1).alias("symbol"), "container", "language")
    closed = role_closure(facts, links, refs, seeds).join(seeds.select("query", "language"), "query")
    named = closed.select("query", "level", "name", "kind", "target", _minified("body", "language").alias("body"))
    own = seeds.join(refs.where(F.col("role").isin(*TYPE_ROLES)).select("path", F.col("symbol").alias("s"), F.col("container").alias("c"), "name"), "path")
    own = own.where((F.col("symbol") == F.col("s")) & (F.col("container").eqNullSafe(F.col("c")) | F.col("container").isNull())).select("query", "path", "name").distinct()
    own = own.join(closed.select("query", "name"), ["query", "name"], "left_anti").join(files.select("path", "content"), "path")
    local = own.withColumn("body", _local("content", "name")).where("body is not null").select("query", F.lit(0).alias("level"), "name", F.lit("type").alias("kind"), F.col("path").alias("target"), "body")
    types = named.unionByName(local).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("level", "name", "kind", "target", "body"))).alias("more_types"))

    said = seeds.join(refs.select("path", F.col("symbol").alias("s"), F.col("container").alias("c"), "role", "name", "ord"), "path")
    said = said.where((F.col("symbol") == F.col("s")) & (F.col("container").eqNullSafe(F.col("c")) | F.col("container").isNull()))
    called = settle(said.where(F.col("role").isin("dependency", "hook", "middleware", "guard", "security")).select("query", "path", "role", "name", "ord", "language").distinct())
    declared = resolve.declarations(facts, called.select("path", "name").distinct(), links).select("path", "name", "kind", "signature")
    note = F.concat(F.when(F.col("language") == "python", "# ").otherwise("// "), F.col("role"), F.lit(": "), F.col("name"))
    signature = (
        F.when(F.col("role").isin("middleware", "guard", "security"), note)
        .when(F.col("kind") == "class", F.concat(F.lit("class "), F.col("name"), F.lit("(...): ...")))
        .when(F.col("signature").isNotNull(), F.col("signature"))
        .when(F.col("role") == "hook", F.concat(F.lit("function "), F.col("name"), F.lit("(...args: any[]): any")))
    )
    calls = called.join(declared, ["path", "name"], "left").withColumn("signature", signature).where("signature is not null")
    calls = first_per_key(calls.select("query", "name", "ord", "signature"), ["query", "name"], F.col("ord"))
    calls = calls.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((F.col("ord") + 1_000_000).alias("call_ord"), F.lit(None).cast("string").alias("receiver"), "name", "signature"))).alias("more_calls"))

    out = sliced.join(types, "query", "left").join(calls, "query", "left")
    for column, more in (("types", "more_types"), ("calls", "more_calls")):
        kind = dict(sliced.dtypes)[column]
        new = F.filter(F.coalesce(F.col(more), F.array()).cast(kind), lambda x: ~F.exists(F.col(column), lambda y: y["name"] == x["name"]))
        out = out.withColumn(column, F.concat(column, new)).drop(more)
    folded = F.col("path").rlike(r"\.(tsx|jsx)$")
    return out.withColumn("body", F.when(folded, _collapsed(F.when(folded, F.col("body")))).otherwise(F.col("body")))
