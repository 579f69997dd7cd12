"""Compound queries over facts: slices of diffs and routes, batches within a budget, test context, deep statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import show
from quarrylake.functions import text as T
from quarrylake.operators.lookup import first_match, first_per_key, top_per_key
from quarrylake.operators.settle import settle
from quarrylake.plans import render, slices
from quarrylake.sources.files import is_test_file



def symbol_queries(symbols: DataFrame) -> DataFrame:
    """(query, path, symbol) of symbols (path, ord, name, container): members by ``Container.name``."""
    named = F.concat(F.coalesce(F.concat("container", F.lit(".")), F.lit("")), F.col("name"))
    return symbols.select(F.concat("path", F.lit(":"), F.col("ord").cast("string")).alias("query"), "path", named.alias("symbol")).distinct()


def diff_slices(facts: DataFrame, files: DataFrame, lines: DataFrame, **options) -> DataFrame:
    """A slice of each symbol that changed lines (file, line) fall in; the innermost one where they are nested."""
    hit = slices.changed_symbols(facts, lines)
    inner = hit.where("container IS NOT NULL").select("path", F.col("container").alias("name")).distinct()
    own = hit.join(inner, ["path", "name"], "left_anti")
    return slices.slices(facts, files, symbol_queries(settle(own)), **options)


def route_slices(facts: DataFrame, files: DataFrame, wanted: DataFrame, **options) -> DataFrame:
    """The handler's slice for each wanted route (query, method, route); the first by file and line that has one.

    Files are first narrowed to those that hold the route's last segment. A declared route fits if
    it equals the wanted one, but for slashes at the ends and names of parameters, or is the end of it.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"(:\w+|\{\w+\}|<[^>]*>|\*\w*)", "{}"), r"^/+|/+$", "")
    w = F.broadcast(wanted.select("query", F.upper("method").alias("method"), F.col("route").alias("wanted")))
    # The last segment that isn't a parameter; a route of nothing else may be anywhere.
    literal = F.filter(F.split(plain(F.col("wanted")), "/"), lambda x: (x != "{}") & (x != ""))
    held = F.contains(F.col("content"), F.coalesce(F.try_element_at(literal, F.lit(-1)), F.lit("")))
    some = files.join(w, held, "left_semi")
    declared = slices.routes(some).where("handler is not null and handler != ''")
    fits = (plain(F.col("route")) == plain(F.col("wanted"))) | F.endswith(F.concat(F.lit("/"), plain(F.col("wanted"))), F.concat(F.lit("/"), plain(F.col("route")))) & (plain(F.col("route")) != "")
    hits = declared.join(w, "method").where(fits)
    known = facts.where("fact = 'symbol'").select("path", F.col("name").alias("handler")).distinct()
    hits = hits.join(known, ["path", "handler"]).withColumn("exact", (plain(F.col("route")) != plain(F.col("wanted"))).cast("int"))
    best = settle(first_match(hits, ["query"], ["exact", "path", "line"]))
    out = slices.slices(facts, files, best.select("query", "path", F.col("handler").alias("symbol")), **options)
    return out.join(best.select("query", "method", "route", "line"), "query")


def batches(sliced: DataFrame, budget: int | None = None, count=T.count_tokens) -> DataFrame:
    """One row per path: all its slices together, types and calls once; within ``budget`` by dropping docs, then all calls."""
    kinds = dict(sliced.dtypes)
    every = sliced.groupBy("path").agg(
        F.min("language").alias("language"), F.array_sort(F.collect_list(F.struct("symbol_ord", "symbol", "doc", "body"))).alias("symbols"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("symbol_ord", "types"))), lambda x: x["types"])).alias("types"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("symbol_ord", "calls"))), lambda x: x["calls"])).alias("calls"),
        F.min("raw_tokens").alias("raw_tokens"), F.min("raw_lines").alias("raw_lines"),
    )
    if budget is None:
        return render.measured(every, render.batch_markdown, count)
    size = count(render.batch_markdown(True))
    out = every.withColumn("_n", size)
    bare = F.transform("symbols", lambda s: F.struct(s["symbol_ord"].alias("symbol_ord"), s["symbol"].alias("symbol"), F.lit(None).cast("string").alias("doc"), s["body"].alias("body")))
    out = out.withColumn("symbols", F.when(F.col("_n") > budget, bare).otherwise(F.col("symbols"))).withColumn("level", F.when(F.col("_n") > budget, 1).otherwise(0))
    out = out.withColumn("_n", size)
    out = out.withColumn("calls", F.when(F.col("_n") > budget, F.array().cast(kinds["calls"])).otherwise(F.col("calls"))).withColumn("level", F.when(F.col("_n") > budget, 2).otherwise(F.col("level")))
    out = render.measured(out.drop("_n"), render.batch_markdown, count)
    return out.withColumn("fits", F.col("sliced_tokens") <= budget)


def budget_report(sliced: DataFrame, budget: int) -> DataFrame:
    """What the cascade did to each slice: tokens before and after, level, whether it fits and what was saved."""
    out = slices.fit_budget(sliced, budget)
    after = F.col("fitted.tokens")
    return out.select("query", "path", "symbol", F.lit(budget).alias("budget"), F.col("sliced_tokens").alias("tokens_before"), after.alias("tokens_after"), F.col("fitted.level").alias("level"), "fits", T.saturating_sub(F.col("sliced_tokens"), after).alias("tokens_cut"), F.col("fitted.text").alias("text"))


def deep_stats(facts: DataFrame, files: DataFrame, per_file: int = 5, **options) -> DataFrame:
    """Per file of a known language: the mean tokens (whole) of slices of its first ``per_file`` symbols that slice; the estimate where none do."""
    first = top_per_key(facts.where("fact = 'symbol'").select("path", "ord", "name", "container"), ["path"], [F.col("ord")], per_file)
    cut = slices.slices(facts, files, symbol_queries(settle(first)), **options).groupBy("path").agg(F.sum("sliced_tokens").alias("_sum"), F.count("*").alias("_n"))
    raw = files.where("language is not null").select("path", "language", T.count_lines(F.col("content")).alias("lines"), T.count_tokens(F.col("content")).alias("raw_tokens"))
    out = raw.join(cut, "path", "left")
    estimate = T.estimate_sliced(F.col("raw_tokens"), T.language_weight(F.col("language")))
    mean = F.floor(F.try_divide(F.col("_sum"), F.col("_n"))).cast("long")
    out = out.withColumn("sliced_tokens", F.coalesce(F.nullif(mean, F.lit(0)), estimate)).drop("_sum", "_n")
    return out.withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens"))).orderBy(F.desc("raw_tokens"), "path")


RUNNERS = {"rust": "cargo", "python": "pytest", "go": "gotest"}


def test_runner(files: DataFrame, targets: DataFrame, levels: int = 3) -> DataFrame:
    """targets (path, language) with their runner: by language; for scripts, the runner whose configuration lies nearest, up to ``levels`` folders up, else vitest."""
    configs = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("file"))
    configs = configs.where(F.col("file").rlike(r"^(vitest\.config\.(ts|js)|jest\.config\.(ts|js|json))$")).select("dir", F.regexp_extract("file", r"^(\w+)", 1).alias("runner"))
    up = folders_up("path", levels)
    near = targets.select("path").distinct().select("path", F.posexplode(up).alias("step", "dir")).join(configs, "dir")
    near = first_per_key(near.select("path", "step", "runner"), ["path"], F.struct("step", F.when(F.col("runner") == "vitest", 0).otherwise(1))).drop("step")
    by = F.create_map(*[F.lit(x) for kv in RUNNERS.items() for x in kv])[F.col("language")]
    script = F.when(F.col("language").isin("typescript", "javascript"), F.coalesce("runner", F.lit("vitest")))
    return targets.join(near, "path", "left").withColumn("runner", F.coalesce(by, script, F.lit("generic")))


def folders_up(path: str, levels: int) -> Column:
    """A file's folder and those around it, the nearest first, at most ``levels``."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    each = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(levels - 1))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    return each


def fixtures(files: DataFrame, targets: DataFrame, most: int = 3, levels: int = 4) -> DataFrame:
    """The first ``most`` test files near each target (path): its folder, its test folders, then those around it; with a snippet.

    Folders are keys of a join with the files that are named like tests, so no target looks at all files.
    """
    around = F.flatten(F.transform(folders_up("target", levels), lambda d: F.transform(F.array(*map(F.lit, ("", "tests", "test", "__tests__"))), lambda t: F.ltrim(F.rtrim(F.concat(d, F.lit("/"), t), F.lit("/")), F.lit("/")))))
    wanted = targets.select(F.col("path").alias("target")).distinct().select("target", F.posexplode(around).alias("step", "dir"))
    tests = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike("test|spec")).select(F.col("path").alias("fixture"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), show.test_snippet(F.col("content")).alias("snippet"))
    near = wanted.join(tests, "dir").where((F.col("fixture") != F.col("target")) & is_test_file(F.col("fixture"), F.col("target")))
    near = first_per_key(near.select("target", "fixture", "step", "snippet"), ["target", "fixture"], F.col("step"))
    return top_per_key(near, ["target"], [F.col("step"), F.col("fixture")], most).select(F.col("target").alias("path"), "rank", "fixture", "snippet")


def mock_text(runner: Column, calls: Column) -> Column:
    """Stand-ins for what a symbol calls, in the runner's language; empty without calls."""
    clean = lambda x: F.regexp_replace(x["name"], r"[^\p{L}\p{N}_]", "")
    said = lambda mark: lambda x: F.concat(F.lit(f"{mark} stands for "), x["name"], F.lit(": "), x["signature"])
    script = lambda make: F.array_join(F.transform(calls, lambda x: F.concat(said("//")(x), F.lit("\nconst mock_"), clean(x), F.lit(f" = {make}()"), F.lit(";"))), "\n")
    python = F.concat(F.lit("from unittest import mock\n"), F.array_join(F.transform(calls, lambda x: F.concat(said("#")(x), F.lit("\nmock_"), clean(x), F.lit(" = mock.MagicMock()"))), "\n"))
    out = F.when(runner == "vitest", script("vi.fn")).when(runner == "jest", script("jest.fn")).when(runner == "pytest", python)
    return F.when(F.size(calls) == 0, "").otherwise(out.otherwise(F.array_join(F.transform(calls, said("//")), "\n")))


def test_template(runner: Column, name: Column, path: Column) -> Column:
    """A first test of a symbol for the runner."""
    module = F.regexp_replace(path, r"\.[^./]*$", "")
    plain = F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "_")
    script = lambda head: F.concat(F.lit(head), F.lit("import { "), F.element_at(F.split(name, r"\."), 1), F.lit(" } from './"), F.element_at(F.split(module, "/"), -1), F.lit("';\n\ndescribe('"), name, F.lit("', () => {\n  it('does what it says', () => {\n    // arrange, act, assert\n  });\n});\n"))
    python = F.concat(F.lit("from "), F.regexp_replace(module, "/", "."), F.lit(" import "), F.element_at(F.split(name, r"\."), 1), F.lit("\n\n\ndef test_"), F.lower(plain), F.lit("():\n    ...\n"))
    go = F.concat(F.lit('package main\n\nimport "testing"\n\nfunc Test'), F.initcap(plain), F.lit("(t *testing.T) {\n}\n"))
    rust = F.concat(F.lit("#[cfg(test)]\nmod tests {\n    use super::*;\n\n    #[test]\n    fn checks_"), F.lower(plain), F.lit("() {}\n}\n"))
    out = F.when(runner == "vitest", script("import { describe, it, expect, vi } from 'vitest';\n")).when(runner == "jest", script("")).when(runner == "pytest", python).when(runner == "gotest", go).when(runner == "cargo", rust)
    return out.otherwise(F.concat(F.lit("// a test of "), name, F.lit("\n")))


def test_context(facts: DataFrame, files: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """For each query (query, path, symbol): its slice, test runner, stand-ins, a template and up to three fixtures."""
    s = slices.slices(facts, files, queries, **options)
    run = test_runner(files, s.select("path", "language").distinct()).select("path", "runner")
    near = fixtures(files, s.select("path")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "fixture", "snippet"))).alias("fixtures"))
    out = s.join(run, "path").join(near, "path", "left")
    out = out.withColumn("fixtures", F.coalesce("fixtures", F.array().cast(dict(out.dtypes)["fixtures"])))
    return out.withColumn("mocks", mock_text(F.col("runner"), F.col("calls"))).withColumn("template", test_template(F.col("runner"), F.col("symbol"), F.col("path")))


def after_marker(rows: DataFrame, key: str, line: str, is_marker: Column, within: int = 20) -> DataFrame:
    """Rows from a key's first marked line on, ``within`` of them at most."""
    first = F.min(F.when(is_marker, F.col(line))).over(Window.partitionBy(key))
    return rows.withColumn("_first", first).where((F.col(line) >= F.col("_first")) & (F.col(line) < F.col("_first") + within)).drop("_first")


def telemetry_of(sliced: DataFrame, source: str, duration_ms: int | None = None) -> DataFrame:
    """A telemetry event for each slice."""
    return sliced.select(
        show.now_rfc3339().alias("timestamp"), F.col("path").alias("file_path"), "symbol", "language", "raw_tokens", "sliced_tokens",
        T.saturating_sub(F.col("raw_tokens"), F.col("sliced_tokens")).alias("saved_tokens"), F.col("savings_pct").alias("savings_percentage"), "raw_lines", "sliced_lines",
        F.lit(source).alias("source"), F.lit(duration_ms).cast("long").alias("duration_ms"),
    )
