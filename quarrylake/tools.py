"""The public entry: one session over a source tree, point queries that raise, tools by name with a time limit and a log."""

from __future__ import annotations

import json
import os
import re
import time
import traceback
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.errors import InvalidPatch, NoRoute, QuarryError, TimedOut, UnknownSymbol, UnsupportedLanguage
from quarrylake.functions.extract import extract, facts_of
from quarrylake.functions.frameworks import Registry
from quarrylake.operators import patching, resolve, rollup
from quarrylake.plans import context, frameworks, render, slices
from quarrylake.sources import events as telemetry
from quarrylake.sources import patches
from quarrylake.sources.files import ScanOptions, Walker, language_name, read_text, scan_files

TIMEOUT_S = 10.0


def parse_target(target: str) -> tuple[str, str] | None:
    """(path, symbol) of ``path:symbol``; the colon of a drive letter isn't the one. None without one."""
    m = re.match(r"((?:[A-Za-z]:)?[^:]*):(.*)$", target, re.S)
    return (m[1], m[2]) if m else None


def symbol_names(text: str | list[str]) -> list[str]:
    return [x.strip() for x in (text.split(",") if isinstance(text, str) else text) if x.strip()]


class Workspace:
    """A source tree with its facts, made once and written to the shared folder when first asked for."""

    def __init__(self, spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), registry: Registry | None = None):
        self.spark, self.root, self.options, self.registry = spark, root, options, registry or Registry()

    @cached_property
    def files(self) -> DataFrame:
        return resolve.settle(scan_files(self.spark, self.root, self.options))

    @cached_property
    def facts(self) -> DataFrame:
        return resolve.settle(extract(self.files.where("language is not null")))

    @cached_property
    def links(self) -> DataFrame:
        return resolve.follow_reexports(resolve.resolve_imports(self.facts, self.files), self.facts.where("fact = 'symbol'"))

    @cached_property
    def refs(self) -> DataFrame:
        return resolve.settle(frameworks.framework_refs(self.files, self.registry))

    def clear(self) -> None:
        """Forget what was made, so that the next query reads the tree again."""
        for name in ("files", "facts", "links", "refs"):
            self.__dict__.pop(name, None)

    def _check(self, path: str, symbols: list[str]) -> None:
        if language_name(path) is None:
            raise UnsupportedLanguage(path)
        source = read_text(os.path.join(self.root, path))
        found = [f for f in facts_of(path, language_name(path), source) if f[2] == "symbol"]
        names = [f"{f[7]}.{f[5]}" if f[7] else f[5] for f in found]
        for s in symbols:
            want = s.replace("::", ".")
            if not any(want == n or want == n.rsplit(".", 1)[-1] for n in names):
                raise UnknownSymbol(s, path, names)

    def slice(self, path: str, symbols: str | list[str], depth: int = 1, types: bool = True, calls: bool = True) -> DataFrame:
        """Slices of symbols of one file with what frameworks add, with their Markdown; raises if one isn't there."""
        names = symbol_names(symbols)
        self._check(path, names)
        queries = self.spark.createDataFrame([(k, path, s) for k, s in enumerate(names)], "query long, path string, symbol string")
        cut = slices.slices(self.facts, self.files, queries, depth=depth, include_types=types, include_calls=calls)
        more = frameworks.enhance(resolve.settle(cut), self.facts, self.files, self.links, self.refs)
        if not types:
            more = more.withColumn("types", F.array().cast(dict(more.dtypes)["types"]))
        if not calls:
            more = more.withColumn("calls", F.array().cast(dict(more.dtypes)["calls"]))
        return render.measured(more, render.slice_markdown)

    def batch(self, path: str, symbols: str | list[str], budget: int | None = None, **options) -> DataFrame:
        return context.batches(self.slice(path, symbols, **options), budget)

    def overview(self, budget: int | None = None) -> DataFrame:
        return render.overview_within(slices.overview(self.facts, self.files.where("language is not null")), self.root, budget)

    def diff(self, staged: bool = False, **options) -> DataFrame:
        lines = patches.changed_lines(patches.git_diff(self.spark, self.root, staged))
        return render.measured(context.diff_slices(self.facts, self.files, lines, **options), render.slice_markdown)

    def route(self, method: str, route: str, **options) -> DataFrame:
        wanted = self.spark.createDataFrame([(0, method, route)], "query long, method string, route string")
        out = resolve.settle(render.measured(context.route_slices(self.facts, self.files, wanted, **options), render.slice_markdown))
        if out.isEmpty():
            raise NoRoute(method, route)
        return out

    def stats(self, deep: bool = False) -> DataFrame:
        known = self.files.where("language is not null")
        return context.deep_stats(self.facts, known) if deep else rollup.file_stats(known, "content", "language", "path")

    def quick_stats(self, seconds: float) -> tuple[DataFrame, bool]:
        """File statistics of as many of the root's folders, in order of name, as the time allows; whether these are all.

        The folder that is being read when the time is up is finished; at least one is read.
        """
        began, out, whole = time.monotonic(), None, True
        for name in sorted(os.listdir(self.root)):
            if out is not None and time.monotonic() - began > seconds:
                whole = False
                break
            walker = Walker(self.root, self.options)
            is_dir = os.path.isdir(os.path.join(self.root, name))
            if walker.excluded(name, is_dir, walker.first + walker.rules_of("")):
                continue
            part = scan_files(self.spark, os.path.join(self.root, name), self.options).where("language is not null")
            part = part.withColumn("path", F.concat(F.lit(name + "/"), F.col("path")) if is_dir else F.col("path"))
            stats = resolve.settle(rollup.file_stats(part, "content", "language", "path"))
            out = stats if out is None else out.unionByName(stats)
        return (out if out is not None else rollup.file_stats(self.files, "content", "language", "path")), whole

    def tests(self, path: str, symbol: str, **options) -> DataFrame:
        self._check(path, [symbol])
        queries = self.spark.createDataFrame([(0, path, symbol)], "query long, path string, symbol string")
        return context.test_context(self.facts, self.files, queries, **options)

    def patch(self, path: str, symbol: str, text: str, dry: bool = False) -> dict:
        """The new source and a diff; the file is replaced at once unless ``dry``. Raises if it would not parse."""
        self._check(path, [symbol])
        at = os.path.join(self.root, path)
        source = read_text(at)
        done = patching.patch_source(path, language_name(path), source, symbol, text)
        if done["status"] != "applied":
            raise InvalidPatch(path, done.get("faults") or [{"line": 1, "column": 1, "kind": done["status"], "snippet": ""}])
        if not dry:
            patching.replace_file(at, done["after"])
            self.clear()
        return done


class ToolLog:
    """Requests, answers and errors as JSON lines; what can't be written is dropped."""

    def __init__(self, path: str | None):
        self.path = path

    @property
    def enabled(self) -> bool:
        return bool(self.path)

    def write(self, kind: str, **values) -> None:
        if not self.enabled:
            return
        record = {"time": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z", "event": kind} | values
        try:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(record, default=str) + "\n")
        except OSError:
            return


def _rows(df: DataFrame, *columns: str) -> list[dict]:
    """Rows of a point query's answer; it has as many as the query named."""
    return [r.asDict(recursive=True) for r in df.select(*columns).collect()]


def _slice(w: Workspace, path: str, symbols, depth: int = 1, budget: int | None = None, unified: bool = False) -> list[dict]:
    if unified:
        return _rows(w.batch(path, symbols, budget, depth=depth), "path", "markdown", "raw_tokens", "sliced_tokens", "savings_pct")
    s = w.slice(path, symbols, depth=depth)
    if budget is not None:
        return _rows(context.budget_report(s, budget), "query", "path", "symbol", "level", "tokens_before", "tokens_after", "fits", "text")
    return _rows(s.orderBy("query"), "query", "path", "symbol", "markdown", "raw_tokens", "sliced_tokens", "savings_pct")


def _metrics(w: Workspace, format: str = "text", path: str | None = None):
    at = path or telemetry.log_path()
    log = telemetry.read_events(w.spark, at)
    return render.dashboard(log, at) if format == "text" else rollup.summary(log).toJSON().first()


TOOLS: dict[str, Callable] = {
    "slice": _slice,
    "diff": lambda w, staged=False: _rows(w.diff(staged).orderBy("query"), "path", "symbol", "markdown", "raw_tokens", "sliced_tokens") + _rows(rollup.diff_totals(w.diff(staged)), "*"),
    "stats": lambda w, deep=False: render.stats_text(w.stats(deep), "path").first()["text"],
    "overview": lambda w, budget=None: _rows(w.overview(budget), "*")[0],
    "patch": lambda w, path, symbol, text, dry=False: w.patch(path, symbol, text, dry),
    "tests": lambda w, path, symbol: _rows(w.tests(path, symbol), "path", "symbol", "runner", "mocks", "template", "fixtures"),
    "route": lambda w, method, route: _rows(w.route(method, route), "path", "symbol", "route", "line", "markdown"),
    "metrics": _metrics,
}


def call(workspace: Workspace, tool: str, arguments: dict | None = None, timeout: float | None = None, log: ToolLog | None = None) -> dict:
    """Run a tool by name: {'ok': answer} or {'error': status, 'message': text}; it never raises.

    After ``timeout`` seconds (the environment's QUARRYLAKE_TIMEOUT_S, else ten) its Spark jobs are
    cancelled by their tag, so nothing goes on in the background.
    """
    log = log or ToolLog(None)
    limit = timeout or float(os.environ.get("QUARRYLAKE_TIMEOUT_S") or TIMEOUT_S)
    number, began = uuid.uuid4().hex, time.monotonic()
    log.write("request", id=number, tool=tool, arguments=arguments or {})
    if tool not in TOOLS:
        log.write("error", id=number, tool=tool, status="unknown_tool")
        return {"error": "unknown_tool", "message": f"no tool is called {tool}; there are {', '.join(sorted(TOOLS))}"}
    answer: dict = {}
    sc = workspace.spark.sparkContext

    def run() -> None:
        workspace.spark.addTag(number)
        sc.addJobTag(number)
        try:
            answer["ok"] = TOOLS[tool](workspace, **(arguments or {}))
        except QuarryError as e:
            answer.update(error=e.status, message=str(e))
        except TypeError as e:
            answer.update(error="bad_arguments", message=str(e))
        except Exception as e:  # a tool's failure is its answer
            answer.update(error="failed", message=f"{type(e).__name__}: {e}", trace=traceback.format_exc(limit=3))

    from pyspark import InheritableThread

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    worker.join(limit)
    if worker.is_alive():
        sc.cancelJobsWithTag(number)
        stopped = TimedOut(tool, limit)
        answer = {"error": stopped.status, "message": str(stopped)}
    log.write("response" if "ok" in answer else "error", id=number, tool=tool, status=answer.get("error", "ok"), seconds=round(time.monotonic() - began, 3))
    return dict(answer)


def describe() -> list[dict]:
    """The tools with their arguments, as a caller lists them."""
    import inspect

    return [{"name": n, "arguments": [p.name for p in list(inspect.signature(f).parameters.values())[1:]]} for n, f in sorted(TOOLS.items())]

