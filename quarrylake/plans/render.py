"""Slices, batches, overviews and telemetry as Markdown, JSON and text; each a column over rows that hold all they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import show
from quarrylake.functions import text as T
from quarrylake.operators.lookup import first_match

#: What stands where a section has nothing.
NOTHING = "_none_"


def _distinct(items: Column, *keys: str) -> Column:
    """Items whose keys none before has."""
    same = lambda x, y: F.reduce(F.array(*[x[k].eqNullSafe(y[k]) for k in keys]), F.lit(True), lambda p, q: p & q)
    return F.filter(items, lambda x, i: (i == 0) | ~F.exists(F.slice(items, F.lit(1), F.greatest(i, F.lit(1))), lambda y: same(x, y)))


def _fenced(tag: Column, text: Column) -> Column:
    return F.concat(F.lit("```"), tag, F.lit("\n"), text, F.lit("\n```"))


def _section(title: str, items: Column, tag: Column, apart: str) -> Column:
    return F.concat(F.lit(f"\n\n## {title}\n"), F.when(F.size(items) == 0, NOTHING).otherwise(_fenced(tag, F.array_join(F.transform(items, lambda x: F.trim(x)), apart))))


def _with_doc(doc: Column, body: Column) -> Column:
    """The body below its doc comment, unless that is empty or in the body already."""
    doc = F.trim(F.coalesce(doc, F.lit("")))
    return F.concat(F.when((doc != "") & ~F.contains(body, doc), F.concat(doc, F.lit("\n"))).otherwise(""), F.trim(body))


def _head(names: Column, counts: dict[str, Column]) -> Column:
    n = lambda k: F.coalesce(counts[k].cast("string"), F.lit("0"))
    return F.concat(F.lit("# "), F.col("path"), F.lit(":"), names, F.lit("\n"), F.lit("lines "), n("sliced_lines"), F.lit(" of "), n("raw_lines"), F.lit(", tokens "), n("sliced_tokens"), F.lit(" of "), n("raw_tokens"), F.lit(", saved "), show.percentage(F.coalesce(counts["savings_pct"], F.lit(0.0))))


_COUNTS = ("sliced_lines", "raw_lines", "sliced_tokens", "raw_tokens", "savings_pct")


def _counts(zero: bool) -> dict[str, Column]:
    return {c: F.lit(0.0 if c == "savings_pct" else 0) if zero else F.col(c) for c in _COUNTS}


def slice_markdown(zero: bool = False) -> Column:
    """One slice: its symbol, types distinct by name, calls distinct by name. ``zero``: with a heading of zeros, by which it is counted."""
    tag = show.fence_tag(F.col("language"))
    types, calls = F.transform(_distinct(F.col("types"), "name"), lambda x: x["body"]), F.transform(_distinct(F.col("calls"), "name"), lambda x: x["signature"])
    return F.concat(_head(F.col("symbol"), _counts(zero)), F.lit("\n\n## Symbol\n"), _fenced(tag, _with_doc(F.col("doc"), F.col("body"))), _section("Types", types, tag, "\n\n"), _section("Calls", calls, tag, "\n"), F.lit("\n"))


def batch_markdown(zero: bool = False) -> Column:
    """Several symbols of a file together: types distinct by name, calls by receiver and name."""
    tag = show.fence_tag(F.col("language"))
    types, calls = F.transform(_distinct(F.col("types"), "name"), lambda x: x["body"]), F.transform(_distinct(F.col("calls"), "receiver", "name"), lambda x: x["signature"])
    bodies = F.transform("symbols", lambda s: _fenced(tag, _with_doc(s["doc"], s["body"])))
    names = F.array_join(F.transform("symbols", lambda s: s["symbol"]), ", ")
    return F.concat(_head(names, _counts(zero)), F.lit("\n\n## Symbols\n"), F.when(F.size("symbols") == 0, NOTHING).otherwise(F.array_join(bodies, "\n\n")), _section("Types", types, tag, "\n\n"), _section("Calls", calls, tag, "\n"), F.lit("\n"))


def measured(df: DataFrame, markdown, count=T.count_tokens) -> DataFrame:
    """``df`` with sliced lines and tokens, the share saved and the markdown; counts are of the rendering with zeros."""
    out = df.withColumn("_zero", markdown(True))
    out = out.withColumn("sliced_tokens", count(F.col("_zero"))).withColumn("sliced_lines", T.count_lines(F.col("_zero"))).drop("_zero")
    out = out.withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens")))
    return out.withColumn("markdown", markdown(False))


def joined_markdown(sliced: DataFrame, order: str = "query") -> DataFrame:
    """All slices' markdown as one text, with a rule between them."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "markdown")))
    return sliced.agg(F.array_join(F.transform(rows, lambda x: x["markdown"]), "\n---\n\n").alias("markdown"))


def json_of(*columns: str, pretty: bool = False) -> Column:
    """Columns of a row as a JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns), {"pretty": "true"} if pretty else {})


def json_batch(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """All rows as one JSON array, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.struct(*columns).alias("row"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["row"])).alias("json"))


def overview_markdown(files: DataFrame, root: str, docs: bool = True, signatures: bool = True) -> DataFrame:
    """An overview's rows (path, language, lines, tokens, symbols) as one text: totals, languages, files with symbols by path.

    Files' sections are made by rows and joined in order; only the text itself ends in one row.
    """
    item = lambda s: F.concat(
        F.lit("* "), s["kind"], F.lit(" "), s["name"],
        F.when(F.lit(signatures) & s["signature"].isNotNull(), F.concat(F.lit(" `"), F.regexp_replace(s["signature"], r"\s+", " "), F.lit("`"))).otherwise(""),
        F.lit(" "), s["start_line"].cast("string"), F.lit("-"), s["end_line"].cast("string"),
        F.when(F.lit(docs) & s["doc"].isNotNull(), F.concat(F.lit(": "), s["doc"])).otherwise(""),
    )
    section = F.concat(F.lit("## "), F.col("path"), F.lit(" ("), F.col("language"), F.lit(", "), F.col("lines").cast("string"), F.lit(" lines, "), F.col("tokens").cast("string"), F.lit(" tokens)\n"), F.array_join(F.transform("symbols", item), "\n"))
    shown = files.agg(F.array_sort(F.collect_list(F.when(F.size("symbols") > 0, F.struct("path", section.alias("section"))))).alias("rows"))
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("n_symbols"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("raw_tokens"))
    by = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    line = F.concat(F.lit("* "), F.col("language"), F.lit(": "), F.col("files").cast("string"), F.lit(" files, "), F.col("lines").cast("string"), F.lit(" lines, "), F.col("tokens").cast("string"), F.lit(" tokens"))
    by = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("k"), "language", line.alias("line")))), lambda x: x["line"]), "\n").alias("languages"))
    text = F.concat(
        F.lit(f"# Overview of {root}\n"), F.col("files").cast("string"), F.lit(" files, "), F.col("n_symbols").cast("string"), F.lit(" symbols, "), F.col("lines").cast("string"), F.lit(" lines, "), F.col("raw_tokens").cast("string"), F.lit(" tokens\n\n"),
        F.coalesce("languages", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("rows", lambda x: x["section"]), "\n\n"), F.lit("\n"),
    )
    # Three tables of one row each.
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(totals).join(one(by), "_one").join(one(shown), "_one").select("files", "n_symbols", "lines", "raw_tokens", text.alias("markdown"))


def overview_within(files: DataFrame, root: str, budget: int | None = None, count=T.count_tokens) -> DataFrame:
    """The overview that fits: all; without docs; without docs and signatures, whatever its size then."""
    states = [(True, True)] if budget is None else [(True, True), (False, True), (False, False)]
    out = None
    for k, (docs, signatures) in enumerate(states):
        one = overview_markdown(files, root, docs, signatures).withColumn("level", F.lit(k)).withColumn("overview_tokens", count(F.col("markdown")))
        out = one if out is None else out.unionByName(one)
    fits = F.lit(True) if budget is None else F.col("overview_tokens") <= budget
    best = first_match(out.withColumn("fits", fits).withColumn("_all", F.lit(0)), ["_all"], [F.when(F.col("fits"), F.col("level")).otherwise(10 - F.col("level"))]).drop("_all")
    return best.withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("overview_tokens")))


def stats_text(stats: DataFrame, name: str, top: int = 10) -> DataFrame:
    """File statistics as text: totals, then the ``top`` files by tokens."""
    row = F.concat(F.lit("  "), F.rpad(F.col(name).cast("string"), 40, " "), F.lpad(F.col("lines").cast("string"), 8, " "), F.lit(" lines "), F.lpad(F.col("raw_tokens").cast("string"), 9, " "), F.lit(" > "), F.lpad(F.col("sliced_tokens").cast("string"), 7, " "), F.lit(" tokens "), show.percentage(F.col("savings_pct")))
    best = stats.orderBy(F.desc("raw_tokens"), name).limit(top).withColumn("row", row).withColumn("k", -F.col("raw_tokens"))
    rows = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", name, "row"))), lambda x: x["row"]), "\n").alias("rows")).withColumn("_one", F.lit(1))
    t = stats.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw"), F.coalesce(F.sum("sliced_tokens"), F.lit(0)).alias("sliced")).withColumn("_one", F.lit(1))
    pct = show.percentage(T.savings_percentage(F.col("raw"), F.col("sliced")))
    head = F.concat(F.lit("files "), F.col("files").cast("string"), F.lit("\nlines "), F.col("lines").cast("string"), F.lit("\ntokens "), F.col("raw").cast("string"), F.lit("\nsliced "), F.col("sliced").cast("string"), F.lit("\nsaved "), pct)
    return t.join(rows, "_one").select(F.concat(head, F.when(F.col("files") > 0, F.concat(F.lit("\n\n"), F.col("rows"))).otherwise("")).alias("text"))


def dashboard(events: DataFrame, where: str) -> str:
    """The telemetry's totals, languages, sources and last five events as text, for a terminal.

    Aggregates of bounded size are shown, so the rows of a few groups come to the driver.
    """
    from quarrylake.operators import rollup

    t = rollup.totals(events).first()
    if not t["requests"]:
        return f"no telemetry in {where}\n"
    number = lambda n: f"{n:,}"
    out = [f"telemetry of {where}", "", f"{'requests':>12} {'tokens saved':>16} {'reduction':>10} {'worth':>12}", f"{number(t['requests']):>12} {number(t['saved_tokens']):>16} {t['compression']:>9.1f}% {'$' + format(t['cost_standard'], '.2f'):>12}"]
    languages = rollup.by_language(events).limit(50).collect()
    if languages:
        out += ["", f"{'language':<14} {'requests':>9} {'raw':>14} {'sliced':>14} {'saved':>14} {'share':>7}"]
        out += [f"{r['language'][:14]:<14} {number(r['requests']):>9} {number(r['raw_tokens']):>14} {number(r['sliced_tokens']):>14} {number(r['saved_tokens']):>14} {r['savings_pct']:>6.1f}%" for r in languages]
    sources = rollup.by_source(events).limit(50).collect()
    if sources:
        out += ["", f"{'source':<32} {'calls':>9} {'saved':>14}"] + [f"{r['source'][:32]:<32} {number(r['requests']):>9} {number(r['saved_tokens']):>14}" for r in sources]
    last = rollup.recent(events, 5).select(show.short_time(F.col("timestamp")).alias("at"), show.tail_name(F.concat("file_path", F.lit(":"), "symbol")).alias("what"), "raw_tokens", "sliced_tokens", "savings_percentage").collect()
    if last:
        out += ["", f"last {len(last)}"] + [f"{r['at']:<16} {r['what']:<32} {number(r['raw_tokens']):>10} > {number(r['sliced_tokens']):<10} {r['savings_percentage'] or 0:>5.1f}%" for r in last]
    return "\n".join(out) + "\n"
