"""More queries over the driver's tables: what users type and are shown, lookups in order, closures, renderings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylake.functions import show
from quarrylake.functions import text as T
from quarrylake.functions.frameworks import Analyzer
from quarrylake.operators import lookup, rollup
from quarrylake.operators.closure import bounded_closure
from quarrylake.plans import context, render
from quarrylake.plans.catalogue import _DOC_STATS, _EVENTS, _LINES, _PCT, _doc_stats, _query, _t, _telemetry
from quarrylake.sources.files import is_test_file


@_query("""WITH r AS (SELECT o_orderkey, o_totalprice, round(o_totalprice / 1000 * 10) / 10 AS share, o_orderpriority FROM orders)
SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS whole, printf('$%.2f', o_totalprice) AS worth, printf('%.1f%%', share) AS share,
       left(o_orderpriority, 14) AS short, CASE WHEN length('order/' || o_orderkey || '/' || o_orderpriority || '/of/customer') > 32 THEN '...' || right('order/' || o_orderkey || '/' || o_orderpriority || '/of/customer', 29) ELSE 'order/' || o_orderkey || '/' || o_orderpriority || '/of/customer' END AS tail FROM r""")
def shown_numbers(spark, sf_dir):
    name = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderpriority"), F.lit("/of/customer"))
    share = F.round(F.col("o_totalprice") / 1000 * 10) / 10
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.thousands(F.floor("o_totalprice")).alias("whole"), show.currency(F.col("o_totalprice")).alias("worth"), show.percentage(share).alias("share"), show.short_name(F.col("o_orderpriority")).alias("short"), show.tail_name(name).alias("tail"))


@_query(r"""WITH t AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'C:' ELSE '' END || regexp_replace(url, '^[^:]*://', '') || ':Page' || page_id || '.show' AS target FROM pages)
SELECT page_id, regexp_extract(target, '^((?:[A-Za-z]:)?[^:]*):', 1) AS path, regexp_extract(target, '^(?:[A-Za-z]:)?[^:]*:(.*)$', 1) AS symbol FROM t""")
def typed_targets(spark, sf_dir):
    drive = F.when(F.col("page_id") % 2 == 0, "C:").otherwise("")
    target = F.concat(drive, F.regexp_replace("url", "^[^:]*://", ""), F.lit(":Page"), F.col("page_id").cast("string"), F.lit(".show"))
    return _t(spark, sf_dir, "pages").select("page_id", show.target_path(target).alias("path"), show.target_symbol(target).alias("symbol"))


@_query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM documents)
SELECT doc_id, CAST(len(names) AS BIGINT) AS n, md5(array_to_string(names, '|')) AS digest FROM s""")
def typed_lists(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", show.symbol_list(F.col("text")).alias("names"))
    return d.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|").cast("binary")).alias("digest"))


@_query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp_ms FROM events""")
def shown_times(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", show.rfc3339(F.col("ts")).alias("stamp"), show.rfc3339(F.col("ts"), True).alias("stamp_ms"))


_ALIASES = ["TS", "tsx", "Py", "golang", "rs", "kotlin", "JSX"]


@_query(f"""WITH a AS (SELECT doc_id, {_ALIASES}[doc_id % 7 + 1] AS alias FROM documents)
SELECT doc_id, CASE lower(alias) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN 'python' WHEN 'golang' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'jsx' THEN 'jsx' ELSE alias END AS tag FROM a""")
def fence_tags(spark, sf_dir):
    alias = F.element_at(F.array(*map(F.lit, _ALIASES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", show.fence_tag(alias).alias("tag"))


@_query("""WITH x AS (SELECT doc_id, replace(replace(substr(text, 1, 30), '"', ''), '''', '') AS x FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN trim(x) ELSE x END) AS digest FROM x""")
def unquoted_literals(spark, sf_dir):
    x = F.translate(F.substring("text", 1, 30), "\"'", "")
    k = F.col("doc_id") % 4
    literal = F.when(k == 0, F.concat(F.lit('"'), x, F.lit('"'))).when(k == 1, F.concat(F.lit("rb'"), x, F.lit("'"))).when(k == 2, F.concat(F.lit('f"""'), x, F.lit('"""'))).otherwise(x)
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(show.unquoted(literal).cast("binary")).alias("digest"))


@_query(r"""WITH s AS (SELECT p_partkey, 'Map<' || p_brand || ', List<' || p_type || '>>' AS s, '(p *' || replace(p_brand, '#', '') || '[T])' AS r FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(regexp_extract(s, '<(.*)>', 1), ','), lambda x: trim(x)), '|') AS arguments, regexp_extract(r, '\*(\w+)', 1) AS receiver FROM s""")
def generic_arguments(spark, sf_dir):
    text = F.concat(F.lit("Map<"), F.col("p_brand"), F.lit(", List<"), F.col("p_type"), F.lit(">>"))
    receiver = F.concat(F.lit("(p *"), F.translate("p_brand", "#", ""), F.lit("[T])"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(show.generic_arguments(text), "|").alias("arguments"), show.receiver_type(receiver).alias("receiver"))


@_query(r"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part), c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'use' || upper(left(word, 1)) || substr(word, 2) WHEN 1 THEN 'useMemo' ELSE word END AS name FROM w)
SELECT p_partkey, name, regexp_matches(name, '^\p{Lu}') AS pascal, regexp_matches(name, '^use\p{Lu}') AND name <> 'useMemo' AS hook FROM c""")
def name_shapes(spark, sf_dir):
    word = F.element_at(F.split("p_name", " "), 1)
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("use"), F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000))).when(F.col("p_partkey") % 3 == 1, F.lit("useMemo")).otherwise(word)
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("name"), show.is_pascal_case(name).alias("pascal"), show.is_custom_hook(name).alias("hook"))


@_query("SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS json FROM customer")
def json_rows(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", render.json_of("c_custkey", "c_name", "c_mktsegment").alias("json"))


@_query("SELECT CAST(to_json(list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey)) AS VARCHAR) AS json FROM region")
def json_batch(spark, sf_dir):
    return render.json_batch(_t(spark, sf_dir, "region"), "r_regionkey", "r_regionkey", "r_name")


@_query("SELECT doc_id, trim(substr(string_split(text, chr(10))[1], 1, 50)) AS snippet, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' ELSE 'lf' END AS ending FROM documents")
def first_snippets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", show.first_bytes(F.col("text")).alias("snippet"), show.line_ending(F.col("text")).alias("ending"))


_MARK = r"^\s*(The|Die|La|El|It|Un)\b"


@_query(rf"""WITH r AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS rows FROM documents),
p AS (SELECT doc_id, rows, greatest(coalesce(list_position(list_transform(rows, lambda x: regexp_matches(x, '{_MARK}')), true), 0), 1) AS first FROM r)
SELECT doc_id, md5(array_to_string(CASE WHEN len(rows) <= 6 THEN rows ELSE rows[first:first + 3] END, chr(10))) AS digest FROM p""")
def marked_snippets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(show.test_snippet(F.col("text"), T.in_ascii(_MARK), 6, 4).cast("binary")).alias("digest"))


@_query(rf"""WITH l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
f AS (SELECT *, min(CASE WHEN regexp_matches(line, '{_MARK}') THEN i END) OVER (PARTITION BY doc_id) AS first FROM l)
SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM f WHERE i >= first AND i < first + 3 GROUP BY doc_id""")
def after_first_mark(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    near = context.after_marker(lines, "doc_id", "i", F.col("line").rlike(T.in_ascii(_MARK)), 3)
    return near.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@_query(r"""WITH s AS (SELECT doc_id, list_concat(['/* head'], string_split(text, chr(10))[1:1], ['end */'], string_split(text, chr(10))[2:], ['// tail']) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
b AS (SELECT *, coalesce(max(CASE WHEN starts_with(trim(line), '/*') AND NOT contains(line, '*/') THEN i END) OVER w, 0) > coalesce(max(CASE WHEN contains(line, '*/') THEN i END) OVER w, 0) AS inside FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN NOT inside AND NOT regexp_matches(trim(line), '^(/\*|//|#|"{3}|[''][''][''])') THEN line END, chr(10) ORDER BY i), '')) AS digest FROM b GROUP BY doc_id""")
def strip_blocks(spark, sf_dir):
    rows = F.split("text", "\n")
    text = F.array_join(F.concat(F.array(F.lit("/* head")), F.slice(rows, 1, 1), F.array(F.lit("end */")), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.lit("// tail"))), "\n")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_comments(text).cast("binary")).alias("digest"))


@_query(r"""SELECT page_id, regexp_matches(lower(regexp_extract(url, '[^/]*$')), 'test|spec') AND lower(regexp_extract(url, '\.([^./]+)$', 1)) = 'html' AS is_test FROM pages""")
def test_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", is_test_file(F.col("url"), F.lit("a.html")).alias("is_test"))


_MARKUP = Analyzer("markup", ("html",), ("<nav", "<table", "<li"), lambda path, source: iter(()), ("xml",), ("/docs/", "/1"))


@_query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS extension, html, url FROM pages)
SELECT page_id, extension = 'xml' OR extension = 'html' AND (contains(html, '<nav') OR contains(html, '<table') OR contains(html, '<li') OR contains(url, '/docs/') OR contains(url, '/1')) AS matches FROM p""")
def framework_marks(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", "[?#].*$", ""))
    return p.select("page_id", _MARKUP.matching(F.col("path"), F.col("html")).alias("matches"))


_WANTED = ["/es/", "en/1", "example.org/fr"]


@_query(f"""WITH w(wanted) AS (VALUES {', '.join(f"('{x}')" for x in _WANTED)})
SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM w WHERE contains(url, wanted) OR contains(html, wanted))""")
def holds_any(spark, sf_dir):
    w = F.broadcast(spark.createDataFrame([(x,) for x in _WANTED], "wanted string"))
    return _t(spark, sf_dir, "pages").join(w, F.contains("url", F.col("wanted")) | F.contains("html", F.col("wanted")), "left_semi").select("page_id")


_WORDS = ["that", "nicht", "pour", "zzz"]


@_query(f"""WITH w(word) AS (VALUES {', '.join(f"('{x}')" for x in _WORDS)}),
l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))
SELECT word, doc_id, i AS line FROM l JOIN w ON contains(line, word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, i) = 1""")
def first_line_with(spark, sf_dir):
    w = F.broadcast(spark.createDataFrame([(x,) for x in _WORDS], "word string"))
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = lines.join(w, F.contains("line", F.col("word"))).select("word", "doc_id", (F.col("i") + 1).cast("long").alias("line"))
    # By aggregation: each task keeps one row a word.
    return hits.groupBy("word").agg(F.min(F.struct("doc_id", "line")).alias("b")).select("word", "b.doc_id", "b.line")


@_query("""WITH tiers AS (
  SELECT c_custkey, 0 AS tier, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey
  UNION ALL SELECT c_custkey, 1, s_suppkey FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey JOIN supplier ON s_nationkey = b.n_nationkey)
SELECT c_custkey, rank, s_suppkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, s_suppkey) AS rank FROM tiers) WHERE rank <= 3""")
def ladder_first_three(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), _t(spark, sf_dir, "nation")
    # Three suppliers of a nation, and of a region without that nation, are all that a customer can need.
    near = lookup.top_per_key(s, ["s_nationkey"], [F.col("s_suppkey")], 3).select(F.col("s_nationkey").alias("c_nationkey"), F.lit(0).alias("tier"), "s_suppkey")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    top = lookup.top_per_key(s, ["s_nationkey"], [F.col("s_suppkey")], 3).drop("rank")
    wide = a.join(b, "n_regionkey").where("c_nationkey != s_nationkey").join(top, "s_nationkey")
    wide = lookup.top_per_key(wide, ["c_nationkey"], [F.col("s_suppkey")], 3).select("c_nationkey", F.lit(1).alias("tier"), "s_suppkey")
    best = lookup.top_per_key(near.unionByName(wide), ["c_nationkey"], [F.col("tier"), F.col("s_suppkey")], 3)
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(best, "c_nationkey").select("c_custkey", F.col("rank").cast("long").alias("rank"), "s_suppkey", "tier")


@_query("""SELECT doc_id, md5(CASE WHEN length(text) >= 12 THEN 'A' || substr(text, 4, 2) || 'BB' || substr(text, 9, 2) || substr(text, 12) ELSE text END) AS digest FROM documents""")
def edits_from_the_right(spark, sf_dir):
    edits = F.array(*[F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end"), F.lit(w).alias("with")) for a, b, w in ((0, 3, "A"), (10, 11, ""), (5, 8, "BB"))])
    text = F.when(F.length("text") >= 12, show.replaced(F.col("text"), edits)).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


_TAGS = "</?(?:body|ul|li|p|a|div)[ >]"


@_query(rf"""WITH t AS (SELECT page_id, i, m[i] AS tag FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_TAGS}') AS m FROM pages))),
d AS (SELECT page_id, i, tag, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t),
b AS (SELECT page_id, min(i) AS body, min_by(depth, i) AS base FROM d WHERE starts_with(tag, '<body') GROUP BY page_id)
SELECT page_id, count(*) FILTER (WHERE depth = base + 1) AS children, count(*) AS descendants, CAST(min(i) FILTER (WHERE depth = base + 1) AS BIGINT) AS first_child
FROM d JOIN b USING (page_id) WHERE i > body AND depth > base AND NOT starts_with(tag, '</') AND regexp_matches(tag, '^<(p|a)[ >]') GROUP BY page_id""")
def nodes_inside(spark, sf_dir):
    tags = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("i", "tag"))
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = tags.withColumn("depth", F.sum(F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1)).over(w))
    body = F.startswith("tag", F.lit("<body"))
    p = Window.partitionBy("page_id")
    d = d.withColumn("body", F.min(F.when(body, F.struct("i", "depth"))).over(p)).where("i > body.i and depth > body.depth")
    d = d.where(F.col("tag").rlike("^<(p|a)[ >]")).withColumn("direct", F.col("depth") == F.col("body.depth") + 1)
    return d.groupBy("page_id").agg(F.count_if("direct").alias("children"), F.count("*").alias("descendants"), F.min(F.when(F.col("direct"), F.col("i") + 1)).cast("long").alias("first_child"))


@_query("""WITH u AS (SELECT doc_id, 0 AS ord, 'labels' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1, 'documents' FROM documents UNION ALL SELECT doc_id, 2, 'labels' FROM labels)
SELECT doc_id, ord, origin FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1""")
def union_first_wins(spark, sf_dir):
    labels, docs = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").select("doc_id")
    named = lambda df, k, name: df.select("doc_id", F.lit(k).alias("ord"), F.lit(name).alias("origin"))
    u = named(labels.where("toxic = 1"), 0, "labels").unionByName(named(docs, 1, "documents")).unionByName(named(labels, 2, "labels"))
    return lookup.first_per_key(u, ["doc_id"], F.struct("ord", "origin"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT 's1' AS node UNION SELECT b.dst FROM r JOIN b ON b.src = r.node)
SELECT node FROM r""")
def whole_closure(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return bounded_closure(both, spark.createDataFrame([("s1",)], "node string"), 1000).select("node")


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders), s AS (SELECT o_custkey, sum(floor(o_totalprice)) AS total, count(*) AS n FROM r WHERE rank <= 5 GROUP BY o_custkey)
SELECT c_custkey, coalesce(nullif(CAST(floor(total / n) AS BIGINT), 0), CAST(floor(c_acctbal) AS BIGINT)) AS mean FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def mean_or_estimate(spark, sf_dir):
    top = lookup.top_per_key(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5)
    s = top.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("total"), F.count("*").alias("n"))
    j = _t(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce(F.nullif(F.floor(F.try_divide("total", "n")).cast("long"), F.lit(0)), F.floor("c_acctbal").cast("long")).alias("mean"))


@_query(f"""WITH {_EVENTS}, s AS (SELECT count(*) AS slices, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(sliced_tokens) AS BIGINT) AS sliced_tokens FROM ev)
SELECT *, greatest(raw_tokens - sliced_tokens, 0) AS saved_tokens, {_PCT.format('raw_tokens', 'sliced_tokens')} AS savings_pct FROM s""")
def diff_totals(spark, sf_dir):
    return rollup.diff_totals(_telemetry(spark, sf_dir))


@_query(f"""WITH {_EVENTS}, l AS (SELECT upper(left(language, 1)) || substr(language, 2) AS language, sum(saved_tokens) AS saved FROM ev GROUP BY 1),
s AS (SELECT coalesce(source, 'unknown') AS source, sum(saved_tokens) AS saved FROM ev GROUP BY 1)
SELECT (SELECT count(*) FROM ev) AS requests, (SELECT string_agg(language, ',' ORDER BY saved DESC, language) FROM l) AS languages, (SELECT string_agg(source, ',' ORDER BY saved DESC, source) FROM s) AS sources""")
def telemetry_summary(spark, sf_dir):
    e = _telemetry(spark, sf_dir).withColumns({"timestamp": F.col("event_id").cast("string"), "file_path": F.lit("f"), "symbol": F.lit("s")})
    names = lambda c, k: F.array_join(F.transform(c, lambda x: x[k]), ",")
    return rollup.summary(e).select("requests", names("by_language", "language").alias("languages"), names("by_source", "source").alias("sources"))


@_query("""SELECT event_id, substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 16) AS shown FROM events ORDER BY event_id DESC LIMIT 5""")
def last_five(spark, sf_dir):
    e = rollup.recent(_t(spark, sf_dir, "events"), 5, "event_id")
    return e.select("event_id", show.short_time(show.rfc3339(F.col("ts"))).alias("shown"))


@_query(f"""WITH {_DOC_STATS}, g AS (SELECT language, count(*) AS n, sum(raw_tokens) AS t FROM stats GROUP BY language)
SELECT (SELECT count(*) FROM stats) AS files, CAST((SELECT sum(n) FROM g) AS BIGINT) AS files_by_language, CAST((SELECT sum(raw_tokens) FROM stats) AS BIGINT) AS tokens, CAST((SELECT sum(t) FROM g) AS BIGINT) AS tokens_by_language""")
def breakdown_adds_up(spark, sf_dir):
    s = _doc_stats(spark, sf_dir)
    by = rollup.language_stats(s).agg(F.sum("files").alias("files_by_language"), F.sum("raw_tokens").alias("tokens_by_language")).withColumn("k", F.lit(1))
    whole = s.agg(F.count("*").alias("files"), F.sum("raw_tokens").alias("tokens")).withColumn("k", F.lit(1))
    return whole.join(by, "k").drop("k")


@_query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\p{Lu}\p{L}+'))) AS name FROM documents),
own AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(string_split(text, chr(10))[1], '\p{Lu}\p{L}+'))) AS name FROM documents)
SELECT doc_id, count(*) AS names FROM w WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = w.doc_id AND own.name = w.name) GROUP BY doc_id""")
def names_but_own(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))
    rest = F.array_except(names(F.col("text")), names(F.element_at(F.split("text", "\n"), 1)))
    return d.select("doc_id", F.size(rest).cast("long").alias("names")).where("names > 0")


@_query(f"""WITH d AS (SELECT doc_id, text, lang, source, {_LINES.format('text')} AS raw_lines FROM documents)
SELECT doc_id, md5('# ' || source || ':' || doc_id || chr(10) || 'lines 3 of ' || raw_lines || ', tokens 4 of 5, saved 20.0%' || chr(10, 10) || '## Symbol' || chr(10) || '```' || lang || chr(10)
  || CASE WHEN trim(lang) <> '' AND NOT contains(text, trim(lang)) THEN trim(lang) || chr(10) ELSE '' END || trim(text) || chr(10) || '```'
  || chr(10, 10) || '## Types' || chr(10) || '```' || lang || chr(10) || 'type A' || chr(10, 10) || source || chr(10) || '```' || chr(10, 10) || '## Calls' || chr(10) || '_none_' || chr(10)) AS digest FROM d""".replace("chr(10, 10)", "chr(10) || chr(10)"))
def slice_documents(spark, sf_dir):
    kind = "array<struct<level:int,name:string,kind:string,target:string,body:string>>"
    one = lambda name, body: F.struct(F.lit(0).alias("level"), name.alias("name"), F.lit("type").alias("kind"), F.lit("t").alias("target"), body.alias("body"))
    types = F.array(one(F.lit("A"), F.lit(" type A ")), one(F.lit("B"), F.col("source")), one(F.lit("A"), F.lit("again"))).cast(kind)
    d = _t(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("path"), F.col("doc_id").cast("string").alias("symbol"), F.col("lang").alias("language"), F.col("lang").alias("doc"), F.col("text").alias("body"), types.alias("types"),
        F.expr("cast(array() as array<struct<call_ord:bigint,receiver:string,name:string,signature:string>>)").alias("calls"), T.count_lines(F.col("text")).alias("raw_lines"),
        F.lit(3).alias("sliced_lines"), F.lit(4).alias("sliced_tokens"), F.lit(5).alias("raw_tokens"), F.lit(20.0).alias("savings_pct"),
    )
    return d.select("doc_id", F.md5(render.slice_markdown().cast("binary")).alias("digest"))


def _turns(spark, sf_dir):
    """Each turn's text with the one before it."""
    c = _t(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).where("before is not null")


def diff_of(before: str, after: str) -> str:
    return "\n".join(difflib.unified_diff(before.split("\n"), after.split("\n"), "a", "b", lineterm="", n=3))


@_query()
def unified_diff(spark, sf_dir):
    """SQL has no such function; a test holds it against the standard library's."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "diff": [diff_of(a, b) for a, b in zip(pdf["before"], pdf["after"])]})

    return _turns(spark, sf_dir).mapInPandas(run, "conv_id long, turn long, diff string")


def splice(text: str, begin: int, end: int, to: str) -> str:
    """``text`` with the bytes from ``begin`` to ``end`` replaced; offsets inside a character move to its ends."""
    raw = text.encode()
    whole = lambda k: max(0, min(len(raw), k))
    a, b = whole(begin), whole(end)
    while 0 < a < len(raw) and raw[a] & 0xC0 == 0x80:
        a -= 1
    while 0 < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return (raw[:a] + to.encode() + raw[max(a, b) :]).decode()


@_query()
def patch_splice(spark, sf_dir):
    """Bytes 5 to 15 of each turn replaced by its number; a test holds it against plain slicing."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "text": [splice(t or "", 5, 15, str(n)) for n, t in zip(pdf["turn"], pdf["after"])]})

    return _turns(spark, sf_dir).mapInPandas(run, "conv_id long, turn long, text string")


@_query()
def bpe_token_counts(spark, sf_dir):
    """Tokens by byte pair encoding beside pre-tokens; a test holds the counts against the tokenizer's own."""
    import public_tokenizers

    from quarrylake.functions.tokens import counter

    count = counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _t(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"), T.count_tokens(F.col("text")).alias("pre_tokens"))
