"""The catalogue of queries over the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import budget, lookup, rollup
from quarrylake.operators.closure import bounded_closure
from quarrylake.operators.settle import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The pieces of SQL that several oracles share.
_TOKENS = r"len(regexp_extract_all({0}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+'))"
_LINES = r"(CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE greatest(len(string_split({0}, chr(10))) - CASE WHEN ends_with({0}, chr(10)) THEN 1 ELSE 0 END, 1) END)"
_ESTIMATE = "(CASE WHEN {0} <= 20 THEN {0} ELSE CAST(greatest(15, least({0}, round((3.2e0 * pow({0}, 0.55e0) + 25) * {1}))) AS BIGINT) END)"
_PCT = "(CASE WHEN {0} <= 0 THEN 0e0 ELSE round(greatest(0e0, (1 - CAST({1} AS DOUBLE) / {0}) * 100) * 100) / 100 END)"
_DOC_STATS = f"""docs AS (
  SELECT doc_id, coalesce(lang, 'other') AS language, source, {_LINES.format('text')} AS lines, {_TOKENS.format('text')} AS raw_tokens FROM documents
), stats AS (SELECT *, {_ESTIMATE.format('raw_tokens', '1e0')} AS sliced_tokens FROM docs)"""


def _doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.file_stats(_t(spark, sf_dir, "documents"), "text", "lang", "doc_id", "source")


@_query(f"""WITH {_DOC_STATS}
SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(sliced_tokens) AS BIGINT) AS sliced_tokens,
       {_PCT.format('sum(raw_tokens)', 'sum(sliced_tokens)')} AS savings_pct FROM stats GROUP BY language""")
def token_stats_by_lang(spark, sf_dir):
    return rollup.language_stats(_doc_stats(spark, sf_dir))


@_query(f"""WITH {_DOC_STATS}
SELECT language, source, count(*) AS files, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(lines) AS BIGINT) AS lines FROM stats GROUP BY ROLLUP (language, source)""")
def token_stats_rollup(spark, sf_dir):
    return _doc_stats(spark, sf_dir).rollup("language", "source").agg(F.count("*").alias("files"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("lines").alias("lines"))


@_query(f"""WITH {_DOC_STATS} SELECT doc_id, language, raw_tokens, sliced_tokens FROM stats ORDER BY raw_tokens DESC, doc_id LIMIT 10""")
def file_stats_top10(spark, sf_dir):
    return _doc_stats(spark, sf_dir).orderBy(F.desc("raw_tokens"), "doc_id").limit(10).select("doc_id", "language", "raw_tokens", "sliced_tokens")


@_query(f"SELECT page_id, {_TOKENS.format('html')} AS raw_tokens, {_LINES.format('html')} AS lines FROM pages")
def html_token_stats(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.count_tokens(F.col("html")).alias("raw_tokens"), T.count_lines(F.col("html")).alias("lines"))


@_query(f"""SELECT 'document' AS kind, doc_id AS id, {_LINES.format('text')} AS lines FROM documents
UNION ALL SELECT 'turn', conv_id * 1000 + turn, {_LINES.format('text')} FROM conversations""")
def line_counts(spark, sf_dir):
    lines = T.count_lines(F.col("text")).alias("lines")
    turns = _t(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), lines)
    return _t(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), lines).unionByName(turns)


@_query(f"""WITH w(lang, weight) AS (VALUES ('en', 1e0), ('de', 1.05e0), ('fr', 1.02e0), ('es', 0.95e0)),
t AS (SELECT doc_id, coalesce(weight, 1e0) AS weight, {_TOKENS.format('text')} AS raw_tokens FROM documents LEFT JOIN w USING (lang))
SELECT doc_id, raw_tokens, {_ESTIMATE.format('raw_tokens', 'weight')} AS sliced_tokens FROM t""")
def estimate_sliced(spark, sf_dir):
    weights = spark.createDataFrame([("en", 1.0), ("de", 1.05), ("fr", 1.02), ("es", 0.95)], "lang string, weight double")
    d = _t(spark, sf_dir, "documents").join(F.broadcast(weights), "lang", "left").select("doc_id", T.count_tokens(F.col("text")).alias("raw_tokens"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return d.select("doc_id", "raw_tokens", T.estimate_sliced(F.col("raw_tokens"), F.col("weight")).alias("sliced_tokens"))


@_query(f"""SELECT d.doc_id, greatest(n_chars - 500 * (1 + coalesce(quality, 0)), 0) AS saved, {_PCT.format('n_chars', '(500 * (1 + coalesce(quality, 0)))')} AS savings_pct
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def savings_pct(spark, sf_dir):
    sliced = 500 * (1 + F.coalesce("quality", F.lit(0)))
    j = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", T.saturating_sub(F.col("n_chars"), sliced).cast("long").alias("saved"), T.savings_percentage(F.col("n_chars"), sliced).alias("savings_pct"))


_EVENTS = """e AS (
  SELECT event_id, event_type AS language, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'user' || (user_id % 7) END AS source,
         CAST(floor(abs(value) * 100) AS BIGINT) AS raw_tokens, CAST(floor(abs(value) * 100) AS BIGINT) // 4 AS sliced_tokens FROM events
), ev AS (SELECT *, raw_tokens - sliced_tokens AS saved_tokens, """ + _PCT.format("raw_tokens", "sliced_tokens") + " AS savings_percentage FROM e)"
_DISPLAY = "upper(left(language, 1)) || substr(language, 2)"


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.floor(F.abs("value") * 100).cast("long")
    e = _t(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("language"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string"))).alias("source"), raw.alias("raw_tokens"), F.floor(raw / 4).cast("long").alias("sliced_tokens")
    )
    return e.withColumn("saved_tokens", T.saturating_sub(F.col("raw_tokens"), F.col("sliced_tokens"))).withColumn("savings_percentage", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens")))


@_query(f"""WITH {_EVENTS}, s AS (SELECT count(*) AS requests, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(sliced_tokens) AS BIGINT) AS sliced_tokens, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM ev)
SELECT *, round(CAST(saved_tokens AS DOUBLE) / raw_tokens * 100 * 100) / 100 AS compression, round(CAST(saved_tokens AS DOUBLE) / 1e6 * 0.5e0 * 100) / 100 AS cost_economy,
       round(CAST(saved_tokens AS DOUBLE) / 1e6 * 3e0 * 100) / 100 AS cost_standard, round(CAST(saved_tokens AS DOUBLE) / 1e6 * 15e0 * 100) / 100 AS cost_frontier FROM s""")
def telemetry_totals(spark, sf_dir):
    return rollup.totals(_telemetry(spark, sf_dir))


@_query(f"""WITH {_EVENTS}, s AS (SELECT {_DISPLAY} AS language, count(*) AS requests, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(sliced_tokens) AS BIGINT) AS sliced_tokens, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM ev GROUP BY 1)
SELECT *, round(CAST(saved_tokens AS DOUBLE) / raw_tokens * 100 * 100) / 100 AS savings_pct, round(CAST(saved_tokens AS DOUBLE) / 1e6 * 3e0 * 100) / 100 AS cost_standard FROM s""")
def telemetry_by_language(spark, sf_dir):
    return rollup.by_language(_telemetry(spark, sf_dir))


@_query(f"""WITH {_EVENTS} SELECT coalesce(source, 'unknown') AS source, count(*) AS requests, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens, round(sum(savings_percentage) / count(*) * 100) / 100 AS savings_pct FROM ev GROUP BY 1""")
def telemetry_by_source(spark, sf_dir):
    return rollup.by_source(_telemetry(spark, sf_dir))


@_query(f"""WITH {_EVENTS}, s AS (SELECT {_DISPLAY} AS language, coalesce(source, 'unknown') AS source, saved_tokens FROM ev)
SELECT language, source, CAST(grouping(language) * 2 + grouping(source) AS INTEGER) AS level, count(*) AS requests, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM s GROUP BY GROUPING SETS ((), (language), (source))""")
def telemetry_grouping_sets(spark, sf_dir):
    return rollup.grouped(_telemetry(spark, sf_dir))


@_query(f"""WITH {_EVENTS}, s AS (SELECT {_DISPLAY} AS language, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM ev GROUP BY 1)
SELECT string_agg(language || '=' || saved, ';' ORDER BY language) AS saved_by_language FROM s""")
def telemetry_map(spark, sf_dir):
    s = _telemetry(spark, sf_dir).groupBy(T.display_language(F.col("language")).alias("language")).agg(F.sum("saved_tokens").alias("saved"))
    entries = F.array_sort(F.collect_list(F.struct("language", "saved")))
    return s.agg(F.array_join(F.transform(entries, lambda x: F.concat(x["language"], F.lit("="), x["saved"].cast("string"))), ";").alias("saved_by_language"))


@_query("SELECT event_id, user_id, event_type, replace(substr(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 1, 16), 'T', ' ') AS shown FROM events ORDER BY event_id DESC LIMIT 10")
def recent_events(spark, sf_dir):
    shown = F.translate(F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), 1, 16), "T", " ")
    return _t(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(10).select("event_id", "user_id", "event_type", shown.alias("shown"))


@_query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@_query("SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN 'Unknown' ELSE upper(left(lang, 1)) || substr(lang, 2) END AS shown FROM documents")
def lang_normalise(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.display_language(F.col("lang")).alias("shown"))


@_query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[^:]*://', ''), '/') AS parts, url FROM pages)
SELECT page_id, list_has_any(parts[1:len(parts) - 1], ['de', 'es']) AS in_ignored_dir, ends_with(url, '.html') AS is_html, starts_with(url, 'https://www.') AS is_www FROM p""")
def path_filters(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", "^[^:]*://", ""), "/")
    ignored = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit("de"), F.lit("es")))
    return _t(spark, sf_dir, "pages").select("page_id", ignored.alias("in_ignored_dir"), F.endswith("url", F.lit(".html")).alias("is_html"), F.startswith("url", F.lit("https://www.")).alias("is_www"))


@_query("SELECT page_id, length(html) AS n FROM pages WHERE length(html) <= 5000")
def size_filter(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n")).where("n <= 5000")


@_query("SELECT doc_id, contains(left(text, 1024), chr(0)) AS is_binary FROM documents")
def binary_sniff(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.is_binary(F.substring(F.col("text").cast("binary"), 1, 1024)).alias("is_binary"))


_STOP = ["the", "and", "of", "to", "is", "in", "der", "die", "und", "de", "la", "que", "et", "el"]


@_query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents)
SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM w WHERE word NOT IN ({', '.join(repr(x) for x in _STOP)}) GROUP BY word HAVING count(DISTINCT doc_id) > 5""")
def builtin_anti_join(spark, sf_dir):
    stop = F.broadcast(spark.createDataFrame([(x,) for x in _STOP], "word string"))
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    # A row whose id no other has is a document: its words are told apart within it, and a task holds sums by word, not by word and document.
    repeated = settle(d.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = d.join(repeated, "doc_id", "left_anti").select(F.col("doc_id").isNotNull().cast("int").alias("known"), words.alias("words"))
    # Its words all count as uses, and the distinct ones as documents.
    halves = F.array(F.struct("words", F.lit(1).alias("uses"), F.lit(0).alias("docs")), F.struct(F.array_distinct("words").alias("words"), F.lit(0).alias("uses"), F.col("known").alias("docs")))
    once = once.select(F.explode(halves).alias("h")).select("h.*").select(F.explode("words").alias("word"), "uses", "docs")
    again = d.join(repeated, "doc_id", "left_semi").select("doc_id", F.explode(words).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("uses"), F.lit(1).alias("docs")).drop("doc_id")
    return once.unionByName(again).join(stop, "word", "left_anti").groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs")).where("docs > 5")


@_query(r"""SELECT page_id, i AS ord, m[i] AS tag FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(h1|h2|a|p)[ >]', 1) AS m FROM pages))""")
def explode_symbols(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|h2|a|p)[ >]"), F.lit(1))).alias("ord", "tag")).select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "tag")


@_query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages""")
def explode_refs(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("ref"))


@_query("""WITH c AS (
  SELECT c.conv_id, c.turn, c.role, 1 AS tier, c.turn AS ord, c.text FROM conversations c WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, role, 2, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, role, tier FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY tier, ord) = 1""")
def first_match_lookup(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    tiers = c.where("role = 'assistant'").withColumn("tier", F.lit(1)).unionByName(c.where("role = 'user'").withColumn("tier", F.lit(2)))
    return lookup.first_match(tiers, ["conv_id"], ["tier", "turn"])


@_query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unlabelled') AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_outer_default(spark, sf_dir):
    j = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_lookup(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_totalprice > 100000")
    c = _t(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@_query("""WITH s AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS low, CAST(floor(s_acctbal) AS BIGINT) + 150 AS high FROM supplier),
c AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS pos FROM customer)
SELECT s_suppkey, count(*) AS customers, CAST(sum(pos) AS BIGINT) AS total FROM s JOIN c ON pos BETWEEN low AND high GROUP BY s_suppkey""")
def interval_join(spark, sf_dir):
    low = F.floor("s_acctbal").cast("long")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + 150).alias("high"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("at"))
    return lookup.interval_sums(c, s, "at", "low", "high", 200).groupBy("s_suppkey").agg(F.sum("n").alias("customers"), F.sum("total").alias("total"))


@_query("""SELECT event_id, next_purchase FROM (
  SELECT event_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events)
WHERE event_type = 'click'""")
def asof_next(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("next_purchase", lookup.next_after(None, "user_id", ["event_id"], F.col("event_type") == "purchase", "event_id"))
    return e.where("event_type = 'click'").select("event_id", "next_purchase")


@_query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') AS path FROM pages),
roots AS (SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') AS root FROM u UNION SELECT DISTINCT regexp_extract(path, '^[^/]*') FROM u)
SELECT page_id, path, (SELECT max_by(root, length(root)) FROM roots WHERE path = root OR starts_with(path, root || '/')) AS root FROM u""")
def ancestor_prefix(spark, sf_dir):
    u = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "").alias("path"))
    roots = u.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("root")).unionByName(u.select(F.regexp_extract("path", "^[^/]*", 0).alias("root")))
    return lookup.longest_ancestor(u, roots, "path", "root").select("page_id", "path", "root")


@_query("""WITH RECURSIVE e AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e
), r AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.node WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bounded_closure_parts(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return bounded_closure(both, spark.createDataFrame([("s1",)], "node string"), 3)


_NAMES = ["smal ring", "red widgets", "blue", "hot gaer"]


@_query(f"""WITH q(query) AS (VALUES {', '.join(f"('{x}')" for x in _NAMES)})
SELECT query, p_partkey, p_name, CASE WHEN lower(query) = lower(p_name) THEN 0 WHEN starts_with(lower(p_name), lower(query)) OR starts_with(lower(query), lower(p_name)) THEN 1 ELSE 2 END AS tier
FROM part, q WHERE lower(query) = lower(p_name) OR starts_with(lower(p_name), lower(query)) OR starts_with(lower(query), lower(p_name)) OR levenshtein(lower(query), lower(p_name)) <= 2""")
def fuzzy_suggest(spark, sf_dir):
    q = spark.createDataFrame([(x,) for x in _NAMES], "query string")
    return lookup.suggest(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), q, "p_name", "query").select("query", "p_partkey", "p_name", "tier")


@_query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "digest", "copies")


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
SELECT o_custkey, count(*) AS n, CAST(floor(sum(floor(o_totalprice)) / count(*)) AS BIGINT) AS average FROM r WHERE rank <= 5 GROUP BY o_custkey""")
def topn_per_group(spark, sf_dir):
    top = lookup.top_per_key(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5)
    return top.groupBy("o_custkey").agg(F.count("*").alias("n"), F.floor(F.sum(F.floor("o_totalprice")) / F.count("*")).cast("long").alias("average"))


@_query(r"""WITH t AS (SELECT page_id, i, m[i] AS tag FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?(div|p|ul|li|body|head)[ >]') AS m FROM pages))),
d AS (SELECT page_id, i, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t)
SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(CASE WHEN depth = 0 THEN i END) AS BIGINT) AS closed_at FROM d GROUP BY page_id""")
def running_depth(spark, sf_dir):
    tags = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?(div|p|ul|li|body|head)[ >]"), F.lit(0))).alias("i", "tag"))
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = tags.withColumn("depth", F.sum(F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1)).over(w))
    return d.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.min(F.when(F.col("depth") == 0, F.col("i") + 1)).cast("long").alias("closed_at"))


@_query(r"""WITH l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
o AS (SELECT doc_id, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
SELECT doc_id, count(*) AS lines, CAST(max(pos) AS BIGINT) AS last_line_at, CAST(sum(pos) AS BIGINT) AS sum_of_starts FROM o GROUP BY doc_id""")
def running_offset(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", (F.length("line") + 1).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return at.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("at").alias("last_line_at"), F.sum("at").alias("sum_of_starts"))


@_query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_length FROM conversations""")
def carry_forward(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", lookup.carried("conv_id", ["turn"], F.when(F.col("role") == "user", F.length("text"))).cast("long").alias("last_user_length"))


_BARE = r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(//|#|/\*|\*)')), chr(10))"
_FOLD = """CASE WHEN len(string_split({0}, chr(10))) > 6 THEN array_to_string(list_concat(string_split({0}, chr(10))[1:2], ['    // ... body collapsed ...'], string_split({0}, chr(10))[-2:]), chr(10)) ELSE {0} END"""


@_query(f"""WITH b AS (SELECT doc_id, text, {_BARE} AS bare FROM documents), c AS (SELECT doc_id, text, bare, {_FOLD.format('bare')} AS folded, trim(string_split(bare, chr(10))[1]) AS sig FROM b),
n AS (SELECT doc_id, {_TOKENS.format('text')} AS t0, {_TOKENS.format('bare')} AS t1, {_TOKENS.format('folded')} AS t2, {_TOKENS.format('sig')} AS t3 FROM c),
p AS (SELECT doc_id, CASE WHEN t0 <= 200 THEN 'full' WHEN t1 <= 200 THEN 'no_comments' WHEN t2 <= 200 THEN 'folded' ELSE 'signature' END AS level, t0, t1, t2, t3 FROM n)
SELECT doc_id, level, CASE level WHEN 'full' THEN t0 WHEN 'no_comments' THEN t1 WHEN 'folded' THEN t2 ELSE t3 END AS reduced_tokens,
       CASE level WHEN 'signature' THEN t3 <= 200 ELSE TRUE END AS fits FROM p""")
def budget_cascade(spark, sf_dir):
    return budget.fit(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", 200).select("doc_id", "level", "reduced_tokens", "fits")


@_query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS digest FROM documents")
def fold_body(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_body(F.col("text")).cast("binary")).alias("digest"))


@_query(r"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS r FROM documents)
SELECT doc_id, md5(CASE WHEN len(r) <= 3 THEN array_to_string(r, ' ') ELSE r[1] || ' /* ' || (len(r) - 2) || ' fields */ ' || r[len(r)] END) AS digest FROM r""")
def minify_def(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.minify_definition(F.col("text")).cast("binary")).alias("digest"))


@_query(f"SELECT doc_id, md5({_BARE}) AS digest FROM documents")
def strip_comments(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_comment_lines(F.col("text")).cast("binary")).alias("digest"))


@_query("SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_listagg(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("nations"))


@_query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").distinct().join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    w = _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


@_query("""WITH s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS BIGINT)) AS start FROM events, range(4) t(k))
SELECT start, count(*) AS n FROM s GROUP BY start""")
def sliding(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
