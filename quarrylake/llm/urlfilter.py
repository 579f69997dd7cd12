"""URL filters: a trie over reversed host labels, then path segments, with longest match.

Hosts and paths are cut by JVM expressions; the trie is walked in Arrow batches. It is broadcast only
while the rules are few enough; larger rule sets are joined with the urls' own host suffixes and path
prefixes, which gives the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules and their characters up to which the trie is broadcast.
#: (some kilobyte a rule in every worker).
TRIE_RULES = 50_000
TRIE_CHARS = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(
        url.isNotNull() & (at > 0), url.substr(at + 3, F.length(url))
    ).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


class Trie:
    """Rules by reversed host labels, then whole path segments, then what begins the next segment."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            # The empty tuple can't be a label: under it hang the host's path rules.
            node = node.setdefault((), {})
            *whole, part = path.split("/") if path else [None]
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault((), {})
            # Between equal rules with both verdicts, block holds.
            if ends.get(part, ("allow",))[0] != "block":
                ends[part] = (verdict, host + path)

    def find(self, host: str, path: str):
        """(verdict, rule) of the longest fitting rule, of equally long ones that with most host labels; None if none fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if () in node:
                found = self._path(node[()], segments)
                if found and (best is None or len(found[1]) >= len(best[1])):
                    best = found
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]):
        best = node.get((), {}).get(None)
        for k, segment in enumerate(segments):
            ends = node.get(())
            if ends:
                fit = [p for p in (segment[:j] for j in range(len(segment), -1, -1)) if p in ends] if len(ends) > len(segment) else sorted((p for p in ends if p is not None and segment.startswith(p)), key=len, reverse=True)
                if fit:
                    best = ends[fit[0]]
            node = node.get(segment)
            if node is None:
                break
        return best


def _by_trie(urls: DataFrame, rules: DataFrame) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(sorted((r["verdict"], r["host"], r["path"]) for r in rules.collect())))

    @F.pandas_udf("struct<verdict:string,rule:string>")
    def find(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        walk = trie.value.find
        return pd.DataFrame([walk(h, p) or (None, None) for h, p in zip(host, path)], columns=["verdict", "rule"])

    return urls.withColumn("found", find("host", "path"))


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for any number of rules: join on (host, whole segments), keep those whose rest fits."""
    cut = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^((?s:.*)/)", 1)).otherwise(F.lit(""))
    keyed = (
        rules.withColumn("whole", cut)
        .withColumn("part", F.expr("substring(path, length(whole) + 1)"))
        .groupBy("host", "whole", "part")
        .agg(F.max("verdict").alias("verdict"))
    )
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/"))))
    tried = distinct.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    k = keyed.select(F.col("host").alias("suffix"), F.col("whole").alias("prefix"), "part", "verdict")
    hits = tried.join(k, ["suffix", "prefix"]).where(F.col("path").startswith(F.concat("prefix", "part")))
    rule = F.concat("suffix", "prefix", "part")
    rank = F.struct(F.length(rule), F.size(F.split("suffix", r"\.")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", rule.alias("rule")), rank).alias("found"))
    return urls.join(best, ["host", "path"], "left")


def url_filter(
    pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", trie_rules: int = TRIE_RULES
) -> DataFrame:
    """Judge every url by the longest fitting rule: page_id, host, path, rule, verdict.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and all subdomains of
    it if the url's path starts with the rule's. Among fitting rules the longest wins, host and path taken
    together; of equally long ones that with more host labels; of two equal rules with both verdicts,
    block. A very long url is judged whole. An empty table gives no rows. Urls without a fitting rule get rule
    null and the verdict ``default``. A null url or one without ``://`` has an empty host and path.
    Ids are passed through, null or repeated; other columns aren't read; rules with a null are void.
    """
    rules = rules.select("verdict", "host", "path").where("verdict is not null and host is not null and path is not null").distinct()
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    judged = _by_trie(urls, rules) if n <= trie_rules and chars <= TRIE_CHARS else _by_join(urls, rules)
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
