"""Lookups whose answer is the first match in a stated order, and joins on ranges, order and likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order``, which must be a total order. Nulls are a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The same by aggregation: partial results are combined before the shuffle, so hot keys don't hurt.

    ``order`` is a comparable column, unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their number in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points within [low, high] (inclusive, in whole units): an equi-join on buckets of ``width`` units.

    An interval is repeated for each bucket that it touches, a point goes to one.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    i = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, "_bucket").where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def interval_sums(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Intervals that hold points with their number ``n`` and the sum of their places ``total``.

    Points are counted by place and equal intervals joined once, so the pairs are at most the distinct
    intervals times the places in one, however many points there are.
    """
    places = points.groupBy(at).agg(F.count("*").alias("_n"))
    hits = interval_join(places, intervals.select(low, high).distinct(), at, low, high, width)
    return intervals.join(hits.groupBy(low, high).agg(F.sum("_n").alias("n"), F.sum(F.col(at) * F.col("_n")).alias("total")), [low, high])


def next_after(df: DataFrame, key: str, order: list[str], is_target: Column, value: str) -> Column:
    """Forward as-of: the next target row's ``value`` after each row, within the key.

    In descending order the frame only grows, so a key's rows are passed once.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(is_target, F.col(value)), ignorenulls=True).over(w)


def carried(key: str, order: list[str], value: Column) -> Column:
    """The last non-null ``value`` up to and including each row, within the key."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def ancestors(path: Column) -> Column:
    """All proper and improper prefixes of a path, the shortest first."""
    pieces = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), "/"))


def longest_ancestor(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the longest of ``roots`` that is one of its ancestors (null if none)."""
    tried = paths.select(path).distinct().withColumn(root, F.explode(ancestors(F.col(path))))
    best = tried.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.join(best, path, "left")


def alike(name: Column, query: Column, distance: int = 2) -> tuple[Column, Column]:
    """Whether a name is like a query, and how: 0 equal, 1 one a prefix of the other, 2 few edits apart."""
    q, n = F.lower(query), F.lower(name)
    like = (q == n) | n.startswith(q) | q.startswith(n) | F.levenshtein(q, n, distance).between(0, distance)
    return like, F.when(q == n, 0).when(n.startswith(q) | q.startswith(n), 1).otherwise(2)


#: Queries up to which each name is compared with all of them.
FEW_QUERIES = 1000


def suggest(names: DataFrame, queries: DataFrame, name: str, query: str, distance: int = 2, few: int = FEW_QUERIES) -> DataFrame:
    """Candidates for each query: equal, one a prefix of the other, or few edits apart.

    A user's misspelt symbols, up to ``few``, are sent to all names. More are joined with them by keys that
    a pair must share: a whole string that is the other's prefix, or what is left of both when at most
    ``distance`` characters are taken out.
    """
    like, tier = alike(F.col(name), F.col(query), distance)
    if queries.limit(few + 1).count() <= few:
        return names.join(F.broadcast(queries), like).withColumn("tier", tier)
    keyed = lambda df, c, whole, prefix: df.select(F.col(c).alias(f"_{c}")).where(F.col(c).isNotNull()).distinct().select(f"_{c}", F.explode(_keys(F.lower(f"_{c}"), distance, whole, prefix)).alias("_key"))
    pairs = keyed(names, name, "n", "q").join(keyed(queries, query, "q", "n"), "_key").select(f"_{name}", f"_{query}").distinct()
    out = names.join(pairs, names[name] == pairs[f"_{name}"]).join(queries, F.col(f"_{query}") == queries[query]).drop(f"_{name}", f"_{query}")
    return out.where(like).withColumn("tier", tier)


def _keys(text: Column, distance: int, whole: str, prefix: str) -> Column:
    """Keys of one side: what is left of the string without up to ``distance`` characters; the string, marked
    ``whole``; and its prefixes, marked ``prefix``, which meet the other side's whole strings."""
    left = F.array(text)
    out = F.transform(left, lambda t: F.concat(F.lit("d"), t))
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))
    for _ in range(distance):
        left = F.array_distinct(F.flatten(F.transform(left, without)))
        out = F.concat(out, F.transform(left, lambda t: F.concat(F.lit("d"), t)))
    prefixes = F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.concat(F.lit(prefix), text.substr(F.lit(1), i)))
    return F.array_distinct(F.concat(out, F.array(F.concat(F.lit(whole), text)), prefixes))
