"""Roll-ups of telemetry and of file statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T


def file_stats(files: DataFrame, text: str, language: str, *keep: str) -> DataFrame:
    """Per file: lines, raw and estimated sliced tokens, saved tokens and their percentage."""
    raw = T.count_tokens(F.col(text))
    lang = F.coalesce(F.col(language), F.lit("other"))
    out = files.select(*keep, lang.alias("language"), T.count_lines(F.col(text)).alias("lines"), raw.alias("raw_tokens"))
    out = out.withColumn("sliced_tokens", T.estimate_sliced(F.col("raw_tokens"), T.language_weight(F.col("language"))))
    return out.withColumn("saved_tokens", T.saturating_sub(F.col("raw_tokens"), F.col("sliced_tokens"))).withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens")))


def language_stats(stats: DataFrame) -> DataFrame:
    """By language: files, lines, tokens and the percentage saved of the sums, largest first."""
    out = stats.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("sliced_tokens").alias("sliced_tokens"))
    return out.withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens"))).orderBy(F.desc("raw_tokens"), "language")


def totals(events: DataFrame) -> DataFrame:
    """Lifetime totals with the saved tokens' worth by price tier."""
    out = events.agg(F.count("*").alias("requests"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("sliced_tokens"), F.lit(0)).alias("sliced_tokens"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    out = out.withColumn("compression", F.when(F.col("raw_tokens") > 0, T.round2(F.col("saved_tokens").cast("double") / F.col("raw_tokens") * 100)).otherwise(F.lit(0.0)))
    for tier, price in T.PRICES.items():
        out = out.withColumn(f"cost_{tier}", T.cost(F.col("saved_tokens"), price))
    return out


def by_language(events: DataFrame) -> DataFrame:
    """By display language: the percentage is a ratio of sums."""
    out = events.groupBy(T.display_language(F.col("language")).alias("language")).agg(F.count("*").alias("requests"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("sliced_tokens").alias("sliced_tokens"), F.sum("saved_tokens").alias("saved_tokens"))
    pct = F.when(F.col("raw_tokens") > 0, T.round2(F.col("saved_tokens").cast("double") / F.col("raw_tokens") * 100)).otherwise(F.lit(0.0))
    return out.withColumn("savings_pct", pct).withColumn("cost_standard", T.cost(F.col("saved_tokens"), T.PRICES["standard"])).orderBy(F.desc("saved_tokens"), "language")


def by_source(events: DataFrame) -> DataFrame:
    """By source: the percentage is the mean of the events' own."""
    out = events.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("requests"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("savings_percentage").alias("s"))
    return out.withColumn("savings_pct", T.round2(F.col("s") / F.col("requests"))).drop("s").orderBy(F.desc("saved_tokens"), "source")


def grouped(events: DataFrame) -> DataFrame:
    """Totals, by language and by source in one pass over the events (grouping sets)."""
    e = events.select(T.display_language(F.col("language")).alias("language"), F.coalesce("source", F.lit("unknown")).alias("source"), "saved_tokens")
    return e.groupingSets([[], ["language"], ["source"]], "language", "source").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("requests"), F.sum("saved_tokens").alias("saved_tokens"))


def recent(events: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """The last ``n`` events in the order of the log, the latest first; by time where the log has no ordinal."""
    return events.orderBy(*([F.desc(order)] if order else [F.desc("timestamp"), F.desc("file_path"), F.desc("symbol")])).limit(n)


def summary(events: DataFrame) -> DataFrame:
    """Totals in one row with lists: languages, sources (both by tokens saved) and the ten latest events."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    listed = lambda df, k, name: one(df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*k, F.struct(*df.columns).alias("row")))), lambda x: x["row"]).alias(name)))
    languages = listed(by_language(events), [(-F.col("saved_tokens")).alias("k"), F.col("language").alias("k2")], "by_language")
    sources = listed(by_source(events), [(-F.col("saved_tokens")).alias("k"), F.col("source").alias("k2")], "by_source")
    latest = one(recent(events).agg(F.reverse(F.array_sort(F.collect_list(F.struct("timestamp", "file_path", "symbol", "raw_tokens", "sliced_tokens", "saved_tokens")))).alias("recent")))
    return one(totals(events)).join(languages, "_one").join(sources, "_one").join(latest, "_one").drop("_one")


def diff_totals(sliced: DataFrame) -> DataFrame:
    """Sums over slices; what is saved is the difference of the sums, never below 0, and so is its share."""
    out = sliced.agg(F.count("*").alias("slices"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("sliced_tokens"), F.lit(0)).alias("sliced_tokens"))
    return out.withColumn("saved_tokens", T.saturating_sub(F.col("raw_tokens"), F.col("sliced_tokens"))).withColumn("savings_pct", T.savings_percentage(F.col("raw_tokens"), F.col("sliced_tokens")))
