"""Fitting a rendering to a token budget: candidates from full to barest, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T


def candidates(text: Column) -> list[tuple[str, Column]]:
    """Levels of reduction of a body, from all of it to its first line."""
    bare = T.strip_comment_lines(text)
    return [("full", text), ("no_comments", bare), ("folded", T.fold_body(bare)), ("signature", T.first_line(bare))]


def fit(df: DataFrame, text: str, budget: int) -> DataFrame:
    """Adds level, reduced, reduced_tokens and fits. The last level is taken even if it doesn't fit.

    Levels are tried in turn by nested conditions, so a row's later ones are neither made nor counted.
    """
    levels = candidates(F.col(text))
    made = lambda name, c: F.struct(F.lit(name).alias("level"), c.alias("reduced"), T.count_tokens(c).alias("reduced_tokens"))
    pick = made(*levels[-1])
    for name, c in reversed(levels[:-1]):
        pick = F.when(T.count_tokens(c) <= budget, made(name, c)).otherwise(pick)
    out = df.withColumn("_pick", pick)
    return out.select(*df.columns, "_pick.level", "_pick.reduced", "_pick.reduced_tokens", (F.col("_pick.reduced_tokens") <= budget).alias("fits"))
