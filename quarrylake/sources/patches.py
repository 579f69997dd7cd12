"""Unified diffs as a table of changed lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions.text import hunk_range


def changed_lines(lines: DataFrame) -> DataFrame:
    """(file, line) of new lines in a diff given as (patch, line_no, text); patches are independent.

    The file header carries forward to later hunks; a pure deletion marks the line that it follows.
    """
    w = Window.partitionBy("patch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.*)$", 1)
    current = F.last(F.when(F.startswith("text", F.lit("+++ ")), name), ignorenulls=True).over(w)
    hunks = lines.withColumn("file", current).where(F.startswith("text", F.lit("@@")) & F.col("file").isNotNull() & (F.col("file") != "/dev/null"))
    start, count = hunk_range(F.col("text"))
    return hunks.withColumn("start", start).withColumn("count", count).where("start IS NOT NULL").select("file", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line")).distinct()


def git_diff(spark: SparkSession, folder: str, staged: bool = False) -> DataFrame:
    """(patch, line_no, text) of ``git diff -U0`` in a folder; one patch per file of the diff."""
    out = subprocess.run(["git", "-C", folder, "diff", *["--staged"] * staged, "-U0", "--no-color"], capture_output=True, text=True, check=True).stdout
    rows, patch = [], 0
    for number, text in enumerate(out.split("\n")):
        patch += text.startswith("diff --git ")
        rows.append((patch, number, text))
    return spark.createDataFrame(rows, "patch long, line_no long, text string")
