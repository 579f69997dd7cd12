"""Scalar functions on stated values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,sliced,expected", [(1000, 150, 85.0), (0, 50, 0.0), (10, 50, 0.0), (3000, 500, 83.33)])
def test_savings(spark, raw, sliced, expected):
    assert one(spark, T.savings_percentage(F.lit(raw), F.lit(sliced))) == expected


@pytest.mark.parametrize("tokens,language,expected", [(0, "typescript", 0), (20, "typescript", 20), (100, "typescript", 65), (500, "typescript", 123), (1000, "typescript", 168), (100, "rust", 69), (100000, "rust", 1916), (3000, "python", 272), (1000, "go", 171)])
def test_estimate(spark, tokens, language, expected):
    assert one(spark, T.estimate_sliced(F.lit(tokens), T.language_weight(F.lit(language)))) == expected


@pytest.mark.parametrize("text,expected", [(None, 0), ("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("\n", 1), ("a\nb", 2)])
def test_lines(spark, text, expected):
    assert one(spark, T.count_lines(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("data,expected", [(b"\x89PNG\x00\x00\x01", True), (b"a" * 1020 + "é".encode()[:1], False), (b"ok \xff no", True), ("naïve".encode(), False), (b"", False), (b"a" * 1023 + "\U0001f600".encode()[:1], False)])
def test_binary(spark, data, expected):
    assert one(spark, T.is_binary(F.lit(data))) is expected


@pytest.mark.parametrize("path,expected", [("a/./b/../c", "a/c"), ("/x/../../y", "/y"), ("a//b", "a/b")])
def test_paths(spark, path, expected):
    assert one(spark, T.normalise_path(F.lit(path))) == expected


def test_hunks(spark):
    for header, expected in (("@@ -1,2 +10,3 @@ f", (10, 3)), ("@@ -1 +4 @@", (4, 1)), ("@@ -3,2 +7,0 @@", (7, 1))):
        start, count = T.hunk_range(F.lit(header))
        assert (one(spark, start), one(spark, count)) == expected


def test_display_language(spark):
    assert [one(spark, T.display_language(F.lit(x).cast("string"))) for x in ("ts", "PY", "rust", "kotlin", None)] == ["TypeScript", "Python", "Rust", "Kotlin", "Unknown"]
