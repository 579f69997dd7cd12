"""Every catalogue query against its DuckDB oracle, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quarrylake.plans import catalogue_more, catalogue_sources  # noqa: F401
from quarrylake.plans.catalogue import QUERIES, SQL

#: What SQL can't express: each has a test of its own below.
BY_HAND = {"unified_diff", "patch_splice", "bpe_token_counts"}

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


def _cell(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "null"
    if isinstance(v, bool) or not hasattr(v, "__float__") or isinstance(v, str):
        return str(v)
    return f"{float(v):.9g}"


def _rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(map(_cell, r)) for r in df[columns].itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) | BY_HAND


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


#: Lines that begin with a mark as RE2 reads it or don't: letters beyond ASCII end a word, a vertical tab is no white space.
_ODD = ["Laé ist", "Elñ", "Unter", "Un", "Un_", "Die9", "\vThe x", "\t\f\rThe x", "\u00a0The x", "\u2003The", "The\u00a0x", "It\u0301", "xThe", "Dieа", "", " "]
_BODY = "".join(f"row {k}\n" for k in range(4))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A table of texts around such lines, and one of ends of lines."""
    texts = [f"{_BODY}{x}\n{_BODY}{y}\n{_BODY}" for x in _ODD for y in ("The end", "none")]
    texts += [_BODY + x for x in ("\n\n", "\n\r", "\n\r\n", "\n\u0085", "\n\u2028", "a\nThe")] + ["", "\n", "\n\n", None]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def _over(odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{odd}/documents.parquet/*.parquet'")
    return con.sql(SQL[name]).df()


def test_marked_snippets_of_odd_texts(spark, odd):
    ours, theirs = QUERIES["marked_snippets"](spark, odd).toPandas(), _over(odd, "marked_snippets")
    assert _rows(ours) == _rows(theirs)


def test_lines_after_the_first_mark_of_odd_texts(spark, odd):
    ours, theirs = QUERIES["after_first_mark"](spark, odd).toPandas(), _over(odd, "after_first_mark")
    assert _rows(ours) == _rows(theirs)


def test_token_counts_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["tokens"] for r in QUERIES["bpe_token_counts"](spark, str(DATA)).collect()}
    assert got == {k: len(t.encode(v, add_special_tokens=False).ids) for k, v in texts.items()}


def test_diffs_and_splices(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    pairs = {(b["conv_id"], b["turn"]): (a["text"], b["text"]) for a, b in zip(rows, rows[1:]) if a["conv_id"] == b["conv_id"]}
    diffs = {(r["conv_id"], r["turn"]): r["diff"] for r in QUERIES["unified_diff"](spark, str(DATA)).collect()}
    assert diffs == {k: catalogue_more.diff_of(*v) for k, v in pairs.items()}
    for diff, (a, b) in ((diffs[k], pairs[k]) for k in list(pairs)[:200]):
        body = diff.split("\n")[2:] if diff else []
        assert (diff == "") == (a == b) and sum(x.startswith("@@") for x in body) >= (a != b)
    spliced = {(r["conv_id"], r["turn"]): r["text"] for r in QUERIES["patch_splice"](spark, str(DATA)).collect()}
    for k, (_, text) in pairs.items():
        if text.isascii():
            assert spliced[k] == text[:5] + str(k[1]) + text[15:]
        assert spliced[k].encode().decode() == spliced[k]
