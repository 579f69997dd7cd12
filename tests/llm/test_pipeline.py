"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("wor", "tex", "lin", "man", "for") for b in ("d", "ts", "er", "able", "ing", "est")]
    clean = [(k, " ".join(rng.choice(vocabulary) for _ in range(60)), "en", "s", 1) for k in range(200)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    toxic = [(300 + k, f"{clean[k][1]} vile scum rotten vile scum", "en", "s", 1) for k in range(100, 160)]
    planted = [(500, None, "en", "s", 1), (501, "123 !!!", "en", "s", 1), (502, clean[0][1], "en", "s", 1), (503, "leak " + passage, "en", "s", 1)]
    docs = spark.createDataFrame(clean + toxic + planted, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k, *_ in clean] + [(k, 1, 1) for k, *_ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    everything = {k for k, *_ in clean + toxic + planted}
    assert everything - kept["language_id"] == {500, 501}
    assert {k for k, *_ in clean} <= kept["toxicity"] and len(kept["toxicity"] & {k for k, *_ in toxic}) < 5
    assert 502 not in kept["near_duplicates"] and 0 in kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontamination"] == {503}
    assert kept["packing"] == kept["decontamination"]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Awkward rows: repeated ids with different texts, repeated rows, null ids, texts without letters, a very long text."""
    at = tmp_path_factory.mktemp("corpus")
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("wor", "tex", "lin", "man", "for") for b in ("d", "ts", "er", "able", "ing", "est")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(40)
    rows = [(k, text(50), "en", None, None) for k in range(120)]
    rows += [(5, "!!! 123", "en", "s", 1), (5, None, "en", "s", 1), (None, None, None, None, None), (6, "", "en", "s", 0)]
    rows += [rows[7], rows[7], (None, rows[8][1], "en", "s", 1), (None, rows[8][1], "en", "s", 1), (9, rows[10][1], "en", "s", 1)]
    rows += [(None, "lost " + passage, "en", "s", 1), (11, passage, "en", "s", 1), (300, text(30000), "en", "s", 1), (None, text(20), "en", "s", 1)]
    rows += [(400 + k, f"{text(30)} vile scum rotten vile scum", "en", "s", 1) for k in range(60)] + [(12, "vile scum rotten vile scum " * 3, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(120)] + [(400 + k, 1, 1) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, passage


def taken(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage_decides_by_row(spark, corpus):
    import corpus_pipeline as P

    at, rows, passage = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    every = Counter((r[0], r[1]) for r in rows)
    assert taken(P.language_id(spark, docs, at)) == Counter({k: n for k, n in every.items() if k[1] and any(c.isalpha() for c in k[1])})
    gone = every - taken(P.toxicity(spark, docs, at))
    assert (12, "vile scum rotten vile scum " * 3) in gone and all("scum" in t for _, t in gone) and len(gone) > 55
    gone = every - taken(P.near_duplicates(spark, docs, at))
    assert gone == Counter({(7, rows[7][1]): 2, (None, rows[8][1]): 2, (10, rows[10][1]): 1, (None, "lost " + passage): 1})
    gone = every - taken(P.decontamination(spark, docs, at))
    assert gone == Counter({(None, "lost " + passage): 1, (11, passage): 1})
    pieces = P.packing(spark, docs, at).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r[0] for r in rows)


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, corpus):
    import corpus_pipeline as P

    at, rows, _ = corpus
    empty = spark.createDataFrame([], SCHEMA)
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id < 100")
    more = docs.selectExpr("*", "1 as kept", "2 as score", "3 as predicted", "'x' as row", "4 as component_id", "5 as key", "6 as _key", "7 as lang_pred", "8 as sequence_id", "9 as length")
    for name, stage in P.STAGES:
        out = stage(spark, empty, at)
        assert out.count() == 0 and (name == "packing" or out.columns == list(P.COLUMNS))
        out = stage(spark, more, at)
        assert name == "packing" or (out.columns == list(P.COLUMNS) and taken(out) == taken(stage(spark, docs, at)))


def test_run_is_its_stages_one_after_another(spark, corpus, tmp_path):
    import corpus_pipeline as P

    at, rows, passage = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    got = P.run(spark, at)
    assert kept(got) == kept(docs)
    ids = Counter(r["doc_id"] for r in got.where("start = 0").collect())
    assert ids[7] == 1 and ids[9] == 2 and ids[10] == 0 and ids[11] == 1 and ids[300] == 1 and ids[None] == 1 and ids[12] == 1
