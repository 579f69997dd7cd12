"""A corpus pipeline: five stages over ``documents``, each calling one operator of quarrylake.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and
read again. Every stage works on all that its predecessor kept.

All stages decide by row, not by doc_id: a row with a null id is judged by its text, and rows that repeat
an id are judged each by their own. Nulls in lang, source and n_chars pass through; a very long text is a
row like others; columns beyond those of ``documents``, whatever their names, are dropped; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.cluster import discard, materialise
from quarrylake.llm.decontaminate import contaminated
from quarrylake.llm.jaccard import ngram_jaccard
from quarrylake.llm.language import UNDETERMINED, identify
from quarrylake.llm.packing import pack
from quarrylake.llm.toxicity import toxic_passages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; null and empty texts and those without a letter go.

    Repeated rows stay as they are. Without a language to learn from, all go.
    """
    return identify(docs, keep=COLUMNS).where(F.col("lang_pred") != UNDETERMINED).select("kept.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; learns from the labels of documents that came so far.

    Null and empty texts are not toxic. Repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic_passages(docs, labels, keep=COLUMNS).where("predicted = 0").select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links join: that of the least doc_id, a null id being the greatest.

    Repeated rows are a group like others. Texts without a word are linked with nothing and stay.
    """
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    linked = ngram_jaccard(rows, id_col="row").where("n_similar > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    linked = materialise(linked, "linked")
    named = linked.join(rows.select("row", "doc_id"), "row")
    stays = named.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return rows.join(linked.join(stays, "row", "left_anti"), "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts stay. Repeated rows stay or go together: a row is known by a hash of id and text.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    found = contaminated(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return docs.select(*COLUMNS, key.alias("_key")).join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, placed in sequences of at most 2048 tokens.

    Repeated rows and null ids are documents of their own; a null text is the end token alone.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the learnt stages or the tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
