"""Cutting lineage between rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session, as in tests, gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, and later plans start from its files."""
    path = f"{shared_folder(df.sparkSession)}/quarrylake/settled-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
