"""What the operators need of the cluster: written tables in its shared folder, and bitmaps of bounded size."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.textcore import mix
from quarrylake.operators.settle import shared_folder


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read back: lineage ends there.

    The files survive the loss of any executor, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarrylake/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._quarrylake_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_quarrylake_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of texts in one Arrow batch, about: what a task holds several times over, on both sides.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send batches of at most about ``BATCH_BYTES`` to Python, unless it asks for less already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory of this process back to the system; Python workers are used by one operator after another."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan``, for mapInArrow, whose worker holds no freed memory when the task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            release()

    return run


_released = [0.0]


def lean_group(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``f``, for applyInPandas, whose worker gives freed memory back twice a second or so."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        if time.monotonic() - _released[0] > 0.5:
            release()
            _released[0] = time.monotonic()
        return out

    return run


def held_out_by(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


#: Partial tables that one task adds up at once.
FAN_IN = 64


def tree_add(parts: DataFrame, keys: list[str], schema: str, add, tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Partial tables by key and ``task`` (0 to ``tasks`` - 1), added up until at most ``fan_in`` a key are left.

    ``add`` turns some rows of one key into one row of the same columns. Each round writes its sums, so
    a key's rows never meet in one task by more than ``fan_in``, however many tasks there were.
    """
    while tasks > fan_in:
        parts = materialise(parts.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy(*keys, "task").applyInPandas(lean_group(add), schema), "sums")
        tasks = -(-tasks // fan_in)
    return parts


#: Rows of a key from which it is hot; never so few that more than MOST_HOT keys could be.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def hot_limit(total: int) -> int:
    """Rows that a key may have before it is hot, of ``total``."""
    return max(HOT_ROWS, total // MOST_HOT)


def hot_join(many: DataFrame, one: DataFrame, key: str, count: str, total: int, hot_rows: int | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one``, whose keys are distinct and whose ``count`` says how many rows of ``many`` have each.

    A key may hold any share of ``many``. Keys of more than ``hot_rows`` of the ``total`` rows, of which there
    are at most ``MOST_HOT``, are broadcast, so their rows stay where they are; the others are joined by a
    shuffle in which none weighs much. ``count`` is not in the result.
    """
    limit = hot_rows or hot_limit(total)
    if total <= limit:
        return many.join(one.drop(count), key)
    hot = one.where(F.col(count) > limit).drop(count)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(count) <= limit).drop(count), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def bitmap(df: DataFrame, column: str, log2_bits: int, mixed: bool = True) -> np.ndarray:
    """A bit for each value's top ``log2_bits`` bits, as packed uint8; values that aren't ``mixed`` yet are mixed first.

    Each task sends at most the whole bitmap, 2**log2_bits / 8 bytes, cut in blocks that are OR-ed in
    parallel; the driver gets that many bytes, whatever the number of rows.
    """
    blocks = min(64, 1 << max(0, log2_bits - 10))
    width = (1 << log2_bits) // 8 // blocks

    def mark(batches):
        bits = np.zeros(1 << log2_bits, dtype=bool)
        seen = False
        for b in batches:
            values = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            values = values if mixed else mix(values)
            bits[(values >> np.uint64(64 - log2_bits)).astype(np.int64)] = True
            seen = seen or len(values) > 0
        if seen:
            packed = np.packbits(bits).reshape(blocks, width)
            some = np.flatnonzero(packed.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([packed[k].tobytes() for k in some], pa.binary())],
                names=["block", "bits"],
            )

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [total.tobytes()]})

    parts = df.select(F.col(column).cast("long")).mapInArrow(lean(mark), "block int, bits binary")
    out = np.zeros((blocks, width), np.uint8)
    for r in parts.groupBy("block").applyInPandas(unite, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, log2_bits: int, values: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``values`` may have been marked; never false for one that was."""
    at = (values >> np.uint64(64 - log2_bits)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0


#: Up to so many edges (16 bytes each) are joined into components on the driver; more go in rounds of joins.
DRIVER_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", driver_edges: int = DRIVER_EDGES, hot_rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of undirected ``edges`` of longs.

    Edges are counted first. At most ``driver_edges`` are united on the driver; beyond that, alternating
    large-star and small-star rounds do it, each an aggregation and a join on the node, so no node's
    neighbours are gathered anywhere and a star of any size costs one row per edge; nodes of very many
    edges are joined apart. Rounds are written to the shared folder; they end when a round changes no edge.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = materialise(e, "edges")
    n = e.count()
    if n <= driver_edges:
        pairs = e.toPandas().to_numpy(np.int64).reshape(-1, 2)
        node, component = _unite(pairs)
        return e.sparkSession.createDataFrame(pd.DataFrame({"node": node, "component": component}), "node long, component long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count")).select("u", F.least("m", "u").alias("m"), "count")
        large = hot_join(both.where("v > u"), low, "u", "count", 2 * n, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        small = (
            hot_join(large, low, "u", "count", 2 * n, hot_rows)
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u != v")
            .distinct()
        )
        after = materialise(small, "edges")
        stats = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, after)]
        discard(e)
        e, n = after, stats[1][0]
        if stats[0] == stats[1]:
            break
    member = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _unite(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node each one reaches."""
    node, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(node))
    while True:
        after = label.copy()
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        for side in (0, 1):
            np.minimum.at(after, at[:, side], low)
            np.minimum.at(after, label[at[:, side]], low)
        after = after[after]
        if (after == label).all():
            return node, node[label]
        label = after
