"""Exact top-k search over an impact-ordered index, a score at a time.

Components are integers, so a posting's impact is the component itself. Rows are cut into blocks; a
block's index has, for each dimension, its rows in order of impact. For a query, every dimension's
postings contribute ``q * impact``; segments are processed in waves of descending contribution, each
wave being one contiguous range per dimension. After a wave, a row's score is at most what it has
gathered plus the wave's floor for every dimension not yet seen, and the k-th best exact score known so
far, in this block or in those before it, is a lower bound on the answer. Once few rows can still beat
that bound, they are rescored exactly and nothing else can be a member: that is the proof on which the
search stops.

Blocks are written once, packed. Queries are broadcast, so many bytes at a time, to all blocks, which stay
where they are; a task keeps the best rows of each query over all its blocks and sends these alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.cluster import discard, materialise

#: Rows in an index block, about, and bytes of queries that are broadcast at once.
BLOCK_ROWS = 8192
QUERY_BYTES = 64 << 20
#: The share of a block's rows worth rescoring at once.
RESCORE_SHARE = 0.12


class Block:
    """The index of some rows: an int matrix, and row numbers by impact for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.int64)
        columns = np.ascontiguousarray(self.vectors.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.sorted = np.take_along_axis(columns, self.order, axis=1)
        # Impacts are exact as doubles, in which they are added up (below 2**53 by far).
        self.impact = self.sorted.astype(np.float64)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray | None = None, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best (a superset, ties included), with exact scores.

        ``skip``: rows that aren't candidates. ``bound``: a score that k rows elsewhere reach.
        """
        n, dims = self.vectors.shape
        query = query.astype(np.int64)
        allowed = np.ones(n, bool)
        if skip is not None:
            allowed[skip] = False
        used = np.flatnonzero(query)
        if n <= 4 * k or not len(used):
            rows = np.flatnonzero(allowed)
            return rows, self.vectors[rows] @ query
        q = query[used]
        ends = np.stack([self.sorted[used, 0] * q, self.sorted[used, -1] * q])
        top, bottom = int(ends.max()), int(ends.min())
        floors = [f for f in (top >> 4, top >> 6, 0, -(top >> 7), -(top >> 6), -(top >> 5), -(top >> 4), -(top >> 2)) if bottom < f < top]
        floors = np.array(sorted({*floors, bottom}, reverse=True))
        # Where each wave begins in each dimension: contribution >= floor from the high end if q > 0
        # (impact >= ceil(floor / q)), from the low end if q < 0 (impact <= floor(floor / q)).
        bounds = np.stack([
            n - np.searchsorted(self.sorted[d], -(-floors // x), side="left") if x > 0 else np.searchsorted(self.sorted[d], floors // x, side="right")
            for d, x in zip(used.tolist(), q.tolist())
        ])
        # A posting adds its contribution and, in the low bits, that its dimension is seen.
        unit = 1 << (dims.bit_length() + 1)
        gathered = np.zeros(n, np.float64)
        done = np.zeros(len(used), np.int64)
        for wave, floor in enumerate(floors.tolist()):
            upto = bounds[:, wave]
            rows, weights = [], []
            for j, (d, x, lo, hi) in enumerate(zip(used.tolist(), q.tolist(), done.tolist(), upto.tolist())):
                if hi > lo:
                    part = slice(n - hi, n - lo) if x > 0 else slice(lo, hi)
                    rows.append(self.order[d, part])
                    weights.append(self.impact[d, part] * float(x * unit))
            done = upto
            if rows:
                gathered += np.bincount(np.concatenate(rows), np.concatenate(weights) + 1.0, minlength=n)
            whole = gathered.astype(np.int64)
            score, seen = whole // unit, whole % unit
            if floor == bottom:
                rows = np.flatnonzero(allowed)
                return rows, score[rows]
            most = score + (len(used) - seen) * floor
            most[~allowed] = np.iinfo(np.int64).min
            best = np.argpartition(most, n - 2 * k)[n - 2 * k :]
            best = best[allowed[best]]
            exact = np.sort(self.vectors[best] @ query)
            if len(exact) >= k:
                bound = exact[-k] if bound is None else max(bound, exact[-k])
                rows = np.flatnonzero(most >= bound)
                if len(rows) <= max(8 * k, RESCORE_SHARE * n):
                    return rows, self.vectors[rows] @ query
        raise AssertionError("the last wave returns")


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one block as one row: ids and components as bytes."""
    dims = int(pdf["dims"].iloc[0])
    pdf = pdf.sort_values("vec_id", kind="stable")
    x = np.vstack(pdf["v"].to_numpy()).astype(np.int64) if dims else np.zeros((len(pdf), 0), np.int64)
    return pd.DataFrame({"dims": [dims], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})


def _meet(queries, k: int):
    """The task's best rows of each query over all blocks that it gets."""

    def scan(frames):
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in frames:
            for dims, part, parts, ids, vectors in zip(pdf["dims"], pdf["part"], pdf["parts"], pdf["ids"], pdf["vectors"]):
                asked = queries.value.get(int(dims))
                if asked is None:
                    continue
                ids = np.frombuffer(ids, np.int64)
                block = Block(np.frombuffer(vectors, np.int64).reshape(len(ids), int(dims)))
                for number in range(int(part), len(asked[0]), int(parts)):
                    query_id, v = int(asked[0][number]), asked[1][number]
                    before = best.get((int(dims), number))
                    bound = int(before[1][-1]) if before is not None and len(before[1]) == k else None
                    lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
                    found, scores = block.search(v, k, np.arange(lo, hi), bound)
                    found = ids[found]
                    if before is not None:
                        found, scores = np.concatenate([before[0], found]), np.concatenate([before[1], scores])
                    best[int(dims), number] = best_rows(found, scores, k)
        out = [pd.DataFrame({"query_id": queries.value[d][0][n], "vec_id": i, "score": s}) for (d, n), (i, s) in best.items()]
        yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return scan


def topk_search(
    vectors: DataFrame, *, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row: query_id, rank, vec_id, score.

    Components x become floor(``scale`` * x), computed in doubles. Queries are the rows whose id is
    divisible by ``every``; candidates are all rows but those with the query's id. All are returned if
    there are fewer than ``k``; ties go to the smaller id. Vectors that are null or hold a null, NaN or
    infinity take no part, nor do rows with a null id; vectors of different lengths aren't compared;
    an empty vector scores 0. Repeated ids other than the query's are candidates each; a repeated query id
    is asked with each of its vectors, and ranked once. An empty table gives no rows; columns other than
    the two, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .select("vec_id", F.size("v").alias("dims"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    )
    # Blocks by a hash of id and vector, so rows of one id are spread as well.
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("n") / BLOCK_ROWS))
    cut = rows.join(F.broadcast(sizes.select("dims", blocks.alias("blocks"))), "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
    index = materialise(cut.select("dims", "block", "vec_id", "v").groupBy("dims", "block").applyInPandas(_pack, "dims int, block long, ids binary, vectors binary"), "index")
    queries = materialise(rows.where(F.col("vec_id") % every == 0), "queries")
    n_blocks, cores = index.count(), spark.sparkContext.defaultParallelism
    n_asked, n_bytes = queries.agg(F.count("*"), F.coalesce(F.sum(F.col("dims") * 8 + 8), F.lit(0))).first()
    rounds = max(1, -(-int(n_bytes) // QUERY_BYTES))
    # Few blocks are searched by several tasks each, for some of the queries each.
    parts = max(1, min(int(n_asked), cores // max(1, n_blocks)))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("parts", F.lit(parts)).repartition(max(1, min(n_blocks * parts, max(cores, n_blocks // 16))), "block", "part")
    found = None
    for step in range(rounds if n_asked else 0):
        # About QUERY_BYTES: a hash of the row's own deals them out.
        some = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(rounds)) == step)
        asked = some.toPandas().sort_values("vec_id", kind="stable")
        shared = spark.sparkContext.broadcast({int(d): (g["vec_id"].to_numpy(np.int64), np.vstack(g["v"].to_numpy()).astype(np.int64) if d else np.zeros((len(g), 0), np.int64)) for d, g in asked.groupby("dims")})
        one = materialise(spread.mapInPandas(_meet(shared, k), "query_id long, vec_id long, score long"), "found")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    discard(index, queries)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
