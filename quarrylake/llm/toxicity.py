"""Toxicity: maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean documents under a Dirichlet prior made of the
whole corpus, taken at the safe end of its error, less a drift that makes unremarkable text cost. A
token is looked up as a word and by two prefixes, so inflected forms share evidence; the strongest
evidence counts. One linear pass finds every maximal scoring segment of a text. Their scores are put
on the scale of extreme values: with lambda from the scores' distribution in clean texts (the root of
sum p*exp(lambda*s) = 1) and K from their maxima, E = K*n*exp(-lambda*S) such segments are expected by
chance in n tokens. A document's evidence is the sum of -ln P over its segments that chance doesn't
explain, and a logistic curve turns it to a score.

Labelled learning rows are cut in folds. Each is scored by the counts of the others, which gives the
calibration and the curve, and chooses the weight of the prior and the width of the error: those under
which the learning rows' own labels are likeliest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.cluster import bounded_batches, discard, held_out_by, lean, materialise, task_number, tree_add
from quarrylake.llm.textcore import TOKEN_BYTE, chunks, fold_case, mix, range_hashes, runs

#: Buckets of the feature tables: 4 bytes each in a task (beside what labelled texts hold), 2 in the
#: broadcast table of scores, 14 in that of the folds, whatever the corpus.
LOG2_BUCKETS = 21
#: Labelled documents that are learnt from, and those that also calibrate, at most; more are thinned out by hash.
MOST_LABELS, MOST_CALIBRATING = 200_000, 20_000
#: Bytes of the two prefixes by which tokens are looked up, beside the whole word.
PREFIXES = (6, 4)
FOLDS = 3
#: Prior counts as shares of a feature's expected labelled count, and errors by which evidence is
#: reduced: of these pairs the learning rows choose one.
CHOICES = tuple((prior, errors) for prior in (0.1, 0.3, 1.0) for errors in (1.0, 1.5, 2.0, 3.0))
DRIFT = 0.5
_PARTS = 32
_COUNTS = "part int, task int, counts binary"
#: Numbers of the folds' toxic and clean counts that a task holds before it merges equal ones.
_HELD = 1_500_000


def features(data: np.ndarray, offsets: np.ndarray, log2_buckets: int = LOG2_BUCKETS):
    """(buckets by token and kind, token starts, token ends, first token of each text)."""
    data = fold_case(data)
    starts, ends, first = runs(TOKEN_BYTE[data], offsets)
    ranges = [(starts, ends), *((starts, np.minimum(ends, starts + k)) for k in PREFIXES)]
    shift = np.uint64(64 - log2_buckets)
    kinds = [(mix(h + np.uint64(k)) >> shift).astype(np.int64) for k, h in enumerate(range_hashes(data, ranges))]
    return np.stack(kinds), starts, ends, first


def _count(labels, log2_buckets: int):
    """By task: in how many documents each bucket occurs, and in how many learning ones of each fold and label."""

    def scan(batches):
        ids, cells = labels.value
        everywhere = np.zeros(1 << log2_buckets, np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send(counts_everywhere: np.ndarray) -> pa.RecordBatch:
            keys, counts = _merged(held)
            at = np.argsort(keys & ((1 << log2_buckets) - 1), kind="stable")
            keys, counts = keys[at], counts[at]
            width = (1 << log2_buckets) // _PARTS
            edges = np.searchsorted(keys & ((1 << log2_buckets) - 1), np.arange(_PARTS + 1) * width)
            parts = counts_everywhere.reshape(_PARTS, width)
            some = [k for k in range(_PARTS) if edges[k + 1] > edges[k] or parts[k].any()]
            payloads = [_packed(parts[k], keys[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]], log2_buckets) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([task_number()] * len(some), pa.int32()), pa.array(payloads, pa.binary())], names=["part", "task", "counts"])

        for batch in batches:
            doc_ids = batch.column(0).fill_null(-1).to_numpy().astype(np.int64)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc_ids), max(0, len(ids) - 1))
            cell = np.where(known & (ids[at] == doc_ids), cells[at], -1) if len(ids) else np.full(len(doc_ids), -1)
            for lo, _, data, offsets in chunks(batch.column(1)):
                buckets, _, _, first = features(data, offsets, log2_buckets)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.unique(np.concatenate([doc << log2_buckets | b for b in buckets]))
                doc, bucket = pairs >> log2_buckets, pairs & ((1 << log2_buckets) - 1)
                np.add.at(everywhere, bucket, np.int32(1))
                which = cell[lo + doc]
                own = which >= 0
                if own.any():
                    keys, counts = np.unique((which[own] << log2_buckets | bucket[own]).astype(np.int32), return_counts=True)
                    held.append((keys, counts.astype(np.int32)))
                    size += len(keys)
                    if size > _HELD:
                        held = [_merged(held)]
                        size = len(held[0][0])
                        if size > _HELD // 2:
                            yield send(np.zeros_like(everywhere))
                            held, size = [], 0
        yield send(everywhere)

    return scan


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    keys, counts = map(np.concatenate, zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int32) if len(keys) else counts


def _packed(everywhere: np.ndarray, keys: np.ndarray, counts: np.ndarray, log2_buckets: int) -> bytes:
    """One part's table: a row for all documents, then one for each fold's toxic and clean ones."""
    width = len(everywhere)
    table = np.zeros((1 + 2 * FOLDS, width), np.int32)
    table[0] = everywhere
    table[1 + (keys >> log2_buckets), keys & (width - 1)] = counts
    return pa.compress(table.tobytes(), "zstd", asbytes=True)


def log_odds(background, toxic, clean, totals: tuple[float, float, float], prior_share: float, errors: float) -> np.ndarray:
    """Scores of features from their counts and the counts' totals: log-odds at the safe end of their error."""
    n, n_toxic, n_clean = totals
    prior = prior_share * (background + 0.01) * (n_toxic + n_clean) / max(n, 1.0)
    whole = prior_share * (n_toxic + n_clean)
    odds = np.log((toxic + prior) / (n_toxic + whole)) - np.log((clean + prior) / (n_clean + whole))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - errors * error)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in order: linear time, over positive scores only.

    They are disjoint, and none can be extended or cut to score more.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    stack: list[tuple[float, float, int, int]] = []
    for k, left, right in zip(positive.tolist(), (total[positive] - scores[positive]).tolist(), total[positive].tolist()):
        begin = k
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, begin, k + 1))
                break
            left, _, begin, _ = stack[j]
            del stack[j:]
    return [(b, e, r - l) for l, r, b, e in stack]


def _strongest(each: np.ndarray) -> np.ndarray:
    """Of the scores by kind and token, each token's strongest, less the drift."""
    if not each.shape[1]:
        return np.zeros(0)
    return np.take_along_axis(each, np.abs(each).argmax(axis=0)[None], axis=0)[0].astype(np.float64) - DRIFT


def _score(weights, log2_buckets: int):
    """By document: tokens, byte spans and scores of its segments; further columns pass through."""

    def scan(batches):
        table = weights.value
        for batch in batches:
            n, begins, ends_, sums = [], [], [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                buckets, starts, ends, first = features(data, offsets, log2_buckets)
                scores = _strongest(table[buckets].astype(np.float32))
                for d, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    found = segments(scores[lo:hi])
                    n.append(hi - lo)
                    begins.append([int(starts[lo + b] - offsets[d]) for b, _, _ in found])
                    ends_.append([int(ends[lo + e - 1] - offsets[d]) for _, e, _ in found])
                    sums.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends_, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.float64())), *batch.columns[2:]],
                names=["doc_id", "n_tokens", "begins", "ends", "sums", *batch.schema.names[2:]],
            )

    return scan


def _try_choices(tables, totals: np.ndarray, fold_of, log2_buckets: int):
    """By learning document and choice: its segments' scores, by the counts of the other folds.

    A histogram of the token scores of clean documents is with the last document of each lot of them.
    """

    def scan(batches):
        counts = tables.value
        ids, folds = fold_of.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("toxic", "choice", "n_tokens", "sums", "histogram")}
            labels = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            doc_ids = batch.column(0).to_numpy().astype(np.int64)
            fold = folds[np.searchsorted(ids, doc_ids)]
            for lo, _, data, offsets in chunks(batch.column(1)):
                buckets, _, _, first = features(data, offsets, log2_buckets)
                distinct, at = np.unique(buckets, return_inverse=True)
                at = at.reshape(buckets.shape)
                each = np.expm1(counts[:, distinct].astype(np.float64))
                of = fold[lo : lo + len(first) - 1]
                for k in np.unique(of):
                    rest = [f for f in range(FOLDS) if f != k]
                    toxic, clean = each[[1 + 2 * f for f in rest]].sum(axis=0), each[[2 + 2 * f for f in rest]].sum(axis=0)
                    whole = (totals[0], totals[[1 + 2 * f for f in rest]].sum(), totals[[2 + 2 * f for f in rest]].sum())
                    for c, (prior, errors) in enumerate(CHOICES):
                        weight = log_odds(each[0], toxic, clean, whole, prior, errors) if whole[1] and whole[2] else np.zeros(len(distinct))
                        histogram = np.zeros(161, np.int64)
                        for d in np.flatnonzero(of == k).tolist():
                            scores = _strongest(weight[at[:, first[d] : first[d + 1]]])
                            out["toxic"].append(bool(labels[lo + d]))
                            out["choice"].append(c)
                            out["n_tokens"].append(len(scores))
                            out["sums"].append([s for _, _, s in segments(scores)])
                            out["histogram"].append(None)
                            if not labels[lo + d]:
                                histogram += np.bincount(np.clip(np.rint(scores * 4) + 80, 0, 160).astype(np.int64), minlength=161)
                        out["histogram"][-1] = histogram.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["toxic"], pa.bool_()), pa.array(out["choice"], pa.int32()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["sums"], pa.list_(pa.float64())), pa.array(out["histogram"], pa.binary())],
                names=list(out),
            )

    return scan


class Calibration:
    """lambda and K of chance segments, and the logistic curve over a document's evidence."""

    def __init__(self, rate: float, ln_k: float, slope: float, offset: float):
        self.rate, self.ln_k, self.slope, self.offset = rate, ln_k, slope, offset

    @staticmethod
    def fit(sample: pa.Table) -> tuple[Calibration, float]:
        """From labelled rows (toxic, n_tokens, sums, histogram) that the counts didn't see; and their labels' mean log loss."""
        y = sample["toxic"].to_numpy().astype(float)
        clean = y == 0
        histogram = np.zeros(161)
        for h in sample["histogram"].drop_null():
            histogram += np.frombuffer(h.as_buffer(), np.int64)
        p, s = histogram / max(1.0, histogram.sum()), (np.arange(161) - 80) / 4
        lo, hi = 1e-3, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (lo, mid)
        rate = min(max(lo, 0.05), 5.0)
        lists = sample["sums"].combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(y)), size)
        top = np.zeros(len(y))
        np.maximum.at(top, doc, flat)
        n = np.maximum(sample["n_tokens"].to_numpy().astype(float), 1)
        # The mean of a Gumbel law lies Euler's constant over its mode.
        ln_k = float(np.mean(rate * top[clean] - np.log(n[clean])) - 0.5772) if clean.any() else 0.0
        out = Calibration(rate, ln_k, 1.0, -3.0)
        x = np.bincount(doc, out.surprise(flat, n[doc]), minlength=len(y))
        if 0 < y.sum() < len(y):
            # Newton steps of a lightly penalised logistic regression on one variable.
            scale = max(1.0, float(np.quantile(x, 0.95)))
            z = np.stack([np.minimum(x / scale, 3), np.ones_like(x)], 1)
            w = np.zeros(2)
            for _ in range(40):
                q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                gradient = z.T @ (q - y) + 0.01 * w
                hessian = (z * (q * (1 - q))[:, None]).T @ z + 0.01 * np.eye(2)
                w -= np.linalg.solve(hessian, gradient)
            out.slope, out.offset = float(w[0] / scale), float(w[1])
        loss = np.logaddexp(0, -np.where(y > 0, 1, -1) * np.clip(out.slope * x + out.offset, -30, 30))
        return out, float(loss.mean()) if len(loss) else 0.0

    def surprise(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-ln P of segments, P the chance of one as high in n tokens, beyond what P = 1/2 gives."""
        expected = np.exp(np.clip(self.ln_k + np.log(n) - self.rate * scores, -700, 700))
        return np.maximum(-np.log(np.maximum(-np.expm1(-expected), 1e-300)) - np.log(2), 0)


def toxic_passages(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Score every document's toxicity and find its toxic passages; one row per row of ``docs``.

    Learns from labelled rows whose crc32(id) mod 3 isn't 1 (at most ``MOST_LABELS``, of which at most
    ``MOST_CALIBRATING`` calibrate, both thinned by hash); counts for the prior cover all documents.
    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``), n_tokens, evidence,
    and passages: an array of (begin, end, score) in bytes of the text, each improbable by chance in a
    text of its length; with ``keep``, also a struct ``kept`` of these columns of the same row.

    Null and empty texts have no tokens and the least score; a very long text is one row like others,
    read whole. A row with a null id is scored and never learnt from; repeated rows are scored each. An
    id labelled more than once is toxic if any label is; null labels are ignored. Without labels of both
    kinds every score is the same, under the threshold. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [F.struct(*keep).alias("kept")] if keep else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out_by(F.col("doc_id"), 3, 1))
    share = min(1.0, 0.98 * MOST_LABELS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy("doc_id").toPandas()  # at most MOST_LABELS rows
    ids, toxic = known["doc_id"].to_numpy(np.int64), known["toxic"].to_numpy(np.int64) > 0
    hashed = mix(ids.view(np.uint64))
    folds = (hashed % np.uint64(FOLDS)).astype(np.int64)
    learnt = spark.sparkContext.broadcast((ids, 2 * folds + ~toxic))

    texts = source.select("doc_id", "text")
    counted = materialise(texts.mapInArrow(lean(_count(learnt, LOG2_BUCKETS)), _COUNTS), "counts")
    tables, totals = _tables(spark, counted, LOG2_BUCKETS)
    discard(counted)

    # The labelled texts alone, by a join with at most MOST_CALIBRATING ids.
    by_hash = np.argsort(hashed >> np.uint64(8), kind="stable")[:MOST_CALIBRATING]
    chosen = spark.createDataFrame(pd.DataFrame({"doc_id": ids[by_hash], "toxic": toxic[by_hash]}), "doc_id long, toxic boolean")
    shared = spark.sparkContext.broadcast(tables)
    fold_of = spark.sparkContext.broadcast((ids, folds))
    tried = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(
        lean(_try_choices(shared, totals, fold_of, LOG2_BUCKETS)), "toxic boolean, choice int, n_tokens long, sums array<double>, histogram binary"
    )
    tried = materialise(tried, "choices")
    best = None
    for k in range(len(CHOICES)):
        sample = tried.where(F.col("choice") == k).select("toxic", "n_tokens", "sums", "histogram").toArrow()  # about MOST_CALIBRATING rows
        fitted, loss = Calibration.fit(sample)
        if best is None or loss < best[0]:
            best = (loss, CHOICES[k], fitted)
    _, (prior, errors), c = best
    discard(tried)
    weights = spark.sparkContext.broadcast(_weights(tables, totals, prior, errors))
    shared.destroy()
    del tables

    extra = f", kept {dict(source.dtypes)['kept']}" if keep else ""
    scored = source.mapInArrow(lean(_score(weights, LOG2_BUCKETS)), "doc_id long, n_tokens long, begins array<long>, ends array<long>, sums array<double>" + extra)

    expected = lambda s: F.exp(F.greatest(F.least(F.lit(c.ln_k) + F.log(F.greatest("n_tokens", F.lit(1))) - F.lit(c.rate) * s, F.lit(700.0)), F.lit(-700.0)))
    surprise = lambda s: F.greatest(-F.log(F.greatest(-F.expm1(-expected(s)), F.lit(1e-300))) - F.lit(float(np.log(2))), F.lit(0.0))
    out = scored.withColumn("evidence", F.aggregate(F.transform("sums", surprise), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(F.lit(c.slope) * F.col("evidence") + F.lit(c.offset), F.lit(30.0)), F.lit(-30.0)))))
    passages = F.filter(F.transform(F.arrays_zip("begins", "ends", "sums"), lambda x: F.struct(x["begins"].alias("begin"), x["ends"].alias("end"), x["sums"].alias("score"), surprise(x["sums"]).alias("surprise"))), lambda x: x["surprise"] > 3.0)
    return out.select(
        "doc_id",
        held_out_by(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        "n_tokens",
        "evidence",
        F.transform(passages, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["score"].alias("score"))).alias("passages"),
        *(["kept"] if keep else []),
    )


def _tables(spark: SparkSession, counted: DataFrame, log2_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """ln(1 + count) of each bucket, for all documents and by fold and label, in half precision, and the counts' totals."""
    width, kinds = (1 << log2_buckets) // _PARTS, 1 + 2 * FOLDS

    def add(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros((kinds, width), np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(pa.decompress(x, 4 * kinds * width, "zstd"), np.int32).reshape(kinds, width)
        return total

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        # A count that 31 bits can't hold is past where its log-odds change.
        total = np.minimum(add(pdf), 2**31 - 1).astype(np.int32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0]], "counts": [pa.compress(total.tobytes(), "zstd", asbytes=True)]})

    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    counted = tree_add(counted, ["part"], _COUNTS, some, tasks)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        total = add(pdf)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [np.log1p(total.astype(np.float64)).astype(np.float16).tobytes()], "totals": [total.sum(axis=1).tolist()]})

    table, totals = np.zeros((kinds, _PARTS, width), np.float16), np.zeros(kinds)
    for r in counted.groupBy("part").applyInPandas(sums, "part int, counts binary, totals array<long>").toLocalIterator():
        table[:, r["part"]] = np.frombuffer(r["counts"], np.float16).reshape(kinds, width)
        totals += r["totals"]
    return table.reshape(kinds, -1), totals


def _weights(tables: np.ndarray, totals: np.ndarray, prior: float, errors: float) -> np.ndarray:
    """The table of feature scores, from the counts of all folds."""
    out = np.zeros(tables.shape[1], np.float16)
    whole = (totals[0], totals[1::2].sum(), totals[2::2].sum())
    if whole[1] and whole[2]:
        for lo in range(0, len(out), 1 << 16):
            n = np.expm1(tables[:, lo : lo + (1 << 16)].astype(np.float64))
            out[lo : lo + (1 << 16)] = log_odds(n[0], n[1::2].sum(axis=0), n[2::2].sum(axis=0), whole, prior, errors)
    return out
