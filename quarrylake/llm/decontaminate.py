"""Benchmark decontamination by spaced seeds.

Tokens are words of letters and digits, lower-cased. A seed is a fixed mask over a few token positions,
some of which it ignores, so a substituted token spoils only the seeds that look at it. Seed hashes of
the training texts pass a bitmap of the test texts' hashes (fixed size, never a false negative) and are
equi-joined with them; a hit names a diagonal (where the item would begin in the document). Around each
diagonal the tokens are compared: the best-scoring stretch, with matches and mismatches weighed, is
the overlap, whatever single tokens were substituted in it; or all of the diagonal, if enough of the
item's tokens are equal there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.cluster import bitmap, bounded_batches, in_bitmap, lean, materialise
from quarrylake.llm.textcore import TOKEN_BYTE, chunks, fold_case, mix, runs, signed, word_hashes

#: Token positions that each mask looks at.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 4, 5, 6), (0, 3, 5, 6, 8), (0, 1, 3, 4, 8), (0, 2, 4, 9, 10))
SPAN = max(m[-1] for m in MASKS) + 1
#: Masks for items of fewer than SPAN tokens, down to SHORTEST; shorter ones have one seed, all their tokens.
#: Wherever a fifth of an item's tokens, or fewer, are substituted, one of its seeds is spared.
SHORT_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SHORTEST = max(m[-1] for m in SHORT_MASKS) + 1
#: Bits of the test hashes' bitmap (8 MB) and of the hit documents' (2 MB).
LOG2_SEEDS, LOG2_DOCS = 26, 24
#: Test seeds (24 bytes each) up to which they are broadcast.
FEW_SEEDS = 500_000
#: Diagonals of a document and item that are verified together, at most.
DIAGONALS = 4096

_MULTIPLIER = np.uint64(0xA0761D6478BD642F)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk of texts, and each text's first token number.

    A-Z and the capitals of U+00C0 to U+00DE are lower-cased; other characters beyond ASCII count as letters.
    """
    data = fold_case(data)
    starts, ends, first = runs(TOKEN_BYTE[data], offsets)
    return word_hashes(data, starts, ends), first


def seeds(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(number + 1))
    for k in mask:
        total = total * _MULTIPLIER + hashes[k : k + n]
    return mix(total)


def masks_for(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The numbered masks for an item of n tokens."""
    if n >= SPAN:
        return list(enumerate(MASKS))
    if n >= SHORTEST:
        return [(len(MASKS) + k, m) for k, m in enumerate(SHORT_MASKS)]
    return [(len(MASKS) + len(SHORT_MASKS) + n, tuple(range(n)))] if n else []


def _item_tokens(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            h, first = tokens(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=["item_id", "item"],
            )


def _item_seeds(batches):
    """(seed, item_id, at) of test texts."""
    for batch in batches:
        ids, where, found = [], [], []
        for item_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = np.frombuffer(raw.as_py(), np.uint64)
            for number, mask in masks_for(len(h)):
                s = seeds(h, mask, number)
                found.append(s)
                where.append(np.arange(len(s)))
                ids += [item_id] * len(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate(found)) if found else [], pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate(where) if where else [], pa.int64())],
            names=["seed", "item_id", "at"],
        )


def _doc_seeds(bits, short: list[int]):
    """(seed, doc_id, at) of training texts for seeds that the bitmap may hold."""
    masks = sorted({*enumerate(MASKS), *(m for n in short for m in masks_for(n))})

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out_seed, out_doc, out_at = [], [], []
            for lo, _, data, offsets in chunks(batch.column(1)):
                h, first = tokens(data, offsets)
                for number, mask in masks:
                    s = seeds(h, mask, number)
                    at = np.flatnonzero(in_bitmap(bits.value, LOG2_SEEDS, s))
                    doc = np.searchsorted(first, at, side="right") - 1
                    within = at + mask[-1] < first[doc + 1]
                    at, doc = at[within], doc[within]
                    out_seed.append(s[at])
                    out_doc.append(ids[lo + doc])
                    out_at.append(at - first[doc])
            if out_seed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(out_seed))), pa.array(np.concatenate(out_doc), pa.int64()), pa.array(np.concatenate(out_at), pa.int64())],
                    names=["seed", "doc_id", "at"],
                )

    return scan


def _doc_tokens(bits):
    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = in_bitmap(bits.value, LOG2_DOCS, mix(ids.view(np.uint64)))
            chosen = batch.filter(pa.array(keep))
            for lo, hi, data, offsets in chunks(chosen.column(1)):
                h, first = tokens(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [chosen.column(0).slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                    names=["doc_id", "doc"],
                )

    return scan


def best_stretch(same: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """(begin, end, matches) of the stretch with most matches minus ``penalty`` times its mismatches."""
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    begin = int(np.flatnonzero(gain[: end + 1] == low[end])[-1])
    return begin, end, int(same[begin:end].sum())


def overlap(same: np.ndarray, least: int, enough: int, penalty: int) -> tuple[int, int, int] | None:
    """(begin, end, matches) of the best stretch if it has ``least`` equal tokens or ``enough``; else from
    the first to the last equal token if there are ``enough`` in all; else None."""
    stretch = best_stretch(same, penalty)
    if stretch[2] >= min(least, enough):
        return stretch
    equal = np.flatnonzero(same)
    return (int(equal[0]), int(equal[-1]) + 1, len(equal)) if len(equal) >= enough else None


def _verify(least: int, share: float, penalty: int):
    def check(frames):
        for pdf in frames:
            out = []
            for doc_id, item_id, raw, item_raw, diagonals in zip(pdf["doc_id"], pdf["item_id"], pdf["doc"], pdf["item"], pdf["diagonals"]):
                doc, item = np.frombuffer(raw, np.uint64), np.frombuffer(item_raw, np.uint64)
                best, enough = None, max(1, int(np.ceil(round(share * len(item), 9))))
                for d in sorted(diagonals):
                    lo, hi = max(0, -d), min(len(item), len(doc) - d)
                    if hi <= lo:
                        continue
                    found = overlap(item[lo:hi] == doc[lo + d : hi + d], least, enough, penalty)
                    if found and (best is None or found[2] > best[0]):
                        begin, end, matched = found
                        best = (matched, lo + begin + d, lo + begin, end - begin)
                if best:
                    out.append((doc_id, item_id, best[1], best[2], best[3], best[0], len(item)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_start", "item_start", "length", "matched", "item_tokens"])

    return check


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, least: int = 12, share: float = 0.8, penalty: int = 2,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The overlaps of training documents with test items: one row per document and item that overlap.

    Returns doc_id, item_id, doc_start and item_start (token numbers), length, matched (tokens equal in
    the stretch), item_tokens. A pair overlaps if its best stretch has at least ``least`` equal tokens; a
    stretch weighs each substituted token ``penalty`` times. It also overlaps if ``share`` of the item's
    tokens are equal anywhere on one diagonal; where no stretch suffices, the overlap then goes from the
    first equal token to the last.
    Of items with equal tokens the smallest id stands for all. Nulls, texts without tokens and rows
    without an id overlap with nothing; repeated rows of a document count once. Either table may be
    empty; other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    items = items.mapInArrow(_item_tokens, "item_id long, item binary").where("length(item) > 0").groupBy("item").agg(F.min("item_id").alias("item_id"))
    items = materialise(items.select("item_id", "item"), "items")
    tests = materialise(items.select("item_id", "item").mapInArrow(_item_seeds, "seed long, item_id long, at long"), "seeds")
    lengths = items.select((F.octet_length("item") / 8).cast("int").alias("n")).where(F.col("n") < SPAN).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most SPAN - 1 values
    bits = spark.sparkContext.broadcast(bitmap(tests, "seed", LOG2_SEEDS))

    train = source.mapInArrow(lean(_doc_seeds(bits, short)), "seed long, doc_id long, at long")
    # Few seeds are broadcast, so however many texts share one, their rows stay where they are; beyond
    # that the join is a shuffle, in which adaptive execution splits a seed that many texts hold.
    seeds_ = tests.withColumnRenamed("at", "item_at")
    hits = train.join(F.broadcast(seeds_) if tests.count() <= FEW_SEEDS else seeds_, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = materialise(hits, "hits")
    # One word, repeated, has as many diagonals as words: they are verified in stretches of bounded size.
    pairs = hits.groupBy("doc_id", "item_id", F.floor(F.col("diagonal") / DIAGONALS).alias("stretch")).agg(F.collect_list("diagonal").alias("diagonals"))

    chosen = spark.sparkContext.broadcast(bitmap(hits, "doc_id", LOG2_DOCS, mixed=False))
    # Written, so that a task never has two Python workers, one for tokens and one for the comparison.
    texts = materialise(source.mapInArrow(lean(_doc_tokens(chosen)), "doc_id long, doc binary"), "tokens")
    verified = (
        pairs.join(texts, "doc_id")
        .join(items, "item_id")
        .select("doc_id", "item_id", "doc", "item", "diagonals")
        .mapInPandas(_verify(least, share, penalty), "doc_id long, item_id long, doc_start long, item_start long, length long, matched long, item_tokens long")
    )
    best = verified.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("doc_start", "item_start", "length", "matched", "item_tokens"), F.struct("matched", -F.col("doc_start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.doc_start", "b.item_start", "b.length", "b.matched", "b.item_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that overlap with no test item, with all their columns."""
    found = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
