"""Packing: shortest-pack-first over the length histogram.

Texts are tokenised once. A document longer than a sequence gives full pieces and one remainder. The
histogram of piece lengths (at most as many rows as a sequence has tokens) goes to the driver, where
lengths are placed longest first into the pack with most room, whole counts at a time, so the work is
that of the histogram, not of the pieces. Each pattern then owns ranges of ranks of its lengths, and
pieces find their sequence and offset by their rank among pieces of their length. A piece's rank is its
number among its task's pieces of that length plus the counts of the tasks before, so no key's pieces
are ever gathered or sorted.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.cluster import bounded_batches, lean, materialise, task_number

#: Strings of up to CACHED_CHARS characters whose ids a worker keeps, at most so many.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48
END_ID = 1

_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space next to white space, or beyond ASCII's: there, cutting at spaces could split a pre-token.
_UNSAFE = re.compile("\\s\\s|[\x1c-\x1f\x85\xa0  -     　]")


class _Memo(dict):
    """Ids of one string, as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(self.prefix + part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    """The ids of ``tokenizers`` for a byte-level BPE file, with texts cut at spaces and parts remembered.

    A space between two non-space characters always starts a pre-token, so the parts' ids are the
    text's. The byte pairs are merged by tiktoken, given the file's own vocabulary, if its ids follow
    the merge order; else, and for texts that hold one of the file's special strings, by tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab = model["vocab"]
        in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") == "BPE" and plain and in_order and merges:
            to_byte = {c: b for b, c in _byte_characters().items()}
            ranks = {bytes(to_byte[c] for c in token): k for token, k in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding("byte_level", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.later, self.first = _Memo(self._merge, " "), _Memo(self._merge, "")

    def _merge(self, text: str) -> bytes:
        if self.fast is None:
            return self._slow(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return self._slow(text)
        if self.fast is None:
            return self._slow(text)
        if _UNSAFE.search(text):
            return self._merge(text)
        parts = text.split(" ")
        return b"".join([self.first[parts[0]] if parts[0] else b"", *map(self.later.__getitem__, parts[1:])])


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + k) for k, b in enumerate(rest)}


def _cut(path: str, room: int):
    """Rows of pieces: full ones, then the remainder; the end id belongs to the last piece.

    A row also has its task and its number among the task's pieces of its length. Both are written with
    it, so they stay as they are whatever is read again.
    """

    def scan(batches):
        encode = ByteBpe(path)
        end = np.array([END_ID], "<u4").tobytes()
        made, task = Counter(), task_number()
        for batch in batches:
            doc, start, length, crc, total, nth = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for lo in range(0, n, room):
                    piece = ids[4 * lo : 4 * (lo + room)]
                    doc.append(doc_id)
                    start.append(lo)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    nth.append(made[length[-1]])
                    made[length[-1]] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, [task] * len(doc), nth)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
            )

    return scan


def pack_histogram(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placing) with how many sequences follow each.

    Longest lengths first; each goes into the packs that have most room left, while any has enough,
    else opens new ones, each of which takes as many of the length as fit before the next is opened. A
    length splits one group of equal packs at most, or opens two, so there are at most two groups a
    length. Deterministic: equal room is broken by the groups' order of making.
    """
    heap: list[tuple[int, int]] = []
    groups: dict[int, list] = {}
    made = 0

    def push(lengths: tuple[int, ...], count: int) -> None:
        nonlocal made
        groups[made] = [lengths, count]
        heapq.heappush(heap, (sum(lengths) - room, made))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0][0] >= length:
            _, k = heap[0]
            lengths, count = groups[k]
            take = min(left, count)
            left -= take
            if take == count:
                heapq.heappop(heap)
                del groups[k]
            else:
                groups[k][1] -= take
            push((*lengths, length), take)
        # The new pack is the one with most room until no more of this length fit, as placing one by one would have it.
        full, over = divmod(left, room // length)
        if full:
            push((length,) * (room // length), full)
        if over:
            push((length,) * over, 1)
    return [tuple(x) for x in groups.values()]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) of the rank ranges that patterns own."""
    rows, used, sequence = [], Counter(), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    """Each ranked piece's sequence and offset: a search in the (length, rank) ranges."""
    shift = np.int64(1) << 48

    def scan(batches):
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(keys, batch.column(2).to_numpy() * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return scan


def pack(docs: DataFrame, tokenizer_path: str, *, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``room`` tokens; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document's tokens are
    its ids and the end id 1; a null or empty text is the end id alone. A document over ``room`` tokens
    is cut into full pieces and a remainder; a very long text takes the memory of its own ids. Sequence
    ids are gapless from 0, offsets gapless within a sequence; what remains of a sequence up to ``room``
    is padding, unless its tokens are a power of two, at which it may stay as it is. Null ids, repeated
    rows and equal lengths are kept as pieces of their own, and none is a key that gathers rows; an empty
    table gives no rows; columns other than the two, whatever their names, are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(_cut(tokenizer_path, room)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"
    )
    pieces = materialise(pieces, "pieces")
    by_task = pieces.groupBy("length", "task").count()
    histogram = {r["length"]: r["count"] for r in by_task.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    places = _places(pack_histogram(histogram, room))

    # At most as many rows as a task has lengths, for each task; one window row a task and length.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_task.select("length", "task", (F.sum("count").over(earlier) - F.col("count")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(places), schema) if len(places) else spark.createDataFrame([], schema)
