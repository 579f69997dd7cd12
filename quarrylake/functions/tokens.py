"""Exact token counts by byte pair encoding, from a vocabulary file that the caller names.

Counting is Arrow-batched; a worker reads the file once and keeps it. Where no file is given, the
catalogue counts pre-tokens with ``functions.text.count_tokens``, which stays in the JVM.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split before merges that rank files without their own pattern are read with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by the vocabulary at ``path``: a rank file (.tiktoken), a tokenizer (.json) or a piece model (.model).

    Strings of special tokens in a text are ordinary text. One encoder a process and path.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [ordinary.encode_ordinary(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def counter(path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens; 0 for null or empty. Fits where ``count_tokens`` does."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        ids = encoder(path, pattern)
        # A few texts at a time, so the ids of a batch are never all held.
        rows = texts.fillna("").tolist()
        return pd.Series([len(x) for lo in range(0, len(rows), 64) for x in ids(rows[lo : lo + 64])], dtype="int64")

    return count
