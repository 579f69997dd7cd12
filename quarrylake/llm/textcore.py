"""Vectorised text primitives that the operators share: bytes in, numpy arrays out.

A batch of texts is one byte array with document offsets, as Arrow holds it. Nulls count as empty
texts. Batches are cut into chunks of about ``CHUNK_BYTES`` so that working arrays stay in cache and
a Python worker's memory stays bounded by the longest single document, never by the batch.
Hashes are 64 bits wide, seeded by constants, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
#: A random 64-bit value per byte, and the odd base of the polynomial word hash.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n-1 of ``base`` modulo 2**64, kept and extended by doubling."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n > 1 else 1 << 16
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[name] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes: all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def chunks(column: pa.Array, most: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; a null is an empty text.

    A chunk holds whole texts, at most ``rows`` of them and, unless it is one longer text, at most ``most`` bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, and each text's first word number."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    return runs(~IS_SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true positions that don't cross texts: starts, ends, first run of each text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial from prefix sums, one pass whatever the lengths."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power_table("base", BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power_table("inverse", BASE_INVERSE, n)[starts]
    return mix(h)


def range_hashes(data: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``word_hashes`` of several lists of byte ranges of the same bytes, with one pass over these."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power_table("base", BASE, n), out=sums[1:]) if n else None
    inverse = _power_table("inverse", BASE_INVERSE, n + 1)
    return [mix((sums[ends] - sums[starts]) * inverse[starts]) for starts, ends in ranges]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, width):
        total = total * SHINGLE_BASE + hashes[j : j + n]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, after lower-casing A-Z.

    A text of fewer words is one shingle, its whole sequence; a text without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = shingle_hashes(h, width)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            total = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    total = total * SHINGLE_BASE + x
            out.append(mix(np.array([total], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z and the capitals of U+00C0 to U+00DE lower-cased."""
    data = LOWER[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    capital = accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]
    data[capital] += 0x20
    return data


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed longs that Spark has."""
    return x.view(np.int64)
