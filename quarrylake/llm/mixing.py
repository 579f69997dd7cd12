"""LM scoring by online logistic context mixing.

A text (lower-cased, with an end) is coded bit by bit along a fixed prefix code of its bytes. Several
predictors look up hashed contexts of the current node (the last 2, 3 and 5 bytes, and the current
word so far) in tables of bit counts over the whole training corpus, whose size follows the corpus up to
a bound. Their logits are combined with weights that a gate selects by how sure the two longest contexts
are; within a document, each gate's weights are refined by the coding errors so far: after 128 bytes, 256,
512, and so on, and from 2,048 bytes on after every 2,048. The code length is exact: each bit's probability
depends only on what precedes it.

The unigram base goes with it: every token's count in the training texts. Words are counted exactly by
64-bit hash; the counts of the most frequent ones are broadcast up to a bound, and the others are joined.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.cluster import FAN_IN, bounded_batches, discard, held_out_by, lean, lean_group, materialise, release, task_number, tree_add
from quarrylake.llm.textcore import BASE, BASE_INVERSE, BYTE_VALUE, IS_SPACE, LOWER, _power_table, chunks, mix, signed, word_hashes, words

#: Slots (log2) of the predictors' tables: 8 bytes a slot in a task, 1 in the broadcast model.
ORDERS = (2, 3, 5)
LOG2_SLOTS = (18, 20, 22, 22)
#: Training bytes (log2) from which the two large tables double with each doubling, up to MOST_LOG2 slots.
GROW_FROM, MOST_LOG2 = 28, 23
#: Where the search for the initial weights begins, by gate: near what texts gave, so that one pass often does. The search
#: ends with a step that gains less than so many bits a decision (what it leaves is about a tenth of that), or after so many passes.
START = [
    *([0.2, 0.25, 0.4, 0.4], [0.0, 0.25, 0.4, 0.25], [0.2, 0.4, 0.4, 0.35]),
    *([0.05, 0.3, 0.7, 0.4], [-0.1, 0.1, 0.7, 0.3], [0.0, 0.35, 0.6, 0.45]),
    *([0.1, 0.4, 0.65, 0.4], [0.0, 0.2, 0.75, 0.15], [0.0, 0.25, 0.5, 0.4]),
    *([0.25, 0.4, 0.65, 0.4], [0.05, 0.35, 0.75, 0.1], [0.0, 0.25, 0.65, 0.35]),
]
LEAST_GAIN, MOST_PASSES = 1e-3, 8
#: Words whose counts are broadcast, at most (16 bytes each).
HEAD_WORDS = 1_500_000
#: Bytes after which a document's weights are first refined; the blocks double up to the second number.
BLOCK_BYTES, MOST_BLOCK = 128, 2048
#: The step of a refinement, and what is added to the curvature that divides it.
RATE, CAUTION = 0.5, 50.0
PRIOR = 0.15
_STEP = 8.0
_GATES = 12
#: Pairs of bytes that have codes of their own.
CODE_ROWS = 256
_PARTS = 16
_SUMS = "kind string, key int, task int, payload binary"
_PAD = 5
#: Bytes of texts at once: as they are coded; among which equal bytes in equal contexts are looked for; and for scores,
#: whose rounds cost less the more texts share them. Bytes whose decisions are made or told at once, in cache.
_CHUNK, _ALIKE_CHUNK, _SCORE_CHUNK, _AT_ONCE = 1 << 16, 1 << 20, 1 << 17, 1 << 14
END_HASH = np.uint64(0x51ED270B153A3F41)

#: Bytes as they are coded, and those between words: white space and ends.
_CODED = np.maximum(LOWER, 1)
_BREAK = IS_SPACE.copy()
_BREAK[0] = True

_rng = np.random.Generator(np.random.PCG64(77))
_BYTE32 = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_MULTIPLIERS = _rng.integers(0, 2**32, 8, dtype=np.uint32) | np.uint32(1)


class Code:
    """A prefix code of bytes for each context of the two bytes before: ``context`` gives the code's row by
    256 * (last but one) + last; ``spans`` has the entries of each row and byte, which are bits and hashes of
    the nodes on the way. In every row every byte has a place."""

    def __init__(self, weights: np.ndarray, context: np.ndarray | None = None):
        """Huffman codes for rows of 256 weights above 0; without ``context`` the first row serves everywhere."""
        self.context = np.zeros(1 << 16, np.uint16) if context is None else context.astype(np.uint16)
        rng = np.random.Generator(np.random.PCG64(78))
        #: By row and byte: where its entries begin, times 64, and how many there are.
        self.spans = np.zeros(256 * len(weights), np.uint32)
        bits, hashes, at = [], [], 0
        for k, row in enumerate(weights):
            way_bits, way_nodes = self._huffman(row)
            named = rng.integers(0, 2**32, 512, dtype=np.uint32)
            # The likeliest bytes' entries lie together.
            for b in np.argsort(-row, kind="stable").tolist():
                self.spans[256 * k + b] = at * 64 + len(way_bits[b])
                at += len(way_bits[b])
                bits += way_bits[b]
                hashes.append(named[np.array(way_nodes[b]) - 256])
        self.bits, self.hashes = np.array(bits, np.int8), np.concatenate(hashes)

    @staticmethod
    def _huffman(weights: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """Each byte's bits and the nodes (256 and up) at which they are taken."""
        heap = [(int(w), b) for b, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, number = [0] * 512, [0] * 512, 256
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = number
            side[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], number))
            number += 1
        bits, nodes = [], []
        for k in range(256):
            way, turns = [], []
            while k != number - 1:
                turns.append(side[k])
                k = parent[k]
                way.append(k)
            bits.append(turns[::-1])
            nodes.append(way[::-1])
        return bits, nodes


def usual_weights() -> np.ndarray:
    """Weights of bytes for usual frequencies of letters in European text."""
    common = " etaonirsdlhucmpgbfvwqyzkxj.,\n"
    weight = {b: 1 for b in range(256)}
    weight |= {ord(c): max(20, int(9000 * 0.86**k)) for k, c in enumerate(common)}
    weight |= {b: 60 for b in (0, *range(48, 58), 33, 35, 36, 37, 38, 42, 45, 124)} | {195: 500} | {b: 60 for b in range(160, 192)}
    return np.array([weight[b] for b in range(256)], np.int64)


@cache
def usual_code() -> Code:
    return Code(usual_weights()[None])


def fitted_code(before: np.ndarray, after: np.ndarray, n: np.ndarray, rows: int = CODE_ROWS) -> Code:
    """The code for counts of (256 * last but one + last, next byte): shorter ways for what came often.

    Pairs that came most have rows of their own, the others one for the last byte.
    """
    last = np.zeros((256, 256), np.int64)
    np.add.at(last, (before & 255, after), n)
    often = np.argsort(-np.bincount(before, n, minlength=1 << 16), kind="stable")[:rows]
    often = often[np.isin(often, before)]
    own = np.zeros((len(often) + 1, 256), np.int64)
    of = np.full(1 << 16, len(often))
    of[often] = np.arange(len(often))
    np.add.at(own, (of[before], after), n)
    return code_of(last, often, own[:-1])


def code_of(last: np.ndarray, often: np.ndarray, own: np.ndarray) -> Code:
    """The code for counts by last byte and next, and for those of the pairs ``often`` by next byte."""
    # Counts of more than 2**30 in all are scaled down, so that no way has 64 bits or more.
    over = max(1, -(-int(last.sum()) >> 30))
    last, own = last // over, own // over
    usual = usual_weights() + last.sum(axis=0) * 60_000 // max(1, int(last.sum()))
    weights = [usual[None] + last * 2000]
    context = np.arange(1 << 16) & 255
    context[often] = 256 + np.arange(len(often))
    scale = 200_000 // np.maximum(1, weights[0].sum(axis=1) // 1000)
    weights.append(1 + own * 4000 + weights[0][often & 255] * scale[often & 255][:, None] // 1000 * 10)
    return Code(np.concatenate(weights), context)


def slots_for(n_bytes: int, most: int = MOST_LOG2) -> tuple[int, ...]:
    """Slots (log2) of the tables for so many bytes of training text."""
    more = max(0, min(int(max(1, n_bytes)).bit_length() - GROW_FROM, most - LOG2_SLOTS[-1]))
    return (*LOG2_SLOTS[:2], *(x + more for x in LOG2_SLOTS[2:]))


def _block_starts(longest: int) -> np.ndarray:
    """Where blocks begin in a text of ``longest`` bytes: 0, 128, 256, 512, ..., then every MOST_BLOCK bytes."""
    starts = [0]
    while starts[-1] < longest:
        starts.append(max(BLOCK_BYTES, min(2 * starts[-1], starts[-1] + MOST_BLOCK)))
    return np.array(starts[:-1] or [0])


class Texts:
    """Some texts as they are coded: each one's bytes, lower-cased (a NUL counts as 1), and an end byte 0, in order of
    texts and positions. ``near`` has each coded byte below the _PAD bytes before it, as 48 bits, ``word`` a
    hash of the current word so far, before it is mixed, ``words`` the hashes of all whole words and
    ``word_at`` the coded bytes after these."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.lengths = np.diff(offsets)
        self.near, self.word = np.empty((2, len(data) + self.n), np.uint64)
        words_, at, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while lo < self.n:
            # So few at once that working arrays stay in cache.
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, side="right")) - 1)
            a, b = int(offsets[lo]), int(offsets[hi])
            some = self._code(data[a:b], offsets[lo : hi + 1] - a, slice(a + lo, b + hi))
            words_.append(some[0])
            at.append(some[1] + (a + lo))
            lo = hi
        self.words, self.word_at = np.concatenate(words_), np.concatenate(at)

    def _code(self, data: np.ndarray, offsets: np.ndarray, out: slice) -> tuple[np.ndarray, np.ndarray]:
        """Fill ``near`` and ``word`` for some texts; their words, and the coded bytes after these."""
        n = len(offsets) - 1
        # Each text, its end and zeros that hide the text before.
        shift = np.arange(n) * _PAD + _PAD
        b = np.zeros(len(data) + n * _PAD + _PAD, np.uint8)
        coded = np.ones(len(b), bool)
        coded[:_PAD] = False
        for k in range(_PAD):
            coded[offsets[1:] + shift + k] = False
        b[coded] = _CODED.take(data)
        coded[offsets[1:] + shift] = True
        where = np.flatnonzero(coded)
        two = b[:-1].astype(np.uint16)
        two <<= np.uint16(8)
        two |= b[1:]
        near = two[: 1 - _PAD].astype(np.uint64)
        near <<= np.uint64(16)
        near |= two[2:-2]
        near <<= np.uint64(16)
        near |= two[4:]
        where -= _PAD
        near.take(where, out=self.near[out], mode="clip")
        where += _PAD
        # The current word: the bytes since the last white space, as a polynomial from prefix sums.
        space = _BREAK.take(b)
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE.take(b) * _power_table("base", BASE, len(b)), out=sums[1:])
        starts = np.flatnonzero(space)
        size = np.diff(starts, append=len(b))
        starts += 1
        # From the first zero on, each place up to the next start is told by the start before it.
        word = sums[1 : len(b) + 1] - np.repeat(sums.take(starts), size)
        word *= np.repeat(_power_table("inverse", BASE_INVERSE, len(b) + 1).take(starts), size)
        where -= 1
        word = word.take(where, out=self.word[out], mode="clip")
        # Where white space or the end follows another byte, that hash is a whole word's.
        ends = space[1:] > space[:-1]
        word_at = np.flatnonzero(ends.take(where))
        if len(data) and data.min() == 0:
            # A NUL isn't what it counts as, for words.
            lower = LOWER[data]
            starts, ends, first_word = words(lower, offsets)
            return word_hashes(lower, starts, ends), ends + np.repeat(np.arange(n), np.diff(first_word))
        return mix(word[word_at]), word_at

    def text(self) -> np.ndarray:
        """Each coded byte's text."""
        return np.repeat(np.arange(self.n), self.lengths + 1)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of coded bytes, told apart by all that their decisions depend on: the bytes before, the current
        word so far and the byte itself (as 64 bits). Gives each kind's first byte and how often it comes."""
        key = self.near * END_HASH
        key += self.word
        # Sorted by the upper bits, with the byte's number below.
        low = np.uint64((1 << len(key).bit_length()) - 1)
        order = key & ~low
        order |= np.arange(len(key), dtype=np.uint64)
        order.sort()
        order &= low
        order = order.view(np.int64)
        key = key.take(order)
        new = np.ones(len(order), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        size, at = np.diff(first, append=len(order)), order.take(first)
        # Kinds in order of the texts.
        new[:] = False
        new[at] = True
        number = np.cumsum(new).take(at) - 1
        times = np.empty(len(at), np.int32)
        times[number] = size
        return np.flatnonzero(new), times


def _contexts(near: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last bytes, by order, and of the current word."""
    before = [_BYTE32.take((near >> np.uint64(8 * j)).astype(np.uint8)) for j in range(1, _PAD + 1)]
    out = []
    for k, order in enumerate(ORDERS):
        h = before[order - 1] + _MULTIPLIERS[k]
        h *= _MULTIPLIERS[k]
        for j in range(order - 1, 0, -1):
            h += before[j - 1]
            h *= _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        out.append(h)
    return [*out, (mix(word) >> np.uint64(32)).astype(np.uint32)]


def _decisions(code: Code, log2_slots: tuple[int, ...], near: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of some coded bytes: where each one's decisions begin, and each decision's byte, bit and slots by table."""
    symbol = code.context.take((near >> np.uint64(8)).astype(np.uint16)).astype(np.int64)
    symbol <<= 8
    symbol |= near.astype(np.uint8)
    spans = code.spans.take(symbol).astype(np.int64)
    size = spans & 63
    spans >>= 6
    edges = np.concatenate([[0], np.cumsum(size)])
    # Each decision's byte (every byte has one at least), and its entry.
    byte = np.zeros(int(edges[-1]), np.int64)
    byte[edges[1:-1]] = 1
    np.cumsum(byte, out=byte)
    spans -= edges[:-1]
    entry = spans.take(byte)
    entry += np.arange(len(byte))
    node, slots = code.hashes.take(entry), []
    for h, log2 in zip(_contexts(near, word), log2_slots):
        x = h.take(byte)
        x += node
        x *= np.uint32(0x9E3779B1)
        x >>= np.uint32(32 - log2)
        slots.append(x)
    return edges, byte, code.bits.take(entry), slots


def _decisions_of(texts: Texts, at: np.ndarray, log2_slots: tuple[int, ...], code: Code):
    """``_decisions`` of some coded bytes, some thousands of bytes at once, after the first byte's number."""
    for lo in range(0, len(at), _AT_ONCE):
        some = at[lo : lo + _AT_ONCE]
        yield lo, *_decisions(code, log2_slots, texts.near.take(some), texts.word.take(some))


def _in_rounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of texts' bytes by blocks, then by texts, longest first, their texts in it, and where each block begins."""
    n, coded = len(lengths), int((lengths + 1).sum())
    longest = int(lengths.max(initial=0)) + 1
    if longest <= BLOCK_BYTES:
        return np.arange(coded), np.repeat(np.arange(n), lengths + 1), np.array([0, coded])
    starts = _block_starts(longest)
    by_length = np.argsort(-lengths, kind="stable")
    # Where each block of each text begins and how long it is; blocks of no bytes drop out.
    lo = starts[:, None] + np.zeros(n, np.int64)
    size = np.clip(lengths[by_length] + 1 - lo, 0, np.append(starts[1:], longest)[:, None] - starts[:, None])
    begin = (np.cumsum(lengths + 1) - lengths - 1)[by_length] + lo
    rounds = np.concatenate([[0], np.cumsum(size.sum(axis=1))])
    text = np.repeat(np.tile(by_length, len(starts)), size.ravel())
    size, begin = size.ravel(), begin.ravel()
    order = np.repeat(begin - (np.cumsum(size) - size), size)
    order += np.arange(coded)
    return order, text, rounds


class Decisions:
    """All binary decisions of some texts: their bits and the tables' slots.

    Bytes, and so decisions, are in order of texts and positions. With ``rounds``, they are in order of
    blocks, then of texts, longest first, so that a round of refinements takes one stretch of every array
    and the texts that go on are the first of it. ``text`` has each byte's text, ``edges`` where each
    byte's decisions begin, ``rounds`` where each block's bytes begin, ``words`` the hashes of all words
    and ``word_text`` their texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, log2_slots: tuple[int, ...] = LOG2_SLOTS, code: Code | None = None, rounds: bool = True):
        texts = Texts(data, offsets)
        self.n, self.text, near, word = texts.n, texts.text(), texts.near, texts.word
        self.words, self.word_text, self.rounds = texts.words, self.text[texts.word_at], np.array([0, len(near)])
        if rounds:
            order, self.text, self.rounds = _in_rounds(texts.lengths)
            near, word = near[order], word[order]
        self.edges, _, self.bits, self.slots = _decisions(code or usual_code(), log2_slots, near, word)


class Told:
    """Decisions of some texts in rounds, like ``Decisions``, that have logits and gates in place of slots."""

    def __init__(self, texts: Texts, mixer: Mixer):
        self.n = texts.n
        order, self.text, self.rounds = _in_rounds(texts.lengths)
        pieces, edges, total = [], [np.zeros(1, np.int64)], 0
        for _, some, _, bits, slots in _decisions_of(texts, order, mixer.log2_slots, mixer.code or usual_code()):
            logits, gate = mixer._told(slots)
            pieces.append((bits, gate, *logits))
            edges.append(some[1:] + total)
            total += len(bits)
        self.edges = np.concatenate(edges)
        self.bits, self.gate, *self.logits = map(np.concatenate, zip(*pieces))


#: ln(1 + exp(-x)) and 1 / (1 + exp(x)) for x = -16 to 16 in steps of 1/64.
_GRID = (np.arange(2049) - 1024) / 64
_LOSS = np.logaddexp(0, -_GRID).astype(np.float32)
_ERROR = (1 / (1 + np.exp(_GRID))).astype(np.float32)


#: Parts of a gate, by the logits of the two longest contexts.
_LEVEL = np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(int))
_SURE = (np.where(_LEVEL == 0, 0, np.where(_LEVEL < 12, 1, np.where(_LEVEL < 28, 2, 3))) * 3).astype(np.uint8)
_WORD = np.where(_LEVEL == 0, 0, np.where(_LEVEL < 20, 1, 2)).astype(np.uint8)


class Mixer:
    """The tables' logits, the initial weights by gate, and what a text's own errors add to them."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, squares: np.ndarray | None = None, code: Code | None = None):
        self.tables, self.code = tables, code
        self.log2_slots = tuple(len(t).bit_length() - 1 for t in tables)
        self.weights = np.array(START, np.float32) if weights is None else weights
        #: The mean squares of logits by gate, by which the curvature is told from the spread of errors.
        usual = [max(1.0, float(((t[:: max(1, len(t) >> 16)].astype(np.float32) / _STEP) ** 2).mean())) for t in tables]
        self.squares = np.tile(np.array(usual, np.float32), (_GATES, 1)) if squares is None else squares
        self.sure, self.word = _SURE, _WORD

    def decisions(self, data: np.ndarray, offsets: np.ndarray, rounds: bool = True) -> Decisions:
        return Decisions(data, offsets, self.log2_slots, self.code, rounds)

    def bits(self, texts: Decisions | Told) -> np.ndarray:
        """Code length of each text in bits."""
        logits, gate = (texts.logits, texts.gate) if isinstance(texts, Told) else self._told(texts.slots)
        out = np.zeros(texts.n)
        # What a text's own errors add to the weights, and the curvature they have met, by gate.
        own = np.zeros((texts.n, _GATES, len(logits)), np.float32)
        met = np.zeros((texts.n, _GATES), np.float32)
        for first, end, go_on in self._stretches(texts):
            which = texts.text[first]
            begin = texts.edges[first]
            a, b = int(begin[0]), int(texts.edges[end])
            begin = np.append(begin, b) - a
            cell = np.repeat(np.arange(0, len(which) * _GATES, _GATES), np.diff(begin))
            cell += gate[a:b]
            weights = (self.weights + own[which]) * np.float32(64 / _STEP)
            total = np.zeros(b - a, np.float32)
            for k, z in enumerate(logits):
                w = np.ascontiguousarray(weights[:, :, k]).ravel().take(cell)
                w *= z[a:b]
                total += w
            # The margin of the bit that came, on the grid of 1/64; a rounding that every bit shares
            # with its complement, so both probabilities still add up to 1.
            np.rint(total, out=total)
            np.clip(total, -1024, 1024, out=total)
            sign = texts.bits[a:b] * np.float32(2)
            sign -= 1
            total *= sign
            total += 1024
            margin = total.astype(np.intp)
            out[which] += np.add.reduceat(_LOSS.take(margin), begin[:-1], dtype=np.float64) / np.log(2)
            if go_on:
                which, upto = which[:go_on], int(begin[go_on])
                cell, error = cell[:upto], _ERROR.take(margin[:upto])
                met[which] += np.bincount(cell, error * (1 - error), minlength=go_on * _GATES).reshape(go_on, _GATES)
                error *= sign[:upto]
                step = RATE / (met[which][:, :, None] * self.squares + CAUTION)
                gradient = np.stack([np.bincount(cell, error * z[a : a + upto], minlength=go_on * _GATES).reshape(go_on, _GATES) for z in logits], axis=2) / _STEP
                own[which] += step * gradient
        return out

    @staticmethod
    def _stretches(texts: Decisions | Told):
        """Some texts of a round at once: where their bytes begin and end, and how many of them, the first ones, have another block."""
        ends = texts.rounds[1:].tolist()
        for lo, hi, after in zip([0, *ends[:-1]], ends, [*ends[1:], None]):
            text = texts.text[lo:hi]
            first = np.concatenate([[lo], np.flatnonzero(text[1:] != text[:-1]) + (lo + 1)])
            end = np.append(first[1:], hi)
            go_on = 0 if after is None else int(np.count_nonzero(texts.text[hi + 1 : after] != texts.text[hi : after - 1])) + 1
            at = 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(end, first[at] + _AT_ONCE, side="right")))
                yield first[at:to], int(end[to - 1]), min(max(go_on - at, 0), to - at)
                at = to

    def _told(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Decisions' logits by table, and their gates."""
        logits = [t.take(s) for t, s in zip(self.tables, slots)]
        gate = self.sure.take(logits[-2].view(np.uint8))
        gate += self.word.take(logits[-1].view(np.uint8))
        return logits, gate


#: What a gate's sums are of: products of logits under the curvature, slopes, squares of logits, and decisions.
_CURVES, _SLOPES, _SQUARES, _TIMES = slice(0, 16), slice(16, 20), slice(20, 24), 24
_PRODUCT = 7168


def slopes(lacking: list[np.ndarray], weights: np.ndarray, code: Code, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By gate, what these training texts say of the weights.

    Each decision is told by counts that lack it: ``lacking`` has, for each slot and bit, the logit of the
    slot's counts without one such bit.
    """
    texts, code, log2_slots = Texts(data, offsets), code or usual_code(), tuple((len(t) // 2).bit_length() - 1 for t in lacking)
    at, times = texts.kinds()
    out = np.zeros((_GATES, 25))
    for lo, _, byte, bits, slots in _decisions_of(texts, at, log2_slots, code):
        out += _slopes_of(lacking, weights, bits, slots, times[lo : lo + _AT_ONCE].astype(np.float32).take(byte))
    return out


def _slopes_of(lacking: list[np.ndarray], weights: np.ndarray, bits: np.ndarray, slots: list[np.ndarray], times: np.ndarray) -> np.ndarray:
    """``slopes`` of some decisions, each one that came so many ``times``."""
    logits = []
    for t, s in zip(lacking, slots):
        s *= np.uint32(2)
        s += bits.view(np.uint8)
        logits.append(t.take(s))
    gate = _SURE.take(logits[-2].view(np.uint8))
    gate += _WORD.take(logits[-1].view(np.uint8))
    order = np.argsort(gate, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=_GATES))]).tolist()
    # Rows of logits under the curvature, of errors and of logits, each as often as it came, by which the logits are multiplied.
    f, z = np.empty((9, len(order)), np.float32), np.empty((4, len(order)), np.float32)
    for k, some in enumerate(logits):
        np.multiply(some.take(order), np.float32(1 / _STEP), out=z[k])
    times = times.take(order)
    np.multiply(z, times, out=f[5:])
    sign = bits.take(order) * np.float32(2)
    sign -= 1
    out = np.zeros((_GATES, 25))
    for g, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        x = z[:, lo:hi]
        margin = x[0] * weights[g, 0]
        for k in range(1, 4):
            margin += x[k] * weights[g, k]
        margin *= sign[lo:hi]
        np.clip(margin, -16, 16, out=margin)
        error = np.exp(margin, out=margin)
        error += 1
        np.reciprocal(error, out=error)
        np.multiply(f[5:, lo:hi], error * (1 - error), out=f[:4, lo:hi])
        error *= sign[lo:hi]
        np.multiply(error, times[lo:hi], out=f[4, lo:hi])
        total = np.zeros((9, 4))
        # Short enough for one thread.
        for at in range(lo, hi, _PRODUCT):
            some = slice(at, min(hi, at + _PRODUCT))
            total += f[:, some] @ z[:, some].T
        out[g, _CURVES], out[g, _SLOPES], out[g, _SQUARES], out[g, _TIMES] = total[:4].ravel(), total[4], total[5:].diagonal(), times[lo:hi].sum(dtype=np.float64)
    return out


def stepped(weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """The weights after a step of Newton's method, and its gain in bits a decision; some decisions' worth holds them near START."""
    after, gain = np.empty_like(weights), 0.0
    for g in range(_GATES):
        curve = sums[g, _CURVES].reshape(4, 4) + CAUTION * np.eye(4)
        slope = sums[g, _SLOPES] - CAUTION * (weights[g] - START[g])
        step = np.linalg.solve(curve, slope)
        gain += slope @ step / 2
        after[g] = weights[g] + np.clip(step, -0.5, 0.5)
    return after.round(4), gain / max(1.0, float(sums[:, _TIMES].sum())) / np.log(2)


def _triples(batches):
    """How often each byte follows each two, in texts as they are coded: before (two bytes), next, n."""
    n = np.zeros(1 << 24, np.uint32)
    some = 0

    def send():
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            x = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x >> 8), pa.array(x & 255), pa.array(n[x].astype(np.int64))], names=["before", "next", "n"])

    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(0), _CHUNK):
            if some > 1 << 31:
                yield from send()
                n[:], some = 0, 0
            # Two zeros, each text and its end.
            b = np.zeros(len(data) + 3 * (hi - lo), np.int32)
            coded = np.ones(len(b), bool)
            first = offsets[:-1] + 3 * np.arange(hi - lo)
            coded[first] = coded[first + 1] = False
            ends = offsets[1:] + 3 * np.arange(hi - lo) + 2
            coded[ends] = False
            b[coded] = np.maximum(LOWER[data], 1)
            coded[ends] = True
            x = b[2:].copy()
            x |= b[1:-1] << 8
            x |= b[:-2] << 16
            np.add.at(n, x[coded[2:]], np.uint32(1))
            some += len(data) + hi - lo
    yield from send()


def _seen(train: DataFrame) -> tuple[int, int, Code]:
    """How many texts and bytes there are, and the code of all of them."""
    seen = materialise(train.select("text").mapInArrow(lean(_triples), "before long, next long, n long").groupBy("before", "next").agg(F.sum("n").alias("n")), "seen")
    n_texts, n = seen.agg(F.coalesce(F.sum(F.when(F.col("next") == 0, F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    last = np.zeros((256, 256), np.int64)
    by_last = seen.groupBy((F.col("before") % 256).alias("last"), "next").agg(F.sum("n").alias("n")).toPandas()  # 65,536 rows at most
    last[by_last["last"], by_last["next"]] = by_last["n"]
    top = seen.groupBy("before").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "before").limit(CODE_ROWS).select("before")
    often = np.array([r["before"] for r in top.collect()], np.int64)
    own = np.zeros((len(often), 256), np.int64)
    of = np.zeros(1 << 16, np.int64)
    of[often] = np.arange(len(often))
    some = seen.where(F.col("before").isin(often.tolist())).toPandas()  # 256 rows of 256 at most
    own[of[some["before"].to_numpy(np.int64)], some["next"].to_numpy(np.int64)] = some["n"]
    discard(seen)
    return n_texts, n - n_texts, code_of(last, often, own)


def _fit(lacking, log2_slots, weights, code):
    """By task: the sums of ``slopes``, in one row."""

    def scan(batches):
        total, tables = np.zeros((_GATES, 25)), _tables(lacking.value, log2_slots, 2)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), _ALIKE_CHUNK):
                total += slopes(tables, weights, code.value, data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["row"])

    return scan


def _fitted(train: DataFrame, lacking, log2_slots: tuple[int, ...], code) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """The initial weights that suit all training texts best, and the mean squares of logits, by gate; None without texts."""
    weights, gain, passes = np.array(START), 1.0, 0
    while gain > LEAST_GAIN and passes < MOST_PASSES:
        rows = train.select("text").mapInArrow(lean(_fit(lacking, log2_slots, weights.astype(np.float32), code)), "row array<double>")
        # A number for each place in a row, whatever the number of tasks.
        parts = rows.select(F.posexplode("row").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(_GATES * 25)
        for r in parts:
            sums[r["at"]] = r["x"]
        sums = sums.reshape(_GATES, 25)
        if not sums[:, _TIMES].any():
            return None, None
        weights, gain = stepped(weights, sums)
        passes += 1
    squares = (1 + sums[:, _SQUARES]) / (1 + sums[:, [_TIMES]])
    return weights.astype(np.float32), squares.round(4).astype(np.float32)


def _merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(counts[order], first) if len(h) else counts


def _times(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and how often each one comes."""
    h = np.sort(hashes)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def _learn(blocks: int, log2_slots: tuple[int, ...], code):
    """By task: word counts by block of hashes, and each table's bit counts by part."""

    def scan(batches):
        tables = [np.zeros(2 << log2, np.int32) for log2 in log2_slots]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, docs, read = 0, 0, False

        def send(h, c):
            at = np.searchsorted((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1).astype(np.uint64))
            some = [k for k in range(blocks) if at[k + 1] > at[k]]
            return _rows("word", some, [h[at[k] : at[k + 1]].tobytes() + c[at[k] : at[k + 1]].astype(np.int64).tobytes() for k in some])

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0), _ALIKE_CHUNK):
                read = True
                docs += hi - lo
                texts = Texts(data, offsets)
                held.append(_times(texts.words))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_merge(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield send(*held[0])
                        held, size = [], 0
                at, times = texts.kinds()
                for lo, _, byte, bits, slots in _decisions_of(texts, at, log2_slots, code.value):
                    n = times[lo : lo + _AT_ONCE].take(byte)
                    for t, s in zip(tables, slots):
                        s *= np.uint32(2)
                        s += bits.view(np.uint8)
                        np.add.at(t, s, n)
        if read:
            held.append((np.array([END_HASH]), np.array([docs], np.int64)))
            yield send(*_merge(*map(np.concatenate, zip(*held))))
            for k, t in enumerate(tables):
                parts = t.reshape(_PARTS, -1)
                yield _rows("bits", [k * _PARTS + p for p in range(_PARTS)], [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts])

    return scan


def _rows(kind: str, keys, payloads) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(keys, pa.int32()), pa.array([task_number()] * n, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "key", "task", "payload"])


def _add_some(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one block of words or one table part, in the form of a task's own rows."""
    kind, key = pdf["kind"].iloc[0], int(pdf["key"].iloc[0])
    if kind == "word":
        h, c = _words_of(pdf["payload"])
        payload = h.tobytes() + c.tobytes()
    else:
        total = _table_of(pdf["payload"])
        # Past 2**30 a pair of counts is halved until it fits: their ratio is what is used.
        over = np.maximum(1, -(-total.reshape(-1, 2).max(axis=1) // (1 << 30)))
        payload = pa.compress((total.reshape(-1, 2) // over[:, None]).astype(np.int32).tobytes(), "zstd", asbytes=True)
    return pd.DataFrame({"kind": [kind], "key": [key], "task": [pdf["task"].iloc[0]], "payload": [payload]})


def _words_of(payloads) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16) for p in payloads])
    c = np.concatenate([np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2) for p in payloads])
    return _merge(h, c)


def _table_of(payloads) -> np.ndarray:
    total = 0
    for p in payloads:
        total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.int32).astype(np.int64)
    return total


def _level_of(counts: np.ndarray) -> np.ndarray:
    """The number of the greatest step of _STEPS that a count reaches."""
    return np.searchsorted(_STEPS, counts, side="right") - 1


#: Counts at which the broadcast words may be cut off: each one to 64, then powers of two without end.
_STEPS = np.array([*range(65), *(1 << k for k in range(7, 63))], np.int64)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block of words (hashes and counts, with totals), or the logits of one table part, whole and without one 0 or one 1."""
    kind, key = pdf["kind"].iloc[0], int(pdf["key"].iloc[0])
    if kind == "word":
        h, c = _words_of(pdf["payload"])
        steps = np.bincount(_level_of(c), minlength=len(_STEPS)).tolist()
        return pd.DataFrame({"kind": [kind], "key": [key], "payload": [h.tobytes() + c.tobytes()], "lacking": [None], "distinct": [len(h)], "total": [int(c.sum())], "steps": [steps]})
    n = _table_of(pdf["payload"]).reshape(-1, 2).astype(float)
    logits = lambda zeros, ones: np.clip(np.rint(_STEP * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)
    fewer = np.maximum(n - 1, 0)
    lacking = np.stack([logits(fewer[:, 0], n[:, 1]), logits(n[:, 0], fewer[:, 1])], axis=1)
    return pd.DataFrame({"kind": [kind], "key": [key], "payload": [_packed(logits(n[:, 0], n[:, 1]))], "lacking": [_packed(lacking)], "distinct": [0], "total": [0], "steps": [[]]})


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _parts(learnt: DataFrame, column: str, n: int) -> list[list[bytes]]:
    """The packed parts of ``n`` tables that ``column`` has: what the driver and a broadcast hold of them."""
    parts = [[b""] * _PARTS for _ in range(n)]
    for r in learnt.where("kind = 'bits'").select("key", column).collect():
        parts[r["key"] // _PARTS][r["key"] % _PARTS] = bytes(r[column])
    return parts


def _tables(parts: list[list[bytes]], log2_slots: tuple[int, ...], width: int = 1) -> list[np.ndarray]:
    """The tables, ``width`` bytes a slot; zeros for parts that nobody counted."""
    tables = [np.zeros((_PARTS, (width << log2) // _PARTS), np.int8) for log2 in log2_slots]
    unpack = zstandard.ZstdDecompressor().decompress
    for table, some in zip(tables, parts):
        for k, part in enumerate(some):
            if part:
                table[k] = np.frombuffer(unpack(part), np.int8)
    return [t.reshape(-1) for t in tables]


class Lexicon:
    """Counts of words by hash, in open addressing over arrays."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.log2 = max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
        self.keys = np.zeros(1 << self.log2, np.uint64)
        self.counts = np.zeros(1 << self.log2, np.int64)
        at, todo = self._home(hashes), np.arange(len(hashes))
        taken = np.zeros(1 << self.log2, bool)
        while len(todo):
            free = todo[~taken[at[todo]]]
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.keys[at[now]], self.counts[at[now]] = hashes[now], counts[now]
            taken[at[now]] = True
            todo = np.setdiff1d(todo, now, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.log2) - 1)
        self.taken = taken

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.log2)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's count, 0 if it isn't here."""
        out = np.zeros(len(hashes), np.int64)
        at, todo = self._home(hashes), np.arange(len(hashes))
        while len(todo):
            spot = at[todo]
            hit = (self.keys[spot] == hashes[todo]) & self.taken[spot]
            out[todo[hit]] = self.counts[spot[hit]]
            on = ~hit & self.taken[spot]
            todo = todo[on]
            at[todo] = (at[todo] + 1) & ((1 << self.log2) - 1)
        return out


def _score(model, whole: bool):
    """By document: bits, tokens, and the base's parts from broadcast words; rare words if not ``whole``."""

    def scan(batches):
        mixer, lexicon, end = model.value
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("n_bytes", "bits", "n_tokens", "known", "logs")}
            rare_words, rare_times, rare_at = [], [], [0]
            for _, _, data, offsets in chunks(batch.column(1), _SCORE_CHUNK):
                texts = Texts(data, offsets)
                bits = mixer.bits(Told(texts, mixer))
                doc, h = texts.text().take(texts.word_at), texts.words
                n = np.bincount(doc, minlength=texts.n)
                c = lexicon.find(h)
                sure = c > 0 if not whole else np.ones(len(c), bool)
                columns["bits"] += bits.tolist()
                columns["n_bytes"] += np.diff(offsets).tolist()
                columns["n_tokens"] += (n + 1).tolist()
                columns["known"] += (np.bincount(doc, c > 0, minlength=texts.n).astype(np.int64) + int(end > 0)).tolist()
                columns["logs"] += (np.bincount(doc[sure], np.log10(c[sure] + 0.5), minlength=texts.n) + np.log10(end + 0.5)).tolist()
                if not whole:
                    pairs = np.stack([doc[~sure].astype(np.uint64), h[~sure]], axis=1)
                    pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
                    at = np.searchsorted(pairs[:, 0], np.arange(texts.n + 1).astype(np.uint64))
                    rare_words += signed(np.ascontiguousarray(pairs[:, 1])).tolist()
                    rare_times += times.tolist()
                    rare_at += (at[1:] + rare_at[-1] - at[0]).tolist()
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.int64()), pa.array(rare_times, pa.int64())], names=["word", "times"])
            rare = pa.ListArray.from_arrays(pa.array(rare_at if not whole else [0] * (batch.num_rows + 1), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(columns["n_bytes"], pa.int64()), pa.array(columns["bits"], pa.float64()), pa.array(columns["n_tokens"], pa.int64()), pa.array(columns["known"], pa.int64()), pa.array(columns["logs"], pa.float64()), batch.column(3), rare],
                names=["doc_id", "held_out", "n_bytes", "bits", "n_tokens", "known", "logs", "text_hash", "rare"],
            )

    return scan


def score_texts(docs: DataFrame, *, head_words: int = HEAD_WORDS, most_log2: int = MOST_LOG2, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log-probabilities of every whole text under the mixing model and under a unigram base.

    Learns from rows whose crc32(id) mod 5 isn't 1, and scores all. The code, the counts and the initial weights
    are those of all rows learnt from: one pass for the code, one for the counts, and one or more for the weights,
    which are fitted to each decision as the counts without it tell it. Returns doc_id, held_out, n_tokens
    (words and one end), n_known (tokens that training texts have), train_tokens, base_score (log10 of the
    add-half unigram probability), score (log10 of the model's probability of the lower-cased bytes and
    an end), n_bytes, bits_per_byte (over bytes plus the end).

    A null text is empty: one token, its end. Null ids aren't held out. Repeated rows are scored, and
    learnt from, each. A very long text is scored whole, in one task, in memory that grows with it. Without
    training rows every count is 0 and the tables are indifferent. An empty table gives no rows; columns
    other than the two, whatever their names, aren't read. A NUL byte is scored as byte 1. At most
    ``head_words`` counts are broadcast; tables have up to 2**``most_log2`` slots.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out_by(F.col(id_col), 5, 1).alias("held_out"))
    train = source.where(~F.col("held_out"))
    n_train, n_bytes, code = _seen(train)
    code = spark.sparkContext.broadcast(code)
    blocks = int(max(8, min(4096, n_bytes // (1 << 25))))
    log2_slots = slots_for(n_bytes, most_log2)
    learnt = train.select("text").mapInArrow(lean(_learn(blocks, log2_slots, code)), _SUMS)
    learnt = tree_add(learnt, ["kind", "key"], _SUMS, _add_some, source._jdf.rdd().getNumPartitions(), fan_in)
    learnt = materialise(learnt.groupBy("kind", "key").applyInPandas(lean_group(_add), "kind string, key int, payload binary, lacking binary, distinct long, total long, steps array<long>"), "learnt")

    word_parts = learnt.where("kind = 'word'")
    distinct, total = word_parts.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    steps = word_parts.select(F.posexplode("steps").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n"))
    at = np.zeros(len(_STEPS), np.int64)
    for r in steps.collect():
        at[r["step"]] = r["n"]
    # The least count whose words, and all more frequent ones, are few enough to broadcast.
    fits = np.flatnonzero(np.cumsum(at[::-1])[::-1] <= head_words)
    least = int(_STEPS[max(1, fits[0])]) if len(fits) else 1 << 62
    whole = least == 1

    def frequent(frames):
        for pdf in frames:
            out = []
            for p in pdf["payload"]:
                h, c = np.frombuffer(p, np.uint64, len(p) // 16), np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2)
                keep = c >= least
                out.append(h[keep].tobytes() + c[keep].tobytes())
            yield pd.DataFrame({"payload": out})

    lacking = spark.sparkContext.broadcast(_parts(learnt, "lacking", len(log2_slots)))
    weights, squares = _fitted(train, lacking, log2_slots, code)
    lacking.unpersist()
    del lacking
    release()
    head = [r["payload"] for r in word_parts.select("payload").mapInPandas(frequent, "payload binary").collect()]
    lexicon = Lexicon(*_words_of(head)) if head else Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    del head
    release()
    mixer = Mixer(_tables(_parts(learnt, "payload", len(log2_slots)), log2_slots), weights, squares, code.value)
    model = spark.sparkContext.broadcast((mixer, lexicon, n_train))

    schema = "doc_id long, held_out boolean, n_bytes long, bits double, n_tokens long, known long, logs double, text_hash long, rare array<struct<word:long,times:long>>"
    hashed = source.select("doc_id", "text", "held_out", F.xxhash64("text").alias("text_hash"))
    scored = hashed.mapInArrow(lean(_score(model, whole)), schema)
    if not whole:
        scored = materialise(scored, "scored")
        counts = word_parts.select("payload").mapInPandas(_unpack, "word long, c long").where(F.col("c") < least)
        key = ["doc_id", "text_hash", "n_bytes"]
        each = scored.select(*key, F.explode("rare").alias("r")).select(*key, "r.word", "r.times")
        found = each.join(counts, "word", "left").groupBy(*key).agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
        # Equal rows share a key, so their rare words were added up once for each.
        copies = scored.groupBy(*key).count()
        found = found.join(copies, [found[k].eqNullSafe(copies[k]) for k in key]).select(*[found[k].alias(f"f_{k}") for k in key], (F.col("more") / F.col("count")).alias("more"), (F.col("also") / F.col("count")).cast("long").alias("also"))
        scored = scored.join(found, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key], "left")
        scored = scored.withColumn("logs", F.col("logs") + F.coalesce("more", F.lit(0.0))).withColumn("known", F.col("known") + F.coalesce("also", F.lit(0)))
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        "n_bytes",
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _unpack(frames):
    for pdf in frames:
        for p in pdf["payload"]:
            yield pd.DataFrame({"word": np.frombuffer(p, np.int64, len(p) // 16), "c": np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2)})
