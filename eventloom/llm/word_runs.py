"""Maximal periodic runs of words, found by internal pattern matching.

The words of many documents stand one after another, parted by marks that occur once, so that no
match crosses them. Prefix doubling ranks all stretches of 1, 2, 4, ... words; the last ranking is
a suffix array in which the stretches equal to a block of 2**k words form one interval. A wavelet
tree over the array answers range successor queries: where in a window does the block occur next?

A run of period q and at least max(24, 3q) words holds a whole aligned ("dyadic") block that occurs
again q words on: of 8 words for q < 16, else of the largest power of two not above q. The occurrences
of a block in a window not more than twice as long are an arithmetic progression, so that the first
two and their number give them all. Each is a candidate period; extending it to both sides, by the
ranks, gives the run, and of equal stretches the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Bytes of text whose words are looked at together, or one longer text. A text needs about
#: 200 bytes of memory a word.
SLICE_BYTES = 1 << 20

# What counts as a run.
LEAST_WORDS = 24
LEAST_PERIODS = 3
# The first block is 2**3 words: a run of 24 words with a period below 8 holds one whole and again.
FIRST_LEVEL = 3


class Runs(NamedTuple):
    start: np.ndarray
    stop: np.ndarray
    period: np.ndarray


class WaveletTree:
    """Counts and order statistics over ranges of an array of whole numbers below ``2**bits``.

    One level per bit, from the highest: the numbers with a 0 there come first in the next level,
    each part in its old order. All queries of a batch go down the levels together."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.zeros = []  # per level: how many of the first k numbers have a 0
        for level in range(bits - 1, -1, -1):
            is_zero = (values >> level) & 1 == 0
            counts = np.zeros(len(values) + 1, np.int32)
            np.cumsum(is_zero, out=counts[1:])
            self.zeros.append(counts)
            values = np.concatenate([values[is_zero], values[~is_zero]])

    def count_below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Numbers below ``limit`` among those from ``left`` to before ``right``."""
        total = np.zeros(len(left), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            left_zeros, right_zeros = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = (limit >> level) & 1 == 1
            total += np.where(one, right_zeros - left_zeros, 0)
            left = np.where(one, left - left_zeros + zeros[-1], left_zeros)
            right = np.where(one, right - right_zeros + zeros[-1], right_zeros)
        return total

    def nth_smallest(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest number of each range, from 0."""
        value = np.zeros(len(left), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            left_zeros, right_zeros = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = n >= right_zeros - left_zeros
            value += np.where(one, 1 << level, 0)
            n = np.where(one, n - (right_zeros - left_zeros), n)
            left = np.where(one, left - left_zeros + zeros[-1], left_zeros)
            right = np.where(one, right - right_zeros + zeros[-1], right_zeros)
        return value


class Ranks:
    """Rankings of the stretches of 1, 2, 4, ... words that start at each place, as the number of
    smaller ones, so that equal stretches have equal ranks. The last entry stands for the end.
    ``order`` is the suffix array, as far as ``levels`` tell suffixes apart."""

    def __init__(self, words: np.ndarray, levels: int):
        self.levels = []
        keys = words.astype(np.int64)
        for level in range(levels + 1):
            self.order = np.argsort(keys)
            line = keys[self.order]
            new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            smaller = np.repeat(new, np.diff(np.append(new, len(line))))
            rank = np.full(len(words) + 1, -1, np.int32)
            rank[self.order] = smaller
            self.levels.append(rank)
            if len(new) == len(words):  # no stretch this long occurs twice
                break
            step = 1 << level
            ahead = np.full(len(words), -1, np.int64)
            ahead[:max(0, len(words) - step)] = rank[step:-1]
            keys = rank[:-1].astype(np.int64) * (len(words) + 1) + ahead + 1

    def sizes(self, level: int) -> np.ndarray:
        """By rank: how many stretches have it."""
        rank = self.levels[level][:-1]
        return np.bincount(rank, minlength=len(rank))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from places ``a`` and ``b`` (``a`` < ``b``) on."""
        length, end = np.zeros(len(a), np.int64), len(self.levels[0]) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            active = np.arange(len(a))
            while len(active):
                i, j = a[active] + length[active], b[active] + length[active]
                active = active[rank[np.minimum(i, end)] == rank[np.minimum(j, end)]]
                length[active] += 1 << level
                if level < len(self.levels) - 1:
                    break
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before places ``a`` and ``b`` (``a`` < ``b``)."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            active = np.arange(len(a))
            while len(active):
                i, j = a[active] - length[active] - step, b[active] - length[active] - step
                active = active[(i >= 0) & (rank[np.maximum(i, 0)] == rank[np.maximum(j, 0)])]
                length[active] += step
                if level < len(self.levels) - 1:
                    break
        return length


def occurrences_ahead(tree: WaveletTree, left, right, places, first: int, last: int):
    """(place, distance) of all occurrences, ``first`` to ``last`` words after each place, of the block
    whose interval is given. The window is at most twice as long as the block, so they are
    a progression."""
    end = len(tree.zeros[0]) - 1
    before = tree.count_below(left, right, np.minimum(places + first, end))
    count = tree.count_below(left, right, np.minimum(places + last + 1, end)) - before
    some = np.flatnonzero(count)
    left, right, places, before, count = (v[some] for v in (left, right, places, before, count))
    one = tree.nth_smallest(left, right, before)
    two = tree.nth_smallest(left, right, before + np.minimum(count - 1, 1))
    at = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return places[at], (one[at] - places[at]) + step * (two - one)[at]


def find_runs(words: np.ndarray, longest: int) -> Runs:
    """The runs of a sequence of word numbers, of which no matching stretch is longer than
    ``longest``; by start, then period."""
    none = np.zeros(0, np.int64)
    if longest < LEAST_WORDS:
        return Runs(none, none, none)
    top = max(FIRST_LEVEL, (longest // LEAST_PERIODS).bit_length() - 1)
    ranks = Ranks(words, top)
    tree = None
    found = []
    for level in range(FIRST_LEVEL, len(ranks.levels)):
        block = 1 << level
        places = np.arange(0, len(words) - block + 1, block)
        left = ranks.levels[level][places].astype(np.int64)
        size = ranks.sizes(level)[left]
        places, left, size = (v[size > 1] for v in (places, left, size))
        if not len(places):
            continue
        if tree is None:
            tree = WaveletTree(ranks.order, len(words).bit_length())
        windows = [(1, block), (block + 1, 2 * block - 1)] if level == FIRST_LEVEL else [(block, 2 * block - 1)]
        for first, last in windows:
            at, period = occurrences_ahead(tree, left, left + size, places, first, last)
            start = at - ranks.backward(at, at + period)
            stop = at + period + ranks.forward(at, at + period)
            long = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.column_stack([start[long], stop[long], period[long]]))
    if not found:
        return Runs(none, none, none)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Runs of one stretch have periods that are multiples of the smallest.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1], rows[:, 2])


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Per list of words its runs as rows (start, length, period)."""
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = pa.array([word for words in texts for word in words], pa.binary()).dictionary_encode()
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.empty(int(sizes.sum()) + len(texts), np.int64)
    is_mark = np.zeros(len(joined), bool)
    is_mark[starts + sizes] = True
    joined[~is_mark] = flat.indices.to_numpy(zero_copy_only=False)
    joined[is_mark] = len(flat.dictionary) + np.arange(len(texts))
    runs = find_runs(joined, int(sizes.max(initial=0)))
    text = np.searchsorted(starts, runs.start, side="right") - 1
    rows = np.column_stack([runs.start - starts[text], runs.stop - runs.start, runs.period])
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words left when every run keeps its first period only, parted by single spaces. A word
    goes if any run holds it after the run's first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[k] for k in kept])


RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    begin, held, size = 0, [], 0
    for text in column:
        data = (text.as_py() or "").encode()
        # Of ASCII, bytes.split() parts words at space and U+0009 to U+000D, and nowhere else.
        held.append(data.split())
        size += len(data)
        if size >= most:
            yield begin, held
            begin, held, size = begin + len(held), [], 0
    if held:
        yield begin, held


def periodic_runs(docs: DataFrame, id_col="doc_id", text_col="text", slice_bytes=SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, whole texts.

    ``runs``: (start, length, period) in words from 0, of all maximal runs of at least 24 words and
    three periods, by start, then period. ``collapsed``: the text with each run cut down to its
    first period, words parted by single spaces. A null text has no words and an empty
    ``collapsed``. Rows that repeat, and null ids, have rows of their own."""
    source = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    schema = T.StructType([source.schema["doc_id"]]).add("n_words", "long").add(
        "runs", T.ArrayType(RUN, False)).add("collapsed", "string")
    item = pa.struct([pa.field(name, pa.int64(), False) for name in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _slices(batch.column(1), slice_bytes):
                runs = runs_of_texts(texts)
                rows = np.concatenate(runs)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(item)))
                listed = listed.cast(pa.list_(pa.field("element", item, False)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array([len(w) for w in texts], pa.int64()), listed,
                     pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs)], pa.string())],
                    names=schema.names)

    return source.mapInArrow(run, schema)
