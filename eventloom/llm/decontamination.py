"""Benchmark decontamination by multi-pattern search with block shifts (Wu and Manber's).

Patterns are windows of benchmark words, texts are words of documents, blocks are pairs of
words. A table over hashed blocks gives how far the search may jump when a block ends at its
position: the least distance from an occurrence of the block to the end of a pattern, or the
full distance for blocks in none. Where the shift is 0 the hash of the pattern's whole suffix
selects candidates, whose words are then compared directly. All segments of a batch of texts
step together, so that each step is a few array operations.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.llm.byte_words import (
    LETTERS_DIGITS, LOWER, PLACE_VALUES, mix, prefix_hashes, span_hashes, text_slices, word_spans)
from eventloom.llm.prefix_sums import running_totals
from eventloom.llm.storage import stored

WINDOW = 13
#: Words of a document searched in one segment; segments overlap by a window less a word.
SEGMENT = 400
#: Benchmark words whose tables one search holds; larger benchmarks are searched in parts.
WORDS_PER_PART = 2_000_000
TABLE_BITS = 20
#: The words of ``normal_words`` as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(texts: pa.Array):
    """Per slice: (first row, last row + 1, lower-cased bytes, starts, ends, first, hashes)."""
    for begin, end, data, offsets in text_slices(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, LETTERS_DIGITS)
        yield begin, end, data, starts, ends, first, span_hashes(prefix_hashes(data), starts, ends)


def _suffix(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that end at each position."""
    total = np.zeros(len(at), np.uint64)
    for k in range(length):
        total += words[at - k] * PLACE_VALUES[k]
    return mix(total)


class PatternTables:
    """Shift table and suffix buckets of all windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, tuple[np.ndarray, list[int]]]):
        self.length, self.block = length, min(2, length)
        words = np.array([w for w, _ in windows.values()], np.uint64)
        self.far = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.far, np.uint8)
        for end in range(self.block - 1, length):
            slots = self._slot(words.ravel(), np.arange(len(words)) * length + end)
            np.minimum.at(self.shift, slots, np.uint8(length - 1 - end))
        suffixes = _suffix(words.ravel(), np.arange(len(words)) * length + length - 1, length)
        order = np.argsort(suffixes, kind="stable")
        self.suffixes = suffixes[order]
        self.buckets: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for value, (text, (_, items)) in zip(suffixes.tolist(), windows.items(), strict=True):
            self.buckets[value].append((text, items))

    def _slot(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_suffix(words, at, self.block) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, suffix hashes) of words that may end an occurrence, within rows given by ``first``."""
        rows = np.flatnonzero(np.diff(first) >= self.length)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pieces = -(-(np.diff(first)[rows] - self.length + 1) // SEGMENT)
        which = np.repeat(rows, pieces)
        number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[which] + number * SEGMENT + self.length - 1
        stop = np.minimum(at + SEGMENT, first[which + 1])
        found = []
        while len(at):
            shift = self.shift[self._slot(words, at)].astype(np.int64)
            hits = at[shift == 0]
            if len(hits):
                found.append(hits)
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.concatenate(found)
        suffixes = _suffix(words, at, self.length)
        place = np.minimum(np.searchsorted(self.suffixes, suffixes), len(self.suffixes) - 1)
        likely = self.suffixes[place] == suffixes
        return at[likely], suffixes[likely]


class BenchmarkSearch:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        by_length: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = defaultdict(dict)
        for begin, end, data, starts, ends, first, words in normal_words(pa.array([t for _, t in items], pa.string())):
            for row in range(begin, end):
                low, high = first[row - begin], first[row - begin + 1]
                length = min(window, high - low)
                for at in range(low, high - length + 1 if length else low):
                    text = b" ".join(data[starts[k]:ends[k]].tobytes() for k in range(at, at + length))
                    own = by_length[length].setdefault(text, (words[at:at + length], []))[1]
                    if not own or own[-1] != row:
                        own.append(row)
        self.tables = [PatternTables(n, windows) for n, windows in sorted(by_length.items())]

    def occurrences(self, data, starts, ends, first, words):
        """Lists of (row, first word, last word + 1, items), words numbered within the row."""
        found = []
        for table in self.tables:
            positions, suffixes = table.candidates(words, first)
            rows = np.searchsorted(first, positions, side="right") - 1
            for at, suffix, row in zip(positions.tolist(), suffixes.tolist(), rows.tolist(), strict=True):
                low = at - table.length + 1
                text = b" ".join(data[starts[k]:ends[k]].tobytes() for k in range(low, at + 1))
                for pattern, items in table.buckets[suffix]:
                    if pattern == text:
                        found.append((row, low - int(first[row]), at + 1 - int(first[row]), items))
        return found


def _searched(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """Add to the rows (…, text, n_words, hits, items) what one part of the benchmark finds."""
    held: list[BenchmarkSearch] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(BenchmarkSearch(items, window))
        search = held[0]
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            hits: list[list[int]] = batch.column(3).to_pylist()
            names: list[list[str]] = batch.column(4).to_pylist()
            for begin, _, data, starts, ends, first, words in normal_words(batch.column(1)):
                counts[begin:begin + len(first) - 1] = np.diff(first)
                for row, low, high, own in search.occurrences(data, starts, ends, first, words):
                    hits[begin + row].extend((low, high))
                    names[begin + row].extend(search.names[k] for k in own)
            names = [sorted(set(own)) for own in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(names, pa.list_(pa.string()))], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _in_parts(items: DataFrame, window: int, words_per_part: int) -> tuple[DataFrame, int]:
    """(item, words, part) of distinct items and the number of parts, none of which holds more than about
    twice ``words_per_part`` words (or two windows).

    Longer items are cut into stretches that share a window less a word, so that each of their
    windows is in exactly one stretch; all stretches are at least a window long."""
    stretch = max(words_per_part, 2 * window)
    items = items.distinct().withColumn("size", F.regexp_count("words", F.lit(WORD)).cast("long"))
    total = items.agg(F.sum("size")).first()[0] or 0
    if total <= words_per_part:
        return items.select("item", "words", F.lit(0).alias("part")), 1
    step = stretch - window + 1
    long = items.filter(F.col("size") > stretch).select(
        "item", F.regexp_extract_all("words", F.lit(f"({WORD})"), F.lit(1)).alias("list"), "size")
    cut = long.withColumn("at", F.explode(F.sequence(
        F.lit(1).cast("long"), F.col("size") - (window - 1), F.lit(step).cast("long")))).select(
        "item", F.array_join(F.slice("list", F.col("at").cast("int"), F.lit(stretch)), " ").alias("words"),
        F.least(F.lit(stretch).cast("long"), F.col("size") - F.col("at") + 1).alias("size"))
    pieces = items.filter(F.col("size") <= stretch).unionByName(cut.distinct())
    pieces = pieces.withColumn("place", F.pmod(F.xxhash64("item", "words"), F.lit(1 << 48)))
    placed = running_totals(stored(pieces, "decontamination-items"), [], "place", ["item", "words"], "size", "before")
    placed = placed.select("item", "words", F.floor(F.col("before") / words_per_part).alias("part"))
    placed = stored(placed, "decontamination-parts")
    return placed, placed.agg(F.max("part")).first()[0] + 1


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                   item_text_col="text", window: int = WINDOW, words_per_part: int = WORDS_PER_PART) -> DataFrame:
    """(id, text, n_words, hits, items) of every document.

    ``hits``: word bounds (first, last + 1) of the occurrences, flat, in the order found; ``items``: sorted
    distinct ids, as strings, of the items with an occurring window. Items without words have no
    window, documents without text no words; items with a null id are left out; items that
    share an id count as one. Rows of documents that repeat are searched each."""
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words"))
    items, parts = _in_parts(items, window, words_per_part)
    frame = docs.select(
        F.col(id_col), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        # A part of the benchmark is bounded by words_per_part.
        rows = sorted((r.item, r.words) for r in items.filter(F.col("part") == part).collect())
        frame = _searched(frame, rows, window)
        if part + 1 < parts:
            frame = stored(frame, "decontamination")
    return frame


def contamination(hits: DataFrame, id_col="doc_id", keep_text=False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document, and its text if
    asked for; a document is contaminated if 20 times its hit words are at least its words."""
    schema = T.StructType([hits.schema[id_col]] + [hits.schema["text"]] * keep_text).add("n_words", "long").add(
        "n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    kept = 1 + keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digests = [], [], []
            totals, hits, names = (batch.column(kept + k).to_pylist() for k in range(3))
            for n, bounds, items in zip(totals, hits, names, strict=True):
                cover = np.zeros(n + 1, np.int64) if bounds else np.zeros(1, np.int64)
                np.add.at(cover, bounds[::2], 1)
                np.add.at(cover, bounds[1::2], -1)
                n_hit.append(int((np.cumsum(cover[:-1]) > 0).sum()))
                n_items.append(len(items))
                digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            flags = [h > 0 and 20 * h >= n for h, n in zip(n_hit, totals, strict=True)]
            arrays = [*batch.columns[:kept], pa.array(totals, pa.int64()), pa.array(n_hit, pa.int64()),
                      pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array(flags, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    columns = [id_col] + ["text"] * keep_text + ["n_words", "hits", "items"]
    return hits.select(*columns).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text_col).alias("text"))
    judged = contamination(benchmark_hits(packed, benchmark, "row", "text"), "row", keep_text=True)
    kept = judged.filter(~F.col("contaminated"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
