"""Words and their hashes for whole Arrow columns of texts, on numpy arrays.

Everything here works on one slice of consecutive rows at a time: the rows' UTF-8
bytes one after another, and the offsets where rows begin. A slice holds about
``SLICE_BYTES``, or one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a public finalizer: two multiplications, three shifts)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
PLACE_VALUES = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside words. Every byte of a character beyond ASCII is 0x80 or more.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < count:
        size = max(count, SLICE_BYTES + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for a string column; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    rows = len(column)
    if rows == 0:
        return
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``span_hashes`` takes those of spans from them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(starts, ends, first): byte spans of the words, and for every row the number of
    its first word, with the number of all words at the end. No word crosses rows."""
    inside = inside[data]
    size = len(data)
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < size]] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """(values, first): hashes of the shingles of every row, in order and with repeats.
    A row of fewer words than ``width``, but not none, has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_BLANK)
    words = span_hashes(prefix_hashes(data), starts, ends)
    counts = np.diff(first)
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per_row)])
    values = np.zeros(out_first[-1], np.uint64)
    if len(words) >= width:
        full = words[:len(words) - width + 1] * PLACE_VALUES[0]
        for k in range(1, width):
            full = full + words[k:len(words) - width + 1 + k] * PLACE_VALUES[k]
        row_of = np.repeat(np.arange(len(counts)), counts)[:len(full)]
        fits = np.flatnonzero(np.arange(len(full)) + width <= first[row_of + 1])
        place = fits - first[row_of[fits]] + out_first[row_of[fits]]
        values[place] = full[fits]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[row]:first[row + 1]]
        with np.errstate(over="ignore"):
            values[out_first[row]] = (own * PLACE_VALUES[:len(own)]).sum(dtype=np.uint64) + np.uint64(7 * len(own))
    return mix(values), out_first
