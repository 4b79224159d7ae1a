"""Exact token counts of all prefixes of a text, by dynamic programming.

For byte-pair encoding the last token of a prefix's encoding decides everything:
the encoding of ``text[:i]`` is that of ``text[:j]`` followed by one token, and among
the tokens ending at ``i`` exactly one is compatible with the last token at ``j``
(the pair encodes as itself). So ``count[i] = count[j] + 1``. The counts are stored as
one signed byte per character, the change against the prefix one character shorter;
running sums of them answer every truncation and budget question without encoding again.

Pieces never hold a space mark after another character, so a text falls into units,
each a run of space marks and the characters up to the next, which never share a token.
Repeated units take their stored row from a cache of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SPACE = "▁"
#: Entries a worker keeps of each cache before it starts anew.
CACHE_ENTRIES = 300_000


class PrefixCounter:
    """Prefix counts as the sentencepiece library gives them for a BPE model with byte
    fallback, identity normalisation and a dummy space in front."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(self.library.get_piece_size())
        plain = [i for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i)
                                        or self.library.is_byte(i) or self.library.is_unused(i))]
        pieces = {self.library.id_to_piece(i): self.library.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that hold a space mark after other characters are not supported")
        self.scores = {p: s for p, s in pieces.items() if len(p) > 1 and p.strip(SPACE)}
        self.single = {p for p in pieces if len(p) == 1}
        whole = sorted(self.single | {p for p in self.scores if self._encode(p) == [p]})
        self.names = ["", *whole]
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(whole, 1):
            self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()
        self.mark = self.names.index(SPACE)
        # Numbers of a pair of tokens, put together, that do or don't encode as themselves.
        self.fitting: set[int] = set()
        self.clashing: set[int] = set()
        # Changes by word, and those of the cache before.
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs = [0, 1] + [len(self.library.encode(" " * (n - 1))) for n in range(2, 257)]
        if any(self.runs[n] != self.runs[n - 16] + 1 for n in range(64, 257)):
            raise ValueError("runs of spaces do not follow the expected period")

    def _encode(self, text: str) -> list[str]:
        """Merge the best pair, the leftmost on ties, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, place = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, k
            if best is None:
                break
            parts[place:place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def _run(self, length: int) -> int:
        """Tokens of a run of space marks."""
        if length < 256:
            return self.runs[length]
        periods = (length - 240) // 16
        return self.runs[length - 16 * periods] + periods

    def _fits(self, pair: int) -> bool:
        """Whether two tokens next to each other encode as themselves; remembered."""
        first, second = self.names[pair >> 20], self.names[pair & 0xFFFFF]
        fits = self._encode(first + second) == [first, second]
        known = self.fitting if fits else self.clashing
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        known.add(pair)
        return fits

    def _word(self, text: str) -> tuple[list[int], list[int]]:
        """Counts of all prefixes of a unit with at most one space mark, and the number
        of the token that ends each (0 for a character written as bytes)."""
        last, counts = [0], [0]
        fitting, clashing = self.fitting, self.clashing
        done = 0
        for at, (length, token) in self.automaton.iter(text):
            if at < done:
                continue
            while done < at:
                # No token ends here: the character is written as bytes.
                done += 1
                last.append(0)
                counts.append(counts[-1] + len(text[done - 1].encode()))
            start = at + 1 - length
            if before := last[start]:
                pair = before << 20 | token
                if pair not in fitting and (pair in clashing or not self._fits(pair)):
                    continue
            last.append(token)
            counts.append(counts[start] + 1)
            done = at + 1
        for character in text[done:]:
            last.append(0)
            counts.append(counts[-1] + len(character.encode()))
        return counts, last

    def unit(self, text: str) -> bytes:
        """Changes of the count for each character of a unit, as signed bytes."""
        marks = len(text) - len(text.lstrip(SPACE))
        if marks <= 1:
            counts = self._word(text)[0]
        else:
            word, last = self._word(text[marks - 1:])
            counts = [self._run(n) for n in range(marks + 1)]
            # The last mark joins the others where it is a token of its own.
            lone = [0, int(last[1] == self.mark)]
            for k in range(2, len(word)):
                token = self.names[last[k]] or text[marks - 2 + k]
                lone.append(lone[k - len(token)] if len(token) < k else 0)
                counts.append(word[k] - lone[k] + self._run(marks - 1 + lone[k]))
        return bytes([(now - before) & 0xFF for before, now in itertools.pairwise(counts)])

    def _missing(self, word: str) -> bytes:
        if len(self.units) >= CACHE_ENTRIES:
            self.older, self.units = self.units, {}
        found = self.units[word] = self.older.get(word) or self.unit(SPACE + word)
        return found

    def deltas(self, text: str) -> bytes:
        """One signed byte per character of the text. The dummy space is part of the first."""
        if not text:
            return b""
        # A unit starts at every mark that follows another character.
        words = text.replace(" ", SPACE).split(SPACE)
        if "" not in words:
            get, missing = self.units.get, self._missing
            rows = b"".join([get(word) or missing(word) for word in words])
        else:
            rows, marks = [], 0
            for word in words:
                marks += 1
                if word:
                    single = self.units.get(word) or self._missing(word) if marks == 1 else b""
                    rows.append(single or self.unit(SPACE * marks + word))
                    marks = 0
            if marks:
                rows.append(self.unit(SPACE * marks))
            rows = b"".join(rows)
        first = int(np.frombuffer(rows[:2], np.int8).sum(dtype=np.int64))
        return bytes([first & 0xFF]) + rows[2:]


_counters: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    """The counter of this worker process."""
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(model_path)
    return _counters[model_path]


def _with_deltas(docs: DataFrame, id_col: str, text_col: str, model_path: str, columns: list[T.StructField], row) -> DataFrame:
    """Rows (id, *row(text, changes)) for every document."""
    schema = T.StructType([docs.schema[id_col], *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = [row(text or "", own.deltas(text or "")) for text in part.column(1).to_pylist()]
                kinds = (pa.int64(), pa.binary() if columns[1].dataType == T.BinaryType() else pa.int64())
                arrays = [part.column(0)] + [pa.array(values, kind)
                                             for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def token_counts(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, without added special tokens.

    A null text counts as empty, which has no tokens. Ids may repeat or be null: one
    row comes back per row given."""
    def row(text: str, deltas: bytes):
        return len(text.encode()), int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))
    return _with_deltas(docs, id_col, text_col, model_path,
                        [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], row)


def prefix_table(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_tokens, deltas): ``deltas`` holds a signed byte per character of the text, whose
    sum over the first n characters is the exact token count of that prefix."""
    def row(text: str, deltas: bytes):
        return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64)), deltas
    return _with_deltas(docs, id_col, text_col, model_path,
                        [T.StructField("n_tokens", T.LongType()), T.StructField("deltas", T.BinaryType())], row)


def truncation_points(prefixes: DataFrame, budget: int, id_col="doc_id") -> DataFrame:
    """(id, n_chars, n_tokens): the longest prefix whose exact count stays within the
    budget, read from a prefix table. Empty texts give 0 and 0."""
    schema = T.StructType([prefixes.schema[id_col]]).add("n_chars", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tokens = [], []
            for deltas in batch.column(1).to_pylist():
                counts = np.concatenate([[0], np.cumsum(np.frombuffer(deltas or b"", np.int8), dtype=np.int64)])
                place = int(np.flatnonzero(counts <= budget)[-1])
                chars.append(place)
                tokens.append(int(counts[place]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())],
                names=schema.names)

    return prefixes.select(id_col, "deltas").mapInArrow(run, schema)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
