"""Document quality learned from preference pairs (Bradley and Terry's model).

A document's merit is a linear function of features of its whole text; that document a
is preferred to b has probability sigmoid(merit(a) - merit(b)). The weights minimise the
logistic loss on feature differences of pairs of a good and a bad labelled document. A
quantile of the merits is the threshold, which a score of ``CUT_SCORE`` marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.llm.byte_words import LOWER, NOT_BLANK, mix, prefix_hashes, span_hashes, text_slices, word_spans

#: Labelled documents of which features reach the driver, chosen by the smallest hash of their id.
SAMPLE_DOCS = 12_000
#: Preference pairs drawn from them.
PAIRS = 40_000
CUT_SCORE = 0.3
BINS = 12
RIDGE = 1e-3

_UPPER, _LETTER, _DIGIT, _SIGN, _BLANK, _LINE, _WIDE = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, _SIGN, np.uint8)
    table[0x80:] = _WIDE
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = _UPPER
    table[0x61:0x7B] = _LETTER
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
    table[0x0A] = _LINE
    return table


_CLASS = _classes()
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,"]] = True
FEATURES = ["bytes", "words", "upper", "digits", "signs", "rare_signs", "wide", "lines", "word_length", "ends_in_sign",
            "repeats_last", "distinct_words", "distinct_pairs", "top_word", "short_words", "long_words", "line_length",
            "doubled_signs", "sentences", "distinct_lines"]


def _shares_distinct(values: np.ndarray, row_of: np.ndarray, counts: np.ndarray):
    """Per row: share of distinct values, and share of the most frequent one; 0 without values."""
    distinct, most = np.zeros(len(counts)), np.zeros(len(counts))
    if len(values):
        order = np.lexsort((values, row_of))
        values, rows = values[order], row_of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(values)))
        whole = np.maximum(counts, 1)
        distinct = np.bincount(rows[begin], minlength=len(counts)) / whole
        np.maximum.at(most, rows[begin], length)
        most = most / whole
    return distinct, most


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, from all of its bytes. Null and empty texts have zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for begin, end, data, offsets in text_slices(column):
        count = end - begin
        sizes = np.diff(offsets)
        row_of_byte = np.repeat(np.arange(count), sizes)
        classes = _CLASS[data]
        table = np.bincount(row_of_byte * 7 + classes, minlength=7 * count).reshape(count, 7).astype(float)
        whole = np.maximum(sizes, 1)
        sign = classes == _SIGN
        stop = _STOPS[data]
        doubled = np.zeros(len(data), bool)
        doubled[1:] = sign[1:] & sign[:-1] & (row_of_byte[1:] == row_of_byte[:-1])
        per_row = lambda flags: np.bincount(row_of_byte[flags], minlength=count)
        lowered = LOWER[data]
        starts, ends, first = word_spans(lowered, offsets, NOT_BLANK)
        words = np.diff(first)
        many = np.maximum(words, 1)
        row_of = np.repeat(np.arange(count), words)
        hashes = span_hashes(prefix_hashes(lowered), starts, ends)
        lengths = ends - starts
        of_words = lambda flags: np.bincount(row_of[flags], minlength=count) / many
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])
        odd_end = (sign[ends - 1] & ~stop[ends - 1]) if len(ends) else np.zeros(0, bool)
        distinct, most = _shares_distinct(hashes, row_of, words)
        inner = np.flatnonzero(row_of[1:] == row_of[:-1])
        pairs = mix(hashes[inner] * np.uint64(3) + hashes[inner + 1])
        distinct_pairs, _ = _shares_distinct(pairs, row_of[inner], np.maximum(words - 1, 0))
        lines = np.zeros(256, bool)
        lines[0x0A] = True
        line_starts, line_ends, line_first = word_spans(lowered, offsets, ~lines)
        line_hashes = span_hashes(prefix_hashes(lowered), line_starts, line_ends)
        n_lines = np.diff(line_first)
        distinct_lines, _ = _shares_distinct(line_hashes, np.repeat(np.arange(count), n_lines), n_lines)
        letters = np.maximum(table[:, _UPPER] + table[:, _LETTER], 1)
        out[begin:end] = np.column_stack([
            np.log1p(sizes), np.log1p(words), table[:, _UPPER] / letters, table[:, _DIGIT] / whole,
            table[:, _SIGN] / whole, per_row(sign & ~stop) / whole, table[:, _WIDE] / whole,
            table[:, _LINE] / many, np.bincount(row_of, lengths, minlength=count) / many, of_words(odd_end),
            of_words(same), distinct, distinct_pairs, most, of_words(lengths <= 2), of_words(lengths >= 14),
            np.log1p(sizes / np.maximum(n_lines, 1)), per_row(doubled) / many, per_row(data == 0x2E) / many,
            distinct_lines])
        out[begin:end][words == 0, 1:] = 0
    return out


@dataclass
class QualityModel:
    """Weights on spread features: each feature's bins by quantile, and its own value."""

    edges: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def design(self, features: np.ndarray) -> np.ndarray:
        return _design(features, self.edges, self.mean, self.spread)

    def merits(self, features: np.ndarray) -> np.ndarray:
        return self.design(features) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT_SCORE`` exactly at the threshold."""
        z = self.slope * (self.merits(features) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        z = np.where(np.abs(z - np.log(CUT_SCORE / (1 - CUT_SCORE))) < 1e-12, np.log(CUT_SCORE / (1 - CUT_SCORE)), z)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _design(features, edges, mean, spread):
    parts = [np.clip((features - mean) / spread, -6, 6)]
    parts += [(features[:, [k]] > edges[k]).astype(float) for k in range(features.shape[1])]
    return np.hstack(parts)


def fit_pairs(features: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> QualityModel:
    """Fit merits to preferences of documents labelled 1 over those labelled 0.

    Without documents of both labels every merit is 0 and every document passes."""
    edges = np.quantile(features, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(features) else np.zeros(
        (features.shape[1], BINS - 1))
    mean = features.mean(0) if len(features) else np.zeros(features.shape[1])
    spread = np.maximum(features.std(0), 1e-9) if len(features) else np.ones(features.shape[1])
    design = _design(features, edges, mean, spread)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return QualityModel(edges, mean, spread, np.zeros(design.shape[1]), 0.0, 1.0)
    draw = np.random.default_rng(seed)
    differences = design[draw.choice(good, pairs)] - design[draw.choice(bad, pairs)]
    weights = np.zeros(design.shape[1])
    for _ in range(12):
        chance = 1 / (1 + np.exp(np.clip(differences @ weights, -30, 30)))
        slope = differences.T @ chance / pairs - RIDGE * weights
        curve = (differences * (chance * (1 - chance))[:, None]).T @ differences / pairs
        step = np.linalg.solve(curve + RIDGE * np.eye(len(weights)), slope)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    merits = design @ weights
    # The lowest quantile of merits that parts the labels with the fewest errors.
    levels = np.quantile(merits, np.linspace(0, 1, 401))
    errors = [((merits >= level) != (labels == 1)).sum() for level in levels]
    least = np.flatnonzero(np.array(errors) == min(errors))
    cut = float(levels[least[0]])
    return QualityModel(edges, mean, spread, weights, cut, 1.0)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
                sample_docs: int = SAMPLE_DOCS, pairs: int = PAIRS) -> QualityModel:
    """Learn from labelled documents that are not held out.

    At most ``sample_docs`` of them, those whose ids have the smallest hashes, are used; null
    labels and null ids are not. An id with several labels counts with its largest. Rows that repeat in
    id and text count once; where ids repeat with other texts, at most ``2 * sample_docs`` rows are
    used, those of the smallest hashes of id and text."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("label"))
    # Of bounded size, so it may be sent to all executors.
    chosen = usable.orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    known = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    schema = T.StructType().add("key", "long").add("label", "integer").add(
        "features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(found), pa.list_(pa.float64()))], names=schema.names)

    keyed = known.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), text_col, "label")
    rows = keyed.mapInArrow(run, schema).dropDuplicates(["key"]).orderBy("key").limit(2 * sample_docs).toArrow()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    features = np.array(rows["features"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit_pairs(features, rows["label"].to_numpy()[order], pairs)


def quality_scores(docs: DataFrame, model: QualityModel, id_col="doc_id", text_col="text") -> DataFrame:
    """(…, score, predicted): all columns of ``docs`` with the score of the whole text (0 to 1) and
    whether it reaches the threshold. Null texts score as empty ones; each row is scored by itself.
    Columns of ``docs`` named like a result give way to it."""
    docs = docs.drop("score", "predicted")
    names = ["_row", text_col, "score", "predicted"]
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(text_col))
    schema = T.StructType([*packed.schema.fields]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(text_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= CUT_SCORE).astype(np.int32))], names=names)

    scored = packed.mapInArrow(run, schema)
    return scored.select(*[F.col(f"`{c}`") if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns],
                         "score", "predicted")
