"""Remove passages of lines or paragraphs that occur before, over all documents.

Units are normalised and hashed; per digest the earliest occurrence by rank (document id, place
in it) is kept and every other is a repeat. A passage is a run of repeats with no other unit between
them; it goes where it has at least ``LEAST_WORDS`` words, with the original character offsets
retained. A short line that recurs by itself ("of.", a heading) is no passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventloom.llm.storage import stored

LINE, PARAGRAPH = "\n", "\n\n"
#: Words from which a run of repeated units is a passage.
LEAST_WORDS = 15
#: Upper case that normalising lowers, and the white space it folds: ASCII only.
_LOWER = {code: code + 32 for code in range(65, 91)}
_BLANKS = {code: " " for code in range(9, 14)}
_TABLE = _LOWER | _BLANKS


def normalised(unit: str) -> str:
    """A-Z lowered, runs of ASCII white space one space, none at the ends."""
    return " ".join(part for part in unit.translate(_TABLE).split(" ") if part)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_key, doc_id, text), stored, so that the row numbers stay."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"),
                              F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie")),
                  "line-rows")


def _units(keyed: DataFrame, separator: str) -> DataFrame:
    schema = T.StructType([keyed.schema["row_key"], keyed.schema["doc_id"], keyed.schema["tie"]]).add("unit", "integer").add(
        "start", "integer").add("stop", "integer").add("digest", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, units, starts, stops, digests = [], [], [], [], []
                for row, text in enumerate(part.column(3).to_pylist()):
                    start = 0
                    for number, unit in enumerate((text or "").split(separator)):
                        stop = start + len(unit)
                        if plain := normalised(unit):
                            rows.append(row)
                            units.append(number)
                            starts.append(start)
                            stops.append(stop)
                            digests.append(hashlib.blake2b(plain.encode(), digest_size=16).digest())
                        start = stop + len(separator)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(rows) for k in range(3)), pa.array(units, pa.int32()),
                     pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(digests, pa.binary())],
                    names=schema.names)

    return keyed.select("row_key", "doc_id", "tie", "text").mapInArrow(run, schema)


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row_key", "unit")


def repeated_units(docs: DataFrame, id_col="doc_id", text_col="text", separator=LINE) -> DataFrame:
    """(row_key, doc_id, unit, start, stop, digest): all units that occur before, with their character
    offsets; ``row_key`` is a number of the row.

    Blank units are no repeats. Ids order the documents, null last; rows with one id are
    ordered by a hash of their text, and rows that repeat in id and text repeat each other."""
    return _repeats(_keyed(docs, id_col, text_col), separator)


def _repeats(keyed: DataFrame, separator: str) -> DataFrame:
    found = _units(keyed, separator)
    earliest = found.groupBy("digest").agg(F.min(_rank()).alias("earliest"), F.count("*").alias("n"))
    # Stored, so that the join meets a plain table, whose frequent digests Spark can split.
    earliest = stored(earliest.filter("n > 1").select("digest", "earliest"), "line-earliest")
    return found.join(earliest, "digest").filter(
        ~_rank().eqNullSafe(F.col("earliest"))).select("row_key", "doc_id", "unit", "start", "stop", "digest")


def passages(text: str, separator: str, repeats: set[int], least_words: int) -> tuple[int, list[tuple[int, int]], str]:
    """Number of units that are not blank, (start, stop) of those to remove, and the text without
    them. ``repeats`` are the starts of the repeated units."""
    units, count, gone, run, words, start = text.split(separator), 0, [], [], 0, 0
    for unit in [*units, None]:
        plain = None if unit is None else normalised(unit)
        number = plain and plain.count(" ") + 1
        if number:
            count += 1
        if number and start in repeats:
            run.append((start, start + len(unit)))
            words += number
        elif plain != "":  # a blank unit neither counts nor ends a run
            if words >= least_words:
                gone += run
            run, words = [], 0
        start += 0 if unit is None else len(unit) + len(separator)
    removed, kept, start = {a for a, _ in gone}, [], 0
    for unit in units:
        if start not in removed:
            kept.append(unit)
        start += len(unit) + len(separator)
    return count, gone, separator.join(kept)


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", separator=LINE,
                    least_words=LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_units, n_removed, removed_chars, removed_spans) for every document.

    ``text``: the kept units, blank ones included, joined by the separator (null stays null);
    ``removed_spans``: original offsets as ``start-stop``, comma-joined. With ``least_words`` 1 every
    repeated unit goes. Of rows that repeat in id and text one keeps its passages."""
    keyed = _keyed(docs, id_col, text_col)
    # One list per document: bounded by its text.
    spans = _repeats(keyed, separator).groupBy("row_key").agg(F.collect_set("start").alias("starts"))
    joined = keyed.join(spans, "row_key", "left").select("doc_id", "text", "starts")
    schema = T.StructType([keyed.schema["doc_id"], keyed.schema["text"]]).add("n_units", "long").add(
        "n_removed", "long").add("removed_chars", "long").add("removed_spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    count, gone, kept = passages(text or "", separator, set(starts or ()), least_words)
                    rows.append((None if text is None else kept, count, len(gone), sum(b - a for a, b in gone),
                                 ",".join(f"{a}-{b}" for a, b in gone)))
                texts, *counts, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(names, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
