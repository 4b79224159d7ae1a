"""Substrings of 200 bytes that occur twice, by a distributed merge sort of suffixes.

Not every suffix is sorted. In each window of 200 bytes the substring of 64 bytes with the
smallest hash is its anchor, so equal windows have equal anchors at equal places, and only
anchors whose 64 bytes occur twice can belong to repeated windows: those are the suffixes
that matter. Each task sorts the suffixes of its anchors into runs, front-codes them and
exchanges them by ranges of their bytes; loser trees merge the runs of a range and give, with
the order, the common prefixes of neighbours. A window that begins ``o`` bytes before its
anchor is repeated when another anchor agrees in 200 - o bytes to the right, a stretch of
neighbours in that order, and in o bytes to the left, a stretch in the order of the reversed
left contexts.

All anchors with one gram meet in one range. Where they are too many, the gram grows: half of the
windows share 68 more bytes to the right of it, the others 69 to its left, and an anchor becomes
two, at the two ends, of grams of 132 bytes that fewer anchors have. So it goes on, for those still
too frequent, to grams of 200 bytes, which are whole windows. Before each step equal contexts of
a task are compared and become one anchor, so that copies do not travel.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.llm.byte_words import mix, powers, prefix_hashes
from eventloom.llm.loser_tree import common_prefix, merged
from eventloom.llm.storage import stored, stored_buckets

LENGTH = 200
GRAM = 64
#: Bytes of a text whose anchors are found at once.
STRETCH = 1 << 20
#: Suffixes a task sorts into one run, suffixes of one range, strings sampled to cut ranges.
RUN_ROWS = 60_000
RANGE_ROWS = 20_000
SAMPLE_ROWS = 20_000
#: Anchors with one gram that may meet in one range; the grams of more grow.
GROUP_ROWS = 20_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of a width."""
    count, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:count], values[width - span:width - span + count])


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(position, first window, windows, gram hash) of a text's anchors: each window of
    ``length`` bytes belongs to exactly one, the leftmost of its smallest grams."""
    width = length - gram + 1
    windows = len(text) - length + 1
    found = []
    for begin in range(0, windows, STRETCH):
        part = text[begin:begin + STRETCH + length - 1]
        sums = prefix_hashes(part)
        count = len(part) - gram + 1
        grams = mix((sums[gram:] - sums[:-gram]) * powers(len(part) + 1)[1][:count])
        # The upper half orders grams, the lower half is the place in the stretch.
        least = _least((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64), width)
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((place[change] + begin, change + begin, np.diff(np.append(change, len(place))), grams[place[change]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    position, first, owned, grams = (np.concatenate(c) for c in zip(*found))
    # An anchor that owns windows on both sides of a cut is one anchor.
    new = np.concatenate([[True], position[1:] != position[:-1]])
    return position[new], first[new], np.add.reduceat(owned, np.flatnonzero(new)), grams[new]


def _packed(position, first, owned, known=0):
    """A place: its windows begin ``position - first`` bytes before it and at the ``owned - 1`` places behind
    that. ``known``: its windows are known to be repeated, and it stands there for others to meet."""
    return position << 17 | known << 16 | (position - first) << 8 | owned


def _unpacked(packed):
    return packed >> 17, (packed >> 8) & 0xFF, packed & 0xFF


def _is_known(packed):
    return (packed >> 16) & 1


def _all_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin in range(0, batch.num_rows, 256):
                keys, places, grams = [], [], []
                for key, text in zip(ids[begin:begin + 256], batch.column(1).slice(begin, 256), strict=True):
                    text = np.frombuffer(text.as_buffer(), np.uint8)
                    if len(text) >= length:
                        position, first, owned, own = anchors(text, length, gram)
                        keys += [key] * len(own)
                        places.append(_packed(position, first, owned))
                        grams.append(own.view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), *(pa.array(np.concatenate(c)) for c in (places, grams))],
                        names=["tid", "place", "gram"])

    return texts.select("tid", "text").mapInArrow(run, "tid binary, place long, gram long")


def _contexts(text: bytes, places: list[int], length: int, gram: int):
    """(suffix, reversed left context, place) of the anchors of a text."""
    for place in places:
        position = place >> 17
        yield (text[position:position + length], text[max(0, position - length + gram):position][::-1], place)


def _coded(entries: list[tuple[bytes, bytes, list]]) -> bytes:
    """A sorted run, both sides front-coded."""
    import zstandard
    suffixes, lefts, before, before_left = [], [], b"", b""
    for suffix, left, _ in entries:
        shared, shared_left = common_prefix(before, suffix, 0), common_prefix(before_left, left, 0)
        suffixes.append((shared, suffix[shared:]))
        lefts.append((shared_left, left[shared_left:]))
        before, before_left = suffix, left
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((suffixes, lefts, [e[2] for e in entries])))


def _decoded(run: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, list]]]:
    import zstandard
    suffixes, lefts, places = pickle.loads(zstandard.ZstdDecompressor().decompress(run))
    left = b""
    for (shared, rest), (shared_left, rest_left), own in zip(suffixes, lefts, places, strict=True):
        left = left[:shared_left] + rest_left
        yield shared, rest, (left, own)


def _sorted_runs(marked: DataFrame, cuts: list[bytes], length: int, gram: int) -> DataFrame:
    """(part, run): the front-coded runs of all tasks, cut at the ranges' borders. Within a run equal
    contexts are one entry with all their places."""
    def flush(held: list[tuple[bytes, bytes, int, bytes, int]]) -> pa.RecordBatch:
        held.sort()
        parts: dict[int, list[tuple[bytes, bytes, list]]] = {}
        part, entries, before = -1, [], None
        for suffix, left, windows, tid, place in held:
            if (suffix, left, windows) == before:
                entries[-1][2].append((tid, place))
                continue
            before = suffix, left, windows
            if (now := bisect_right(cuts, suffix[:gram])) != part:
                part, entries = now, parts.setdefault(now, [])
            entries.append((suffix, left, [(tid, place)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([_coded(e) for e in parts.values()], pa.binary())],
            names=["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in range(batch.num_rows):
                tid, places = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                text = batch.column(1)[row].as_buffer().to_pybytes()
                for suffix, left, place in _contexts(text, places, length, gram):
                    held.append((suffix, left, place & 0xFFFF, tid, place))
                    if len(held) >= RUN_ROWS:
                        yield flush(held)
                        held = []
        if held:
            yield flush(held)

    return marked.select("tid", "text", "places").mapInArrow(run, "part int, run binary")


def _repeated(entries: list[tuple[int, bytes, tuple[bytes, list]]], length: int, gram: int):
    """(tid, begin, end): the repeated bytes that a merged range shows, one row per stretch of windows."""
    shared = np.array([e[0] for e in entries])
    shared[0] = 0
    lefts = [e[2][0] for e in entries]
    places = [e[2][1] for e in entries]
    count, width = len(entries), length - gram + 1
    group = np.cumsum(shared < gram)
    order = sorted(range(count), key=lambda k: (group[k], lefts[k]))
    shared_left = np.full(count, -1)
    for at in range(1, count):
        a, b = order[at - 1], order[at]
        if group[a] == group[b]:
            shared_left[at] = common_prefix(lefts[a], lefts[b], 0)
    back = np.empty(count, np.int64)
    back[order] = np.arange(count)
    # Windows that the anchor of an entry owns begin so many bytes before it.
    _, most, owned = _unpacked(np.array([own[0][1] for own in places]))
    least = most - owned + 1
    several = np.array([len(own) > 1 or bool(_is_known(own[0][1])) for own in places])
    found = np.zeros((count, width + 1), np.int8)
    for o in range(width):
        own = np.flatnonzero((least <= o) & (o <= most))
        if not len(own):
            continue
        right = np.cumsum(shared < length - o)[own]
        left = np.cumsum(shared_left < o)[back[own]]
        _, which, times = np.unique(right * (count + 1) + left, return_inverse=True, return_counts=True)
        found[own, o] = (times[which] > 1) | several[own]
    steps = np.diff(np.concatenate([np.zeros((count, 1), np.int8), found], axis=1), axis=1)
    row, low = np.nonzero(steps == 1)
    row_end, high = np.nonzero(steps == -1)
    assert (row == row_end).all()
    tids, begins, ends = [], [], []
    for k, first, stop in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
        for tid, place in places[k]:
            if not _is_known(place):
                tids.append(tid)
                begins.append((place >> 17) - stop + 1)
                ends.append((place >> 17) - first + length)
    return tids, begins, ends


SPANS = "tid binary, start long, stop long"


def _spans(tids, begins, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(tids, pa.binary()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
        names=["tid", "start", "stop"])


def _merged_spans(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """Merge the runs of every range and give the repeated stretches."""
    def work(held: list[bytes]) -> pa.RecordBatch:
        entries = list(merged([_decoded(run) for run in held]))
        return _spans(*_repeated(entries, length, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for now, coded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != part and held:
                    yield work(held)
                    held = []
                part = now
                held.append(coded)
        if held:
            yield work(held)

    return runs.sortWithinPartitions("part").mapInArrow(run, SPANS)


def _grown(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """(tid, place, gram, start, stop): anchors of longer grams for those of frequent ones, and the spans
    of those whose whole contexts are equal within a task.

    An anchor whose windows begin up to ``width`` bytes before it gives two: one at its own place for
    those that begin at most half as far, one further left for the others."""
    width = length - gram
    half = width // 2

    def flush(held: dict[tuple[bytes, bytes, int], list[tuple[bytes, int]]]) -> pa.RecordBatch:
        rows = []
        for (suffix, left, _), own in held.items():
            known = int(len(own) > 1 or _is_known(own[0][1]))
            if len(own) > 1:
                for tid, place in own:
                    if not _is_known(place):
                        position, most, owned = _unpacked(place)
                        rows.append((tid, None, None, position - most, position - most + owned - 1 + length))
            tid, (position, most, owned) = own[0][0], _unpacked(own[0][1])
            least = most - owned + 1
            around, middle = left[::-1] + suffix, len(left)
            for low, high, back in ((0, half, 0), (half + 1, width, half + 1)):
                nearest, farthest = max(low, least), min(high, most)
                if nearest <= farthest:
                    begin = middle - back
                    digest = hashlib.blake2b(around[begin:begin + length - half], digest_size=8).digest()
                    rows.append((tid, _packed(position - back, position - farthest, farthest - nearest + 1, known),
                                 int.from_bytes(digest, "big", signed=True), None, None))
        kinds = [pa.binary()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["tid", "place", "gram", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0
        for batch in batches:
            for row in range(batch.num_rows):
                tid, places = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                text = batch.column(1)[row].as_buffer().to_pybytes()
                for suffix, left, place in _contexts(text, places, length, gram):
                    held.setdefault((suffix, left, place & 0xFFFF), []).append((tid, place))
                    count += 1
                    if count >= RUN_ROWS:
                        yield flush(held)
                        held, count = {}, 0
        if held:
            yield flush(held)

    return marked.select("tid", "text", "frequent").filter(F.size("frequent") > 0).mapInArrow(
        run, "tid binary, place long, gram long, start long, stop long")


def _borders(marked: DataFrame, total: int, gram: int, range_rows: int, sample_rows: int) -> list[bytes]:
    """Borders of the ranges: grams of a sample of the anchors."""
    ranges = max(1, -(-total // range_rows))
    if ranges == 1:
        return []
    share = max(1, total // sample_rows)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_buffer().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array(
                    [text[p >> 17:(p >> 17) + gram] for p in batch.column(2)[row].as_py()], pa.binary())], names=["head"])

    some = marked.select("tid", "text", F.filter("places", lambda p: F.pmod(
        F.xxhash64(p, "tid"), F.lit(share)) == 0).alias("places")).filter(F.size("places") > 0)
    sample = sorted(some.mapInArrow(heads, "head binary").limit(4 * sample_rows).toArrow()["head"].to_pylist())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   range_rows: int = RANGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(tid, start, stop): byte spans, possibly overlapping, whose union is every byte covered by a string of
    ``length`` bytes that starts at two places of the texts (tid, text). A tid stands for one text;
    ``texts`` should be a stored table, as it is read several times."""
    count = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, spans = _all_anchors(texts, length, gram), []
    while True:
        # Stored, so that the join meets a plain table, whose frequent grams Spark can split.
        often = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-grams")
        # A gram of the whole length cannot grow. A task has sent it once at most, whatever its number of copies.
        grows = (F.col("n") > group_rows) & F.lit(gram < length)
        dup = found.join(often, "gram").select("tid", "place", grows.alias("frequent"))
        # Lists are bounded by their text.
        lists = stored(dup.groupBy("tid").agg(
            F.collect_list(F.when(~F.col("frequent"), F.col("place"))).alias("places"),
            F.collect_list(F.when(F.col("frequent"), F.col("place"))).alias("frequent")), "suffix-anchors")
        total, frequent = lists.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)),
                                    F.coalesce(F.sum(F.size("frequent")), F.lit(0))).first()
        marked = texts.join(lists, "tid")
        runs = _sorted_runs(marked, _borders(marked, total, gram, range_rows, sample_rows), length, gram)
        spans.append(_merged_spans(runs.repartition(count, "part"), length, gram))
        if not frequent:
            return functools.reduce(DataFrame.unionByName, spans)
        grown = stored(_grown(marked, length, gram), "suffix-grown")
        spans.append(grown.filter("place is null").select("tid", "start", "stop"))
        found = grown.filter("place is not null").select("tid", "place", "gram")
        gram = length - (length - gram) // 2


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, **limits) -> DataFrame:
    """(all columns of ``docs``, n_bytes, n_removed, n_spans, kept_text, kept_sha256) for every document.

    Texts are UTF-8 bytes, null an empty one. The digest is of the remaining bytes; ``kept_text`` leaves
    out what remains of cut characters. Columns of ``docs`` with the name of a result give way to it. Every place of a repeated string goes, the first included; matches never cross
    documents. Equal texts are handled once, and as each is the other's copy, all their bytes go
    if there are at least ``length``. Texts are told apart by 128 bits of their SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_tid", F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)))
    distinct = keyed.select(F.col("_tid").alias("tid"), text.cast("binary").alias("text")).groupBy("tid").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = stored_buckets(distinct, "suffix_texts", "tid")
    spans = stored(repeated_spans(texts.select("tid", "text"), length, **limits), "suffix-spans")
    covers = spans.groupBy("tid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    schema = T.StructType().add("tid", "binary").add("n_bytes", "long").add("n_removed", "long").add(
        "n_spans", "long").add("kept_text", "string").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for tid, data, copies, starts, stops in zip(*part.columns, strict=True):
                    data = data.as_buffer().to_pybytes()
                    size = len(data)
                    cover = np.zeros(size + 1, np.int64)
                    if copies.as_py() > 1 and size >= length:
                        cover[0] = 1
                    elif starts.is_valid:
                        np.add.at(cover, starts.values.to_numpy(), 1)
                        np.add.at(cover, stops.values.to_numpy(), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                    rows.append((tid.as_py(), size, int(gone.sum()), spans, kept.decode(errors="ignore"),
                                 hashlib.sha256(kept).hexdigest()))
                kinds = [pa.binary()] + [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    judged = texts.join(covers, "tid", "left").select("tid", "text", "copies", "starts", "stops").mapInArrow(run, schema)
    return keyed.join(judged, keyed["_tid"] == judged["tid"]).select(
        *[keyed[f"`{c}`"] for c in docs.columns if c not in schema.names[1:]], *[judged[c] for c in schema.names[1:]])
