"""Near-duplicate documents: min-wise signatures, multi-index Hamming join, exact confirmation.

A document's signature has 64 symbols of 16 bits, one per min-wise hash. Documents of
resemblance s agree in each symbol with probability s, so those of 0.75 differ in 16 of 64 on
average, and in more than 31 with a probability below 0.00002. The join finds *every* pair of
signatures that differ in at most 31 symbols: of 16 chunks of 4 symbols, one has at most one
error (two in each would make 32), so it agrees on 3 of its 4 symbols. Each document is
therefore filed under 4 keys per chunk, the chunk with one symbol left out.

Links are confirmed on the full shingle sets. Equal sets are one class from the start. Files
are compared with their smallest member first, large ones then with their likely origin; last,
only members that are not yet in one component are, so a large group of copies costs a few
comparisons a member. In this last step the shingles of each set are counted in 1024 buckets of
their hashes: two sets share at most the sum of the lesser counts, so a pair that this bound puts
below the threshold is no link and need not leave its file. The bound never drops a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.llm.byte_words import mix, shingles, text_slices
from eventloom.llm.components import components
from eventloom.llm.row_keys import row_key
from eventloom.llm.storage import stored

SYMBOLS, CHUNKS = 64, 16
CHUNK = SYMBOLS // CHUNKS
MOST_ERRORS = 2 * CHUNKS - 1
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
#: Members of a file that one task compares at once with as many others.
BLOCK_ROWS = 512
#: Members from which on a group looks for its likely origin first.
AROUND_ROWS = 12

#: Buckets in which the shingles of a set are counted, and the count that stands for all above.
BUCKETS, FULL = 1024, 255

_TURNS = (mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTORS = (mix(np.arange(10_001, SYMBOLS + 10_001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of symbols per set; the sets lie one after another and none is empty."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((high ^ _TURNS[k]) * _FACTORS[k], begin)
        out[:, k] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def bucket_counts(texts: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(node, buckets) from (node, text): different shingles per bucket, one byte each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                values, first = shingles(data, offsets, width)
                for low, high in zip(first[:-1], first[1:]):
                    places = (np.unique(values[low:high]) % np.uint64(BUCKETS)).astype(np.int64)
                    counts = np.bincount(places, minlength=BUCKETS)
                    counted.append(np.minimum(counts, FULL).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted, pa.binary())],
                                             names=["node", "buckets"])

    return texts.select("node", "text").mapInArrow(run, "node long, buckets binary")


def may_link(buckets: np.ndarray, sizes: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Whether sets can be similar enough to another, from their bucket counts and sizes. Exact in one
    direction: a pair it rules out is no link."""
    least = np.minimum(buckets, other)
    common = least.sum(1, dtype=np.int64)
    # Where both counts are full the lesser one is not known.
    return (least == FULL).any(1) | (100 * common >= SIMILARITY_PERCENT * (sizes + size - common))


PROFILE = T.StructType().add("n_shingles", "long").add("digest", "binary").add("signature", "binary")


def profiles(keyed: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row_key, n_shingles, digest, signature) from (doc_id, row_key, text); sets without
    a shingle have neither digest nor signature."""
    schema = T.StructType([keyed.schema["doc_id"], keyed.schema["row_key"], *PROFILE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signed = [], [], []
            for _, _, data, offsets in text_slices(batch.column(2)):
                values, first = shingles(data, offsets, width)
                full = np.flatnonzero(np.diff(first))
                symbols = iter(signatures(values, first[full])) if len(full) else iter(())
                for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = np.unique(values[low:high])
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    signed.append(next(symbols).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signed, pa.binary())], names=schema.names)

    return keyed.select("doc_id", "row_key", "text").mapInArrow(run, schema)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def filing_keys(classes: DataFrame) -> DataFrame:
    """(key, slot, node): a class under all its keys; a slot is a chunk and the symbol left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                symbols = _symbols(part.column(1)).astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
                keys = []
                for left_out in range(CHUNK):
                    total = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(CHUNK) + np.uint64(left_out)
                    for k in range(CHUNK):
                        if k != left_out:
                            total = mix((total << np.uint64(16)) + symbols[:, :, k] + np.uint64(1))
                    keys.append(total)
                keys = np.stack(keys, axis=2).reshape(part.num_rows, SYMBOLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int8), part.num_rows)),
                     pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS))], names=["key", "slot", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, slot byte, node long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``MOST_ERRORS`` symbols and whose sizes allow a link."""
    sides = pairs
    for side in "ab":
        own = classes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"),
                             F.col("n_shingles").alias(f"n{side}"))
        sides = sides.join(own, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                errors = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(errors <= MOST_ERRORS))

    sized = sides.filter(F.expr(f"100 * least(na, nb) >= {SIMILARITY_PERCENT} * greatest(na, nb)"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE_WORDS,
              percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    sides = pairs
    for side in "ab":
        sides = sides.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}")), side)

    def sets(column: pa.Array) -> list[np.ndarray]:
        found = []
        for _, _, data, offsets in text_slices(column):
            values, first = shingles(data, offsets, width)
            found.extend(np.unique(values[low:high]) for low, high in zip(first[:-1], first[1:]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                linked = []
                for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return sides.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sizes_allow(sizes: np.ndarray, other: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough to a set of another."""
    return 100 * np.minimum(sizes, other) >= SIMILARITY_PERCENT * np.maximum(sizes, other)


def _most_frequent(values: np.ndarray) -> int:
    found, times = np.unique(values, return_counts=True)
    return int(found[times.argmax()])


def _shared_before(symbols: np.ndarray, other: np.ndarray, slot: int) -> np.ndarray:
    """Whether rows of symbols share a key of an earlier slot with another."""
    same = (symbols == other).reshape(len(symbols), CHUNKS, CHUNK)
    chunk, left_out = divmod(slot, CHUNK)
    enough = same.sum(2) >= CHUNK - 1
    before = enough[:, :chunk].any(1)
    for k in range(left_out):
        before |= np.delete(same[:, chunk], k, axis=1).all(1)
    return before


def _across(files: DataFrame, block_rows: int, around: bool) -> DataFrame:
    """(a, b): pairs within a file, of different components, whose signatures are close enough.

    Rows: (key, slot, n, leader, node, component, signature, n_shingles), without ``around`` also
    buckets. A file is cut into blocks of bounded size and each pair of blocks is compared by
    itself, so a large file is many tasks' work. Pairs with the file's leader were compared
    before. With ``around``, the large groups alone, and in them only pairs with the member nearest to
    the most frequent symbols, the likely origin of the others; without, all pairs, each in the
    first file that holds it. The sizes of a pair always allow a link."""
    counted = [] if around else ["buckets"]
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = files.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "slot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                           "own", "leader", "node", "component", "signature", "n_shingles", *counted)

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        node, component = group["node"].to_numpy(), group["component"].to_numpy()
        if len(node) < 2 or (component == component[0]).all():
            return None
        symbols, size = _symbols(group["signature"]), group["n_shingles"].to_numpy()
        side = group["own"].to_numpy()
        free = node != group["leader"].to_numpy()
        cross = group["low"][0].as_py() != group["high"][0].as_py()
        slot = group["slot"][0].as_py()
        a, b = [], []
        if around:
            if len(node) < AROUND_ROWS:
                return None
            usual = np.array([_most_frequent(column) for column in symbols.T])
            origin = int((symbols != usual).sum(1).argmin())
            near = np.flatnonzero((component != component[origin]) & _sizes_allow(size, size[origin])
                                  & ((symbols != symbols[origin]).sum(1) <= MOST_ERRORS))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[near], node[origin])), pa.array(np.maximum(node[near], node[origin]))],
                names=["a", "b"])
        buckets = np.frombuffer(b"".join(group["buckets"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
        for k in np.flatnonzero(free):
            ahead = free & (component != component[k]) & (node > node[k]) & _sizes_allow(size, size[k])
            if cross:
                ahead &= side != side[k]
            ahead = np.flatnonzero(ahead)
            if len(ahead):
                near = ahead[(symbols[ahead] != symbols[k]).sum(1) <= MOST_ERRORS]
                near = near[~_shared_before(symbols[near], symbols[k], slot)]
                near = near[may_link(buckets[near], size[near], buckets[k], size[k])]
                a.extend([int(node[k])] * len(near))
                b.extend(node[near].tolist())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by file and pair of blocks; the last group of a batch may go on in the next.
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            names = [table[c].to_numpy() for c in ("key", "low", "high")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
            edges = [0, *change.tolist()]
            for low, high in zip(edges[:-1], edges[1:]):
                if (out := compare(table.slice(low, high - low).combine_chunks())) is not None:
                    yield out
            held = table.slice(edges[-1])
        if held is not None and (out := compare(held.combine_chunks())) is not None:
            yield out

    key = ["key", "low", "high"]
    count = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(count, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       row_key(F.col(id_col).cast("string"), F.col(text_col)).alias("row_key"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", width: int = SHINGLE_WORDS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key, component) for every document.

    ``row_key`` is a hash of id and text, ``component`` the smallest class number of its component, null
    for documents without shingles.
    Documents without words, or null, have no shingles and are linked with nothing. Rows that
    repeat have equal sets and so are linked; a null id never is the smallest of a component
    that has others, and ids that repeat keep every row that has the smallest."""
    keyed = _keyed(docs, id_col, text_col)
    known = stored(profiles(keyed, width), "neardup-profiles")
    # Classes of equal sets are numbered, once and for all since the numbers are stored; a hash of
    # 64 bits in their place would make two classes one at some 10**10 documents.
    nodes = known.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    member = nodes.select("node", "digest", F.col("row_key").alias("_key"))
    classes = known.join(member, [known["row_key"] == member["_key"], known["digest"] == member["digest"]]).select(
        "node", "n_shingles", "signature").dropDuplicates(["node"])
    classes = stored(classes, "neardup-signatures")

    keys = filing_keys(classes)
    files = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
    # Aggregates are stored before they are joined back: Spark can then split frequent keys.
    files = stored(files, "neardup-keys")
    files = stored(keys.join(files, "key"), "neardup-files")

    stars = files.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(_likely(stars, classes), "neardup-stars")
    # Texts that a comparison may need: one row per class, joined again for each set of pairs.
    needed = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).unionByName(
        files.filter("n > 2").select("node")).distinct()
    needed = nodes.select("node", "row_key").join(needed, "node")
    texts = keyed.select("row_key", "text").join(needed, "row_key").select("node", "text").dropDuplicates(["node"])
    texts = stored(texts, "neardup-texts")

    links = stored(confirmed(stars, texts, width), "neardup-links")
    several = files.filter("n > 2")
    for around in (True, False):
        linked = components(links, "neardup-components")
        placed = several.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
            "low != high").select("key")
        mixed = stored(mixed, "neardup-keys")
        across = placed.join(mixed, "key").join(classes, "node")
        if not around:
            unsettled = texts.join(placed.join(mixed, "key").select("node").distinct(), "node", "left_semi")
            across = across.join(stored(bucket_counts(unsettled, width), "neardup-buckets"), "node")
        more = confirmed(_across(across, block_rows, around), texts, width)
        links = stored(links.unionByName(more), "neardup-links")
    linked = stored(components(links, "neardup-components"), "neardup-components")

    member = nodes.join(linked, "node", "left").select(
        "digest", "least_id", F.coalesce("component", "node").alias("component"))
    least = stored(member.groupBy("component").agg(F.min("least_id").alias("component_id")), "neardup-least")
    named = member.join(least, "component").select("digest", "component", F.col("component_id").alias("_id"))
    joined = known.select("doc_id", "row_key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key", "component")


def without_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` of which one stays per component: that of the smallest id (null last),
    of rows that share it one alone. Documents without words stay, one for each id and text."""
    judged = near_duplicates(docs, id_col, text_col)
    alone = F.when(F.col("component").isNull(), F.col("row_key"))
    kept = judged.groupBy("component", alone.alias("alone")).agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("_key"))
    rows = docs.withColumn("_key", row_key(F.col(id_col).cast("string"), F.col(text_col)))
    return rows.join(kept.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
