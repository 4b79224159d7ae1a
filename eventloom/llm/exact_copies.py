"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical without white space. Rows are combined in three steps:
within each task (Spark's partial aggregation), within salted groups of a digest, and over the
salts of a digest. The whole normalised text is a grouping key in every step, so that equal
digests of different texts never merge. A digest gets salts in proportion to its share of all
rows; salts follow the task that read a row, so that a task sends one row per distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.storage import stored

# Fixed value: the characters that do not count, space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A digest has one salt per 1/1024 of all rows, so that at most 512 digests have several.
SHARES = 1024
#: Bits of ``monotonically_increasing_id`` below the number of the task.
_TASK_BITS = 33


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tagged_rows(docs: DataFrame, id_col="doc_id", text_col="text", digest=content_digest) -> DataFrame:
    """(row_no, doc_id, text, row, chars, digest), stored so that the row numbers stay. ``row``
    holds the other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    text = F.col(f"`{text_col}`")
    return stored(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"),
        F.struct(*others, F.lit(0).alias("_")).alias("row"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("chars"), digest(normalised(text)).alias("digest")),
        "copies-rows")


def repeated_digests(rows: DataFrame) -> DataFrame:
    """(digest, total) of the digests that occur more than once."""
    return stored(rows.groupBy("digest").agg(F.count("*").alias("total")).filter("total > 1"), "copies-digests")


def crowded_digests(repeated: DataFrame, count: int, shares=SHARES) -> DataFrame:
    """(digest, salts) of the digests with more than one salt: at most ``shares`` / 2 rows."""
    share = F.floor(F.col("total") * shares / F.lit(max(1, count))).cast("int")
    return repeated.select("digest", share.alias("salts")).filter("salts > 1")


def with_salts(rows: DataFrame, crowded: DataFrame, spread_by: Column) -> DataFrame:
    """Add ``salts`` and ``salt``, one of them."""
    joined = rows.join(F.broadcast(crowded), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return joined.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.col("salts")).cast("int"))


def copy_classes(rows: DataFrame, repeated: DataFrame, crowded: DataFrame) -> DataFrame:
    """(digest, content, best, n): the texts that occur more than once, and all texts of a crowded
    digest. ``content`` is given only where the digest has further texts.

    ``best``: most code points, then smallest id (null last), then smallest row number."""
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    salted = with_salts(rows.select("row_no", "doc_id", "text", "chars", "digest"), crowded,
                        F.shiftright("row_no", _TASK_BITS))
    # Each task combines its own rows before the exchange; this is the local step.
    by_salt = (
        salted.select("digest", "salt", "salts", normalised(F.col("text")).alias("content"), best.alias("best"))
        .groupBy("digest", "salt", "salts", "content").agg(F.min("best").alias("best"), F.count("*").alias("n")))
    # A text that is alone under a digest with one salt has no copies anywhere.
    open_ = stored(by_salt.filter("n > 1 or salts > 1").select("digest", "content", "best", "n"), "copies-salted")
    whole = open_.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    several = F.col("n") < F.col("total")
    return stored(whole.join(repeated, "digest").select(
        "digest", F.when(several, F.col("content")).alias("content"), "best", "n"), "copies-classes")


def judged_rows(rows: DataFrame, crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with ``keep_id``, ``group_size`` and ``kept``. Rows meet their class by digest, a
    crowded digest in as many places as it has salts; under digests of several texts the texts
    are compared."""
    several = classes.filter("content is not null")
    crossed = several.select("digest").distinct()
    plain = with_salts(rows.join(crossed, "digest", "left_anti"), crowded, F.col("row_no"))
    places = classes.filter("content is null").select("digest", "best", "n").join(
        F.broadcast(crowded), "digest", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    plain = plain.join(places, ["digest", "salt"], "left").drop("salts", "salt")
    mixed = rows.join(crossed, "digest", "left_semi").withColumn("content", normalised(F.col("text"))).join(
        several, ["digest", "content"], "left").drop("content")
    alone = F.col("best").isNull()
    return plain.unionByName(mixed).select(
        *[c for c in rows.columns],
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row_no") == F.col("row_no"))).alias("kept"))


def _judged(docs, id_col, text_col, digest, shares, *more):
    rows = tagged_rows(docs, id_col, text_col, digest)
    repeated = repeated_digests(rows)
    crowded = crowded_digests(repeated, rows.count(), shares)
    classes = copy_classes(rows, repeated, crowded)
    return judged_rows(rows.select("row_no", "doc_id", "digest", "text", *more), crowded, classes)


def exact_copies(docs: DataFrame, id_col="doc_id", text_col="text", digest=content_digest, shares=SHARES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row.

    A null text counts as empty, so null, empty and blank texts are one group. Of rows that repeat
    in id and text one is kept, and all name the same ``keep_id``. A null id sorts last and can
    be ``keep_id`` of its group. Other columns and their names play no part; an empty table
    gives an empty result."""
    return _judged(docs.select(id_col, text_col), id_col, text_col, digest, shares).select(
        "doc_id", "keep_id", "group_size", "kept", "digest")


def without_copies(docs: DataFrame, id_col="doc_id", text_col="text", digest=content_digest, shares=SHARES) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and unchanged."""
    names = {id_col: "doc_id", text_col: "text"}
    kept = _judged(docs, id_col, text_col, digest, shares, "row").filter("kept")
    return kept.select(*[F.col(names[c] if c in names else f"row.`{c}`").alias(c) for c in docs.columns])
