"""Mix sources to target weights by a low-discrepancy schedule, on Spark's own functions only.

The mix is a row of slots. Slot n has the golden-ratio point frac(n / phi), which the sources'
cumulative shares map to a source; so any stretch of the mix holds every source near its
share. The slots of a source are ranked, and the k-th takes the k-th of the equal-token blocks
into which the source's shuffled documents, read again as often as the target asks, are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.llm.prefix_sums import running_totals
from eventloom.llm.row_keys import row_key
from eventloom.llm.storage import stored

#: Words per slot, about.
SLOT_WORDS = 512
#: Each source's target stops at so many times its size.
MOST_EPOCHS = 3
#: Golden-ratio points are multiples of 2**-31: n * GOLDEN modulo 2**31, GOLDEN = 2**31 / phi.
POINTS = 1 << 31
GOLDEN = 1_327_217_885

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight_of_rank=None) -> DataFrame:
    """From (source, size) rows: one row per source with its size, weight and target.

    Sources weigh 1, 2, 3, repeating, by code point, null last. The targets share 100 %
    of all sizes by weight; a source stops at ``MOST_EPOCHS`` times its size, and the excess
    is shared again by weight among the others until none is above. That end is reached
    in one sorted pass: sources that are full first have the least size per weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: these windows order sources, never documents.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = weight_of_rank or (lambda rank: (rank - 1) % 3 + 1)
    ranked = totals.select("source", "source_size", F.row_number().over(by_name).alias("source_rank"))
    ranked = ranked.withColumn("weight", weight(F.col("source_rank")).cast("double"))
    cap = F.col("source_size") * F.lit(float(MOST_EPOCHS))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    shared = (ranked.withColumn("cap", cap).withColumn("level", level)
              .withColumn("open", F.col("level") * F.col("weight") < F.col("cap")))
    # The level at the first source that is not full holds for all after it.
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(
        everything)
    level = first_open["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return shared.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def slot_schedule(targets: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(slot, source_rank, block): which source each slot of the mix serves, and the rank
    of the slot among those of its source.

    A source that the points miss, as its share is below a slot, has one slot at the end."""
    spark = targets.sparkSession
    everything = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = (targets.filter("target >= 1").withColumn("upto", F.sum("target").over(everything))
              .select("source_rank", "target", (F.col("upto") - F.col("target")).alias("low"), "upto"))
    total, sources = shares.agg(F.max("upto"), F.count("*")).first()
    slots = int((total or 0) // slot_words) + (1 if total else 0)
    # Points grow in whole multiples of 2**-31: each source owns a range of them. The sources
    # are cut into cells of equal width, so that a slot meets the few sources of its cell.
    cells = max(1, min(1 << 20, 4 * sources))
    scale = F.lit(float(POINTS)) / F.lit(float(total or 1))
    ranges = shares.select(
        "source_rank", F.floor(F.col("low") * scale).alias("from_point"),
        F.when(F.col("upto") == F.lit(float(total or 1)), F.lit(POINTS))
        .otherwise(F.floor(F.col("upto") * scale)).alias("to_point")).filter("to_point > from_point")
    width = -(-POINTS // cells)
    ranges = ranges.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("from_point") / width), F.floor((F.col("to_point") - 1) / width))))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    served = points.join(ranges, "cell").filter("point >= from_point and point < to_point")
    # Ranks in levels: slots of a source are counted by stretch of 65,536 slots.
    placed = served.select("source_rank", "slot", F.floor(F.col("slot") / 65536).alias("stretch"))
    counts = placed.groupBy("source_rank", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_rank", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source_rank", "stretch").orderBy("slot")) - 1
    ranked = placed.join(starts, ["source_rank", "stretch"]).select(
        "slot", "source_rank", (F.col("start") + rank).alias("block"))
    missed = shares.join(counts.select("source_rank").distinct(), "source_rank", "left_anti")
    last = missed.select((F.lit(slots) + F.col("source_rank")).cast("long").alias("slot"), "source_rank",
                         F.lit(0).cast("long").alias("block"))
    return ranked.unionByName(last)


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0,
                slot_words: int = SLOT_WORDS):
    """(sized, targets, pieces) of the mix of all documents.

    ``sized``: (row_key, id, source, size), a document each. ``pieces``: (slot, source_rank, block, row_key,
    id, from_word, n_words), the stretch of a document that a slot takes, ordered within the slot by
    ``from_place``. A null text has size 0 and is never taken; a null source is a source of its own;
    rows that repeat are documents of their own."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        row_key(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.col(text_col)).alias("row_key"))
    # Every later step needs the sizes alone: count the words of the texts once.
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized)
    schedule = slot_schedule(targets, slot_words)
    blocks = schedule.groupBy("source_rank").agg(F.count("*").alias("n_blocks"))
    known = targets.join(blocks, "source_rank").select(
        F.col("source").alias("_source"), "source_rank", "source_size", "n_blocks",
        F.floor("target").alias("wanted"))
    placed = sized.filter("size > 0").withColumn("place", F.pmod(F.col("row_key.one"), F.lit(1 << 48)))
    placed = running_totals(placed, ["source"], "place", ["row_key", "doc_id", "size"], "size", "start")
    placed = placed.join(known, placed.source.eqNullSafe(known["_source"])).drop("_source")

    # Bounds of block j in the repeated stream, the same expression wherever it is needed.
    def bound(j):
        return F.when(j >= F.col("n_blocks"), F.col("wanted")).otherwise(
            F.floor(j * (F.col("wanted") / F.col("n_blocks"))))

    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)))).select(
        "*", (F.col("epoch") * F.col("source_size") + F.col("start")).alias("from_place")).withColumn(
        "to_place", F.least(F.col("from_place") + F.col("size"), "wanted")).filter("to_place > from_place")
    step = F.col("wanted") / F.col("n_blocks")
    near = F.sequence(F.greatest(F.floor(F.col("from_place") / step) - 1, F.lit(0)),
                      F.least(F.floor(F.col("to_place") / step) + 1, F.col("n_blocks") - 1))
    cut = passes.withColumn("block", F.explode(near))
    low, high = F.greatest("from_place", bound(F.col("block"))), F.least("to_place", bound(F.col("block") + 1))
    cut = cut.withColumn("low", low).withColumn("n_words", high - low).filter("n_words > 0")
    pieces = cut.join(schedule, ["source_rank", "block"]).select(
        "slot", "source_rank", "block", "row_key", "doc_id", F.col("low").alias("from_place"),
        (F.col("low") - F.col("from_place")).alias("from_word"), "n_words")
    return sized, targets, pieces


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0,
                    slot_words: int = SLOT_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): for every document the words the mix takes of it.

    Rows that repeat in id, source and text share what the mix takes of them evenly, the remainder
    going one word each to the first."""
    sized, targets, pieces = mix_sources(docs, id_col, text_col, source_col, seed, slot_words)
    taken = pieces.groupBy("row_key").agg(F.sum("n_words").alias("taken"))
    result = sized.join(targets.select(F.col("source").alias("_source"), "source_size", "target"),
                        sized.source.eqNullSafe(F.col("_source"))).drop("_source")
    result = result.join(taken, "row_key", "left")
    alike = Window.partitionBy("row_key")
    place = F.row_number().over(alike.orderBy("doc_id")) - 1
    count = F.count("*").over(alike)
    whole = F.coalesce("taken", F.lit(0))
    share = F.floor(whole / count) + F.when(place < whole % count, 1).otherwise(0)
    return result.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))
