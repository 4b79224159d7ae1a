"""Hard negatives for contrastive training, by exact scores of whole vectors.

Anchors and candidates meet in tiles. A tile's scores are an int64 product by Strassen's recursion:
both sides are padded with zeros, halved in every dimension, and seven products instead of
eight are put together by integer additions. These wrap around at 2**64 like all arithmetic on
longs, so that every score that fits a long is exact. From the scores each tile keeps short
lists, which merge: an anchor's best positives, then per positive the best negatives in its window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.llm.storage import stored

#: Anchors and candidates that meet in one task, and those of one tile.
ANCHOR_ROWS = 16_384
CANDIDATE_ROWS = 32_768
TILE_ROWS = 1024
#: Labels are hashed into so many shelves; positives are looked for on the anchor's own shelf only.
LABEL_SHELVES = 64
#: Width at or below which a product is not split further.
LEAF = 32

_LEAST = np.iinfo(np.int64).min


def labelled_vectors(vectors: DataFrame, scale: float, label: Column | None = None, id_col="vec_id",
                     vector_col="embedding", label_col="label") -> DataFrame:
    """(row_no, vec_id, label, parts), stored: every component x as floor(scale * x), a long.

    Rows whose label or vector is null, or whose vector holds a null or non-finite component, take
    no part. Shorter vectors are filled with zeros up to the longest. Components so large that
    a score could leave the range of a long are an error."""
    doubles = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(f"`{label_col}`") if label is None else label
    valid = vectors.filter(finite & F.col(f"`{label_col}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("row_no"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.transform(doubles, lambda x: F.floor(x * scale)).alias("parts"),
        F.array_max(F.transform(doubles, lambda x: F.abs(x * scale))).alias("_most"))
    valid = stored(valid, "negatives-vectors")
    width, most = valid.agg(F.max(F.size("parts")), F.max("_most")).first()
    if width and float(most or 0) + 1 >= (2.0 ** 63 / width) ** 0.5:
        raise ValueError(f"components up to {most} make scores beyond a long")
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(width or 0) - F.size("parts"))
    return valid.select("row_no", "vec_id", "label", F.concat("parts", fill).alias("parts"))


def padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if matrix.shape == (rows, columns):
        return matrix
    out = np.zeros((rows, columns), np.int64)
    out[:matrix.shape[0], :matrix.shape[1]] = matrix
    return out


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product, taken on doubles where every sum is sure to be below 2**53."""
    x, y = a.astype(float), b.astype(float)
    if np.abs(x).max() * np.abs(y).max() * a.shape[1] < 2.0 ** 53:
        return (x @ y).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices modulo 2**64, exact where it fits a long."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if not rows * inner * columns:
        return np.zeros((rows, columns), np.int64)
    if min(rows, inner, columns) <= leaf:
        return leaf_product(a, b)
    r, i, c = -(-rows // 2), -(-inner // 2), -(-columns // 2)
    a, b = padded(a, 2 * r, 2 * i), padded(b, 2 * i, 2 * c)
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low_left = strassen(a21 + a22, b11, leaf)
    high_left = strassen(a11, b12 - b22, leaf)
    low_right = strassen(a22, b21 - b11, leaf)
    high_right = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = both + low_right - high_right + strassen(a12 - a22, b21 + b22, leaf)
    out[:r, c:] = high_left + high_right
    out[r:, :c] = low_left + low_right
    out[r:, c:] = both - low_left + high_left + strassen(a21 - a11, b11 + b12, leaf)
    return out[:rows, :columns]


class ShortLists:
    """The best ``size`` of what was put in, per list: higher scores first, ties by place."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.scores = np.zeros((lists, 0), np.int64)
        self.places = np.zeros((lists, 0), np.int64)
        self.known = np.zeros((lists, 0), bool)

    def floor(self) -> np.ndarray:
        """The score a further item must reach to matter."""
        if self.scores.shape[1] < self.size:
            return np.full(len(self.scores), _LEAST)
        return np.where(self.known[:, -1], self.scores[:, -1], _LEAST)

    def add(self, scores: np.ndarray, open_: np.ndarray, first: int) -> None:
        """Merge in a tile: the items of ``open_``, whose places start at ``first``."""
        open_ = open_ & (scores >= self.floor()[:, None])
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            return
        scores, open_ = scores[active], open_[active]
        surplus = scores.shape[1] - self.size
        if surplus > 0:  # whatever is below the last that fits cannot stay
            masked = np.where(open_, scores, _LEAST)
            open_ &= scores >= np.partition(masked, surplus, axis=1)[:, surplus][:, None]
        row, column = np.nonzero(open_)
        held = np.nonzero(self.known[active])
        rows = np.concatenate([held[0], row])
        values = np.concatenate([self.scores[active][held], scores[row, column]])
        places = np.concatenate([self.places[active][held], first + column])
        # Of longs, ~v is the order of v turned round, without overflow.
        order = np.lexsort((places, ~values, rows))
        rows, values, places = rows[order], values[order], places[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        fits = rank < self.size
        kept = [np.zeros((len(self.scores), self.size), t) for t in (np.int64, np.int64, bool)]
        width = self.scores.shape[1]
        for new, old in zip(kept, (self.scores, self.places, self.known)):
            new[:, :width] = old
            new[active] = 0
        at = active[rows[fits]], rank[fits]
        kept[0][at], kept[1][at], kept[2][at] = values[fits], places[fits], True
        self.scores, self.places, self.known = kept


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values = table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(table.num_rows, len(values) // table.num_rows)


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _tiles(anchors: pa.Table, candidates: pa.Table, tile_rows: int):
    """(slice of anchors, first candidate, slice of candidates, scores) of all tiles."""
    a, b = _matrix(anchors, "parts"), _matrix(candidates, "parts")
    for i in range(0, len(a), tile_rows):
        for j in range(0, len(b), tile_rows):
            rows, columns = slice(i, i + tile_rows), slice(j, j + tile_rows)
            yield rows, j, columns, strassen(a[rows], np.ascontiguousarray(b[columns].T))


def _in_tie_order(candidates: pa.Table) -> pa.Table:
    """Candidates by id, null last, so that places decide ties."""
    return candidates.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])


def _blocks(vectors: DataFrame, rows_per_block: int) -> tuple[DataFrame, int]:
    """The vectors with ``block``, and the blocks ``first`` to ``last`` of their shelf; the number
    of blocks. A block holds about ``rows_per_block`` rows, and one label may fill many."""
    shelf = F.pmod(F.xxhash64("label"), F.lit(LABEL_SHELVES)).cast("int")
    sizes = {s: n for s, n in vectors.groupBy(shelf.alias("s")).count().collect()}  # at most LABEL_SHELVES rows
    parts = [max(1, -(-sizes.get(s, 0) // rows_per_block)) for s in range(LABEL_SHELVES)]
    first, last = (F.element_at(F.array(*map(F.lit, numbers)), shelf + 1) for numbers in (
        [sum(parts[:s]) for s in range(LABEL_SHELVES)], [sum(parts[:s + 1]) - 1 for s in range(LABEL_SHELVES)]))
    shelved = vectors.withColumns({"first": first, "last": last})
    part = F.pmod(F.xxhash64("row_no"), F.col("last") - F.col("first") + 1).cast("int")
    return shelved.withColumn("block", F.col("first") + part), sum(parts)


def _meet(anchors: DataFrame, candidates: DataFrame, groups: int, blocks, run, schema: str) -> DataFrame:
    """Groups of anchors with the blocks they ask for, an array column of numbers."""
    group = F.pmod(F.xxhash64("row_no"), F.lit(groups)).cast("int")
    asked = anchors.withColumns({"group": group, "block": F.explode(blocks)}).drop("first", "last")
    found = candidates.select("row_no", "vec_id", "label", "parts", "block", F.explode(
        F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    empty = pa.table([pa.array([], pa.int64())] * len(_names(schema)), names=_names(schema))

    def guarded(anchor_table: pa.Table, candidate_table: pa.Table) -> pa.Table:
        if not anchor_table.num_rows or not candidate_table.num_rows:
            return empty
        return run(anchor_table, _in_tie_order(candidate_table))

    keys = ["block", "group"]
    return asked.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(guarded, schema)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _merged(lists: DataFrame, keys: list[str], size: int, other: str) -> DataFrame:
    """The best ``size`` of each list over all tasks, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last(f"{other}_id"), f"{other}_row")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


POSITIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, score long"
NEGATIVE = ("anchor_row long, positive_row long, positive_score long, anchor_id long, positive_id long, "
            "negative_row long, negative_id long, score long")


def _picked(table: pa.Table, names: list[str], at: np.ndarray) -> list[pa.Array]:
    taken = table.select(names).take(pa.array(at))
    return [taken[n].combine_chunks() for n in names]


def best_positives(anchors: DataFrame, vectors: DataFrame, positives: int, groups: int,
                   tile_rows=TILE_ROWS) -> DataFrame:
    """(anchor_row, anchor_id, positive_row, positive_id, score, rank)."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        own, label = _long(asked, "row_no"), _long(asked, "label")
        rows, labels = _long(found, "row_no"), _long(found, "label")
        lists = {}
        for part, first, columns, scores in _tiles(asked, found, tile_rows):
            open_ = (label[part, None] == labels[None, columns]) & (own[part, None] != rows[None, columns])
            lists.setdefault(part.start, ShortLists(len(scores), positives)).add(scores, open_, first)
        anchor, place, score = _gathered(lists)
        return pa.table([*_picked(asked, ["row_no", "vec_id"], anchor), *_picked(found, ["row_no", "vec_id"], place),
                         pa.array(score)], names=_names(POSITIVE))

    shelf = F.sequence("first", "last")
    return _merged(_meet(anchors, vectors, groups, shelf, run, POSITIVE), ["anchor_row"], positives, "positive")


def _gathered(lists: dict[int, ShortLists]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of all lists, whose first rows are the keys."""
    parts = [(at + row, best.places[row, column], best.scores[row, column])
             for at, best in lists.items() for row, column in [np.nonzero(best.known)]]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(column) for column in zip(*parts))


def least_percent(score: np.ndarray, percent: int) -> np.ndarray:
    """The least whole x with 100 * x >= percent * score, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * percent - (-rest * percent) // 100


def best_negatives(pairs: DataFrame, vectors: DataFrame, negatives: int, percent: int, groups: int,
                   blocks: int, tile_rows=TILE_ROWS) -> DataFrame:
    """The best rows of another label within the window of each (anchor, positive). ``pairs`` holds
    an anchor's vector once, and its positives as an array."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        label, labels = _long(asked, "label"), _long(found, "label")
        listed = asked["positives"].to_pylist()
        out = []
        for number in range(max(map(len, listed), default=0)):
            having = np.array([k for k, p in enumerate(listed) if len(p) > number])
            score = np.array([listed[k][number]["score"] for k in having], np.int64)
            out.append((having, score, {}))
        for part, first, columns, scores in _tiles(asked, found, tile_rows):
            other = label[part, None] != labels[None, columns]
            for having, score, lists in out:
                inside = (having >= part.start) & (having < part.start + len(scores))
                if not inside.any():
                    continue
                lines, high = having[inside] - part.start, score[inside]
                low = least_percent(high, percent)
                values = scores[lines]
                open_ = other[lines] & (values >= low[:, None]) & (values <= high[:, None])
                start = int(np.flatnonzero(inside)[0])
                lists.setdefault(start, ShortLists(len(lines), negatives)).add(values, open_, first)
        tables = []
        for number, (having, score, lists) in enumerate(out):
            line, place, value = _gathered(lists)
            anchor = having[line]
            chosen = [listed[k][number] for k in anchor]
            rows, ids = _picked(asked, ["row_no", "vec_id"], anchor)
            tables.append(pa.table([
                rows, pa.array([c["row"] for c in chosen], pa.int64()), pa.array(score[line]), ids,
                pa.array([c["id"] for c in chosen], pa.int64()), *_picked(found, ["row_no", "vec_id"], place),
                pa.array(value)], names=_names(NEGATIVE)))
        return pa.concat_tables(tables)

    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    lists = _meet(pairs, vectors, groups, every, run, NEGATIVE)
    return _merged(lists, ["anchor_row", "positive_row"], negatives, "negative")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives=5, negatives=5, percent=80,
                   anchor_rows=ANCHOR_ROWS, candidate_rows=CANDIDATE_ROWS, tile_rows=TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is the output of ``labelled_vectors``. An anchor's positives are its best
    ``positives`` other rows of the same label; the negatives of each are the best
    ``negatives`` rows of other labels whose score is at most the positive's and at least
    ``percent`` hundredths of it. Higher scores come first, ties by id (null last).

    Rows are told apart by themselves, not by id: rows that repeat are positives of each other, and
    anchors that repeat have results of their own. A positive with an empty window, as any
    with a negative score, has no rows. An empty table gives an empty result."""
    groups = max(1, -(-vectors.filter(is_anchor).count() // anchor_rows))
    shelved, blocks = _blocks(vectors, candidate_rows)
    anchors = shelved.filter(is_anchor).drop("block")
    chosen = stored(best_positives(anchors, shelved, positives, groups, tile_rows), "negatives-positives")
    # At most ``positives`` items per anchor.
    listed = chosen.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("positive_row").alias("row"), F.col("positive_id").alias("id"), "score"))).alias("positives"))
    pairs = stored(anchors.join(listed, anchors["row_no"] == listed["anchor_row"]).drop("anchor_row"),
                   "negatives-pairs")
    found = best_negatives(pairs, shelved, negatives, percent, groups, blocks, tile_rows)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", F.col("score").alias("negative_score"))
