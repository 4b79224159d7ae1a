"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. For a query at distance d
of a pivot, a vector at distance r of the same pivot is at least |d - r| away (triangle
inequality), so its inner product is at most (|q|^2 + |x|^2 - (d - r)^2) / 2. Annuli, sorted
by their distance to the query's, are expanded until that bound is below the k-th score held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from eventloom.llm.storage import stored

#: Vectors sampled for pivots and annuli, those with the smallest hashes.
SAMPLE_ROWS = 4096
#: Vectors and queries one task compares, about.
SHELF_ROWS = 16_384
QUERY_ROWS = 1024
#: Vectors per annulus expanded at once within a shelf.
RING_ROWS = 1024
MOST_PIVOTS = 64
MOST_RINGS = 64


def whole_vectors(vectors: DataFrame, scale: float, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, parts): every component x as floor(scale * x), a long.

    Vectors that are null or hold null or non-finite components take no part. Shorter
    vectors are filled with zeros up to the longest."""
    doubles = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = vectors.filter(F.col(vector_col).isNotNull()).filter(finite).select(
        F.col(id_col).alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * scale)).alias("parts"))
    width = valid.agg(F.max(F.size("parts"))).first()[0] or 0
    return valid.withColumn("parts", F.concat("parts", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("parts"))))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: on doubles as long as every sum is below 2**53."""
    most = (np.abs(left).max(initial=0).astype(float) * np.abs(right).max(initial=0).astype(float)
            * max(1, left.shape[1]))
    if most < 2.0 ** 53:
        return np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


@dataclass
class Pivots:
    """Pivots and, for each, the distances that part its annuli: of bounded size."""

    centres: np.ndarray
    cuts: list[np.ndarray]

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(annulus, pivot, distance) of each row."""
        rows = rows.astype(float)
        distances = np.sqrt(np.maximum(
            (rows ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1) - 2 * rows @ self.centres.T, 0))
        pivot = distances.argmin(1) if len(self.centres) else np.zeros(len(rows), int)
        distance = distances[np.arange(len(rows)), pivot]
        ring = np.array([np.searchsorted(self.cuts[p], d) for p, d in zip(pivot, distance)], np.int64)
        return pivot * MOST_RINGS + ring, pivot, distance


def fit_pivots(sample: np.ndarray, rows: int, shelf_rows: int = SHELF_ROWS) -> Pivots:
    """Pivots by a few rounds of nearest-centre averaging on the sample, annuli by quantiles of
    distance; as many as give ``shelf_rows`` vectors an annulus, up to the most allowed."""
    wanted = max(1, -(-rows // shelf_rows))
    pivots = min(MOST_PIVOTS, max(1, round(wanted ** 0.5)), max(1, len(sample)))
    rings = min(MOST_RINGS, -(-wanted // pivots))
    sample = sample.astype(float)
    centres = sample[np.linspace(0, max(0, len(sample) - 1), pivots).astype(int)] if len(sample) else np.zeros(
        (1, sample.shape[1]))
    plain = Pivots(centres, [np.zeros(0)] * len(centres))
    for _ in range(8):
        pivot = plain.keys(sample)[1] if len(sample) else np.zeros(0, int)
        centres = np.array([sample[pivot == p].mean(0) if (pivot == p).any() else centres[p]
                            for p in range(len(centres))])
        plain = Pivots(centres, plain.cuts)
    _, pivot, distance = plain.keys(sample) if len(sample) else (None, np.zeros(0, int), np.zeros(0))
    cuts = [np.quantile(distance[pivot == p], np.arange(1, rings) / rings) if (pivot == p).any() else np.zeros(0)
            for p in range(len(centres))]
    return Pivots(centres, cuts)


def pivot_index(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """(vec_id, parts, annulus, distance, norm) of every vector."""
    schema = T.StructType([*vectors.select("vec_id", "parts").schema.fields]).add("annulus", "long").add(
        "distance", "double").add("norm", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1))
            annulus, _, distance = pivots.keys(rows)
            norm = (rows.astype(float) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(annulus), pa.array(distance), pa.array(norm)], names=schema.names)

    return vectors.select("vec_id", "parts").mapInArrow(run, schema)


def _bounds(norms, to_pivot, near, far, most):
    """Largest possible inner products: queries (rows) against annuli (columns)."""
    gap = np.maximum(np.maximum(to_pivot - far, near - to_pivot), 0)
    # A little slack for rounding of the distances.
    return (norms[:, None] + most - gap ** 2) / 2 * (1 + 1e-9) + 1e-6 * (1 + norms[:, None] + most)


def _admitted(queries: DataFrame, pivots: Pivots, annuli: pd.DataFrame, first_only: bool) -> DataFrame:
    """(query_key, query_id, parts, least, annulus): the annuli a query must look into.

    ``first_only``: that of the best bound alone. Otherwise all others whose bound reaches
    ``least``, the k-th score the query already holds."""
    ids = annuli["annulus"].to_numpy()
    pivot = ids // MOST_RINGS
    near, far, most = (annuli[c].to_numpy() for c in ("near", "far", "most"))
    schema = T.StructType([*queries.schema.fields]).add("annulus", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(2)).astype(float)
            norms = (rows ** 2).sum(1)
            to_pivot = np.sqrt(np.maximum(
                norms[:, None] + (pivots.centres ** 2).sum(1) - 2 * rows @ pivots.centres.T, 0))[:, pivot]
            bounds = _bounds(norms, to_pivot, near, far, most)
            best = bounds.argmax(1)
            if first_only:
                row, column = np.arange(len(rows)), best
            else:
                least = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                open_ = ~(bounds < np.where(np.isnan(least), -np.inf, least)[:, None])
                open_[np.arange(len(rows)), best] = False
                row, column = np.nonzero(open_)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[column])], names=schema.names)

    return queries.mapInArrow(run, schema)


def _search(index: DataFrame, asked: DataFrame, annuli: pd.DataFrame, pivots: Pivots, query_count: int, k: int,
            shelf_rows: int, query_rows: int) -> DataFrame:
    """(query_key, query_id, vec_id, score): the best k of each shelf for each query that asks for it."""
    spark = index.sparkSession
    chunks = spark.createDataFrame(
        [(int(a), max(1, -(-int(n) // shelf_rows))) for a, n in zip(annuli["annulus"], annuli["n"])],
        "annulus long, chunks int")
    groups = max(1, -(-query_count // query_rows))
    # A shelf is a bounded part of an annulus, met by one bounded group of queries.
    chunk = F.pmod(F.xxhash64("vec_id", "parts"), F.col("chunks")).cast("int")
    shelves = index.join(F.broadcast(chunks), "annulus").select(
        "annulus", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
        "vec_id", "parts", "distance", "norm")
    asked = asked.join(F.broadcast(chunks), "annulus").select(
        "annulus", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.col("query_key"), F.lit(groups)).cast("int").alias("part"), "query_key", "query_id", "query", "least")

    def run(shelf: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if shelf.num_rows and queries.num_rows:
            shelf = shelf.sort_by("distance").combine_chunks()
            queries = queries.combine_chunks()
            rows, wanted = (matrix(t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c])
                            for t, c in ((shelf, "parts"), (queries, "query")))
            ids = shelf["vec_id"].to_pandas().astype("Int64")
            missing = ids.isna().to_numpy()
            ids = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            distance, norm = shelf["distance"].to_numpy(), shelf["norm"].to_numpy()
            own, keys = queries["query_id"].to_numpy(), queries["query_key"].to_numpy()
            least = queries["least"].to_numpy(zero_copy_only=False).astype(float)
            least = np.where(np.isnan(least), -np.inf, least)
            norms = (wanted.astype(float) ** 2).sum(1)
            pivot = int(shelf["annulus"][0].as_py()) // MOST_RINGS
            to_pivot = np.sqrt(np.maximum(
                norms + (pivots.centres[pivot] ** 2).sum() - 2 * wanted.astype(float) @ pivots.centres[pivot], 0))
            rings = [slice(b, min(b + RING_ROWS, len(rows))) for b in range(0, len(rows), RING_ROWS)]
            bounds = np.column_stack([_bounds(
                norms, to_pivot[:, None], distance[r][0], distance[r][-1], norm[r].max())[:, 0] for r in rings])
            held: list[list[tuple[int, int, bool]]] = [[] for _ in wanted]
            # Each query goes through the rings from the best bound on, all queries together step by step.
            order = np.argsort(-bounds, axis=1, kind="stable")
            going = np.arange(len(wanted))
            for step in range(len(rings)):
                going = going[~(bounds[going, order[going, step]] < least[going])]
                for number in np.unique(order[going, step]):
                    asking = going[order[going, step] == number]
                    ring = rings[number]
                    scores = inner_products(wanted[asking], rows[ring])
                    scores = np.where(ids[ring][None, :] == own[asking][:, None], np.iinfo(np.int64).min, scores)
                    for at, q in enumerate(asking):
                        line = scores[at]
                        fit = np.flatnonzero((line >= least[q]) & (line != np.iinfo(np.int64).min))
                        if len(fit) > k:
                            cut = np.partition(line[fit], len(fit) - k)[len(fit) - k]
                            fit = fit[line[fit] >= cut]
                        if len(fit):
                            new = zip((-line[fit]).tolist(), ids[ring][fit].tolist(), missing[ring][fit].tolist())
                            held[q] = sorted([*held[q], *new])[:k]
                            if len(held[q]) == k:
                                least[q] = max(least[q], -held[q][-1][0])
            for q, best in enumerate(held):
                out[0].extend([keys[q]] * len(best))
                out[1].extend([own[q]] * len(best))
                out[2].extend(None if gone else i for _, i, gone in best)
                out[3].extend(-s for s, _, _ in best)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_key", "query_id", "vec_id", "score"])

    keys = ["annulus", "chunk", "part"]
    return shelves.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        run, "query_key long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, shelf_rows: int = SHELF_ROWS,
                query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, ties to the smaller
    vec_id (null last), the rows of the query's own id left out.

    Both tables hold (vec_id, parts) from ``whole_vectors``. A query row that repeats counts
    once; rows of one id but other vectors are queries of their own. Only pivots and annuli are
    fitted on a sample; every vector is indexed and bounds decide what is not compared."""
    vectors = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "parts"), "topk-vectors")
    queries = stored(queries.filter("vec_id is not null").select(
        F.xxhash64("vec_id", "parts").alias("query_key"), F.col("vec_id").cast("long").alias("query_id"),
        F.col("parts").alias("query")).distinct(), "topk-queries")
    count, query_count = vectors.count(), queries.count()
    sample = vectors.orderBy(F.xxhash64("vec_id", "parts"), "vec_id").limit(sample_rows).select("parts").toArrow()
    pivots = fit_pivots(matrix(sample["parts"].combine_chunks()), count, shelf_rows)
    index = stored(pivot_index(vectors, pivots), "topk-index")
    # At most MOST_PIVOTS * MOST_RINGS rows.
    annuli = index.groupBy("annulus").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("most"),
        F.count("*").alias("n")).toPandas()
    asked = queries.withColumn("least", F.lit(None).cast("long"))
    search = lambda asked: _search(index, asked, annuli, pivots, query_count, k, shelf_rows, query_rows)
    if annuli.empty:
        first = asked.select("query_key", "query_id", F.lit(0).cast("long").alias("vec_id"),
                             F.lit(0).cast("long").alias("score")).limit(0)
        found = first
    else:
        first = stored(search(_admitted(asked, pivots, annuli, True)), "topk-first")
        ranked = first.withColumn("place", F.row_number().over(
            Window.partitionBy("query_key").orderBy(F.desc("score"))))
        least = ranked.filter(F.col("place") == k).select("query_key", F.col("score").alias("least"))
        rest = queries.join(least, "query_key", "left")
        found = first.unionByName(search(_admitted(rest, pivots, annuli, False)))
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
