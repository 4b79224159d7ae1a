"""Strassen products, and hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (33, 17, 40), (64, 64, 64), (100, 9, 61)])
@pytest.mark.parametrize("most", [5, 1 << 20, 1 << 27])
def test_strassen_is_exact(shape, most):
    draw = np.random.default_rng(1)
    a, b = draw.integers(-most, most, shape[:2]), draw.integers(-most, most, shape[1:])
    exact = a.astype(object) @ b.astype(object)
    assert (hn.strassen(a, b, leaf=2) == exact).all() and (hn.strassen(a, b) == exact).all()


def test_strassen_of_nothing():
    assert hn.strassen(np.zeros((3, 0), np.int64), np.zeros((0, 2), np.int64)).tolist() == [[0, 0]] * 3


def test_short_lists_keep_the_best_in_order_of_place():
    draw = np.random.default_rng(2)
    scores, open_ = draw.integers(-3, 4, (6, 90)), draw.random((6, 90)) < .6
    best = hn.ShortLists(6, 5)
    for first in range(0, 90, 11):
        best.add(scores[:, first:first + 11], open_[:, first:first + 11], first)
    for row in range(6):
        expected = sorted((-scores[row, k], k) for k in range(90) if open_[row, k])[:5]
        assert [(-s, p) for s, p, known in zip(best.scores[row], best.places[row], best.known[row]) if known] == expected


def test_window_edge_without_overflow():
    for score in (-7, -5, 0, 1, 4, 5, 99, 100, 101, (1 << 62) + 3):
        least = int(hn.least_percent(np.array([score]), 80)[0])
        assert 100 * least >= 80 * score > 100 * (least - 1)


def plain_negatives(rows, scale, positives=5, negatives=5):
    """Rows of (vec_id, vector, label) to the expected result, by all scores."""
    width = max((len(v) for _, v, _ in rows), default=0)
    whole = [(i, np.floor(scale * np.array(v + [0.0] * (width - len(v)), float)).astype(np.int64), y) for i, v, y in rows]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (anchor, vector, label) in enumerate(whole):
        if anchor is None or anchor % 10:
            continue
        scored = [(int(vector @ x), i, y) for n, (i, x, y) in enumerate(whole) if n != k]
        for score, positive, _ in sorted((r for r in scored if r[2] == label), key=order)[:positives]:
            fits = [r for r in scored if r[2] != label and 80 * score <= 100 * r[0] <= 100 * score]
            for rank, (value, negative, _) in enumerate(sorted(fits, key=order)[:negatives], 1):
                out.append((anchor, positive, rank, negative, score, value))
    return out


@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 7, "candidate_rows": 20, "tile_rows": 6}])
def test_equals_all_scores(spark, sizes):
    draw = np.random.default_rng(5)
    rows = [(k, draw.normal(0, 2, 9).round(1).tolist(), int(k) % 3 if k % 4 else 0) for k in range(240)]
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 0), (None, rows[20][1], 2), (300, [1.0, 2.0], 0), (301, [], 1)]
    rows += [(400 + k, rows[30][1], k % 2) for k in range(30)]
    odd = [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 9, 1), (530, [float("-inf")], 1), (540, [1.0], None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns(
        {"score": F.lit("clash"), "row_no": F.lit(0), "block": F.lit(None).cast("string")})
    vectors = hn.labelled_vectors(frame, 4.0)
    found = hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0, **sizes).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain_negatives(rows, 4.0)))


def test_no_rows_and_no_components(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(10, [], 1), (11, [], 1), (12, [], 2)]):
        vectors = hn.labelled_vectors(spark.createDataFrame(rows, schema), 4.0)
        found = hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()
        assert [tuple(r) for r in found] == ([(10, 11, 1, 12, 0, 0)] if rows else [])


def test_scores_beyond_a_long_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e300], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="beyond a long"):
        hn.labelled_vectors(frame, 4.0)
