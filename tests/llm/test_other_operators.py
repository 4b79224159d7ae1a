"""Top-k, URL lists, quality, bundles, token counts and line dedup on edge rows; the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from eventloom.llm import exact_topk, line_dedup, quality_ranking, token_counts, url_lists, warc_bundles
from eventloom.llm.oracle import SQL
from tests.llm.support import documents, texts
from tests.support import TESTDATA

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    return sorted(tuple(str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"create view {table} as select * from '{TESTDATA}/sf0.001/{table}.parquet'")
    frame = queries()[name](spark, f"{TESTDATA}/sf0.001")
    other = connection.execute(SQL[name])
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(frame.columns)
    assert plain(frame.select(*names).collect()) == plain(other.fetchall())


@pytest.mark.parametrize("shelf_rows", [16_384, 40])
def test_top_k_equals_all_scores(spark, shelf_rows):
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 3, (6, 8))
    rows = [(k, (centres[k % 6] + draw.normal(0, .3, 8)).tolist()) for k in range(400)]
    rows += [(400 + k, rows[20][1]) for k in range(40)] + [
        (500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")]), (504, [1.0, 2.0]), (505, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("distance", F.lit("clash"))
    vectors = exact_topk.whole_vectors(frame, 64.0)
    found = exact_topk.exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, shelf_rows=shelf_rows, query_rows=7)
    whole = {i: np.floor(64 * np.array((v + [0.0] * 8)[:8])).astype(int) for i, v in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:20]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vectors = exact_topk.whole_vectors(none, 64.0)
    assert exact_topk.exact_top_k(vectors, vectors, 5).collect() == []


def test_every_prefix_count_is_the_library_s(spark):
    counter, draw = token_counts.counter(MODEL), random.Random(2)
    values = ["", " ", "  a b", "a\n b\t\tc", "trailing ", " " * 40 + ".", "é  ▁ x", "日本 語", "😀 ok", "a" * 200, "<s> </s>"]
    values += ["".join(draw.choice(" ab\n▁é日#1A.") for _ in range(draw.randint(0, 25))) for _ in range(200)]
    for value in values:
        counts = np.cumsum(np.frombuffer(counter.deltas(value), np.int8).astype(int))
        assert counts.tolist() == [len(counter.library.encode(value[:n])) for n in range(1, len(value) + 1)]
    frame = texts(spark, [*values, None, values[2]])
    got = token_counts.token_counts(frame, MODEL).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [
        (k, len(counter.library.encode(v or ""))) for k, v in enumerate([*values, None, values[2]])]
    cut = token_counts.truncation_points(token_counts.prefix_table(frame, MODEL), 5).collect()
    for r in cut:
        text = [*values, None, values[2]][r.doc_id] or ""
        fit = [n for n in range(len(text) + 1) if len(counter.library.encode(text[:n])) <= 5]
        assert (r.n_chars, r.n_tokens) == (fit[-1], len(counter.library.encode(text[:fit[-1]])))
    assert token_counts.token_counts(documents(spark, []), MODEL).collect() == []


def test_quality_of_held_out_documents(spark):
    base = f"{TESTDATA}/sf0.1"
    got = queries()["op4_quality"](spark, base)
    labels = spark.read.parquet(f"{base}/labels.parquet")
    right = got.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")))
    assert right.first()[0] > 0.97
    assert got.filter("(score >= 0.3) != (predicted = 1) or score < 0 or score > 1 or score is null").count() == 0


def test_features_do_not_depend_on_other_rows():
    draw = random.Random(5)
    values = ["".join(draw.choice("aB1 .,!#\n\té") for _ in range(draw.randint(0, 60))) for _ in range(120)]
    alone = np.vstack([quality_ranking.text_features(pa.array([v])) for v in values])
    for _ in range(5):
        order = draw.sample(range(120), 120)
        together = quality_ranking.text_features(pa.array([values[k] for k in order]))
        assert (together == alone[order]).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "", None, None, None), (None, None, None, None, None), (1, "", None, None, None)]
    frame = documents(spark, rows).withColumn("score", F.lit("clash"))
    model = quality_ranking.fit_quality(frame, labels)
    out = quality_ranking.quality_scores(frame, model).collect()
    assert len(out) == 3 and all(r.predicted == 1 for r in out)
    assert quality_ranking.quality_scores(frame.limit(0), model).collect() == []


def test_quality_learns_the_same_from_repeated_rows(spark):
    """Rows that repeat count once, in whatever order they come; a null id is never held out."""
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choice(["good", "words", "x!!", "#", "A1"][:2 if k % 2 else 5]) for _ in range(40)), None, None, None)
            for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    frame = documents(spark, rows)
    one = quality_ranking.fit_quality(frame, labels)
    again = quality_ranking.fit_quality(documents(spark, rows[::-1] + rows[:150] * 2).repartition(3), labels)
    scored = [sorted(quality_ranking.quality_scores(frame, model).select("doc_id", "score").collect()) for model in (one, again)]
    # Sums over pairs may be rounded otherwise in another run of the same fit.
    for a, b in zip(*scored, strict=True):
        assert a.doc_id == b.doc_id and abs(a.score - b.score) < 1e-12
    nobody = documents(spark, [(None, "a", None, None, None)])
    assert [r[0] for r in nobody.select(quality_ranking.held_out()).collect()] == [False]


def test_bundles_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_bundles, "FRAME_BYTES", 400)
    rows = [(k, f"http://h/{k}\n", "é" * (k % 5 * 40)) for k in range(60)] + [(60, None, None), (None, "u", "x" * 900), (61, "v", "x" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    index = warc_bundles.write_bundles(pages, f"file://{tmp_path}")
    read = {r.page_id: r for r in warc_bundles.read_bundles(index).collect()}
    assert len(read) == len(rows)
    first = {}
    for k, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        payload = (html or "").encode()
        origin = first.setdefault(payload, k)
        r = read[k]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc_bundles.payload_digest(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if origin == k else ("revisit", origin))
        if origin == k:
            assert bytes(r.payload) == payload
    some = warc_bundles.fetch_records(index.filter("page_id in (3, 17)")).collect()
    assert {r.page_id for r in some} == {3, 17}
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(pages.limit(0))).collect() == []


def test_frames_of_a_bundle_are_read_by_several_tasks(spark):
    """The rows that name frames are few bytes; what is read is not."""
    draw = random.Random(6)
    pages = spark.createDataFrame(
        [(k, "u", draw.randbytes(400_000).hex()) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    index = warc_bundles.write_bundles(pages)
    assert index.select("bundle").distinct().count() == 1 and index.select("frame").distinct().count() == 8
    read = warc_bundles.read_bundles(index, frames_at_once=1, read_bytes=1 << 20)
    rows = read.select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in rows) == list(range(8)) and len({r.task for r in rows}) > 2


def test_lines_and_lists_on_edge_rows(spark):
    rows = [(2, "a  B\n\nkeep", None, None, None), (1, "A b\nx", None, None, None), (3, None, None, None, None),
            (None, "x", None, None, None), (4, "", None, None, None), (5, "y\nY", None, None, None)]
    out = {r.doc_id: (r.text, r.n_units, r.n_removed, r.removed_spans) for r in
           line_dedup.without_repeats(documents(spark, rows).withColumn("unit", F.lit(0)), least_words=1).collect()}
    assert out == {1: ("A b\nx", 2, 0, ""), 2: ("\nkeep", 2, 1, "0-4"), 3: (None, 0, 0, ""), None: ("", 1, 1, "0-1"),
                   4: ("", 0, 0, ""), 5: ("y", 2, 1, "2-3")}
    assert line_dedup.without_repeats(documents(spark, [])).collect() == []
    captures = spark.createDataFrame(
        [(1, "http://u@A.b.com:80/x", "2024-05-01"), (2, "http://b.com", "2024-01-01"), (3, None, "2024-05-01"),
         (4, "http://b.com", None), (1, "http://u@A.b.com:80/x", "2024-05-01")], "page_id long, url string, day string").select(
        "page_id", "url", F.to_date("day").alias("fetch_date"))
    entries = spark.createDataFrame(
        [("b.com", 1, "block", "2024-02-01"), ("b.com", 2, "allow", "2024-02-01"), ("com", 3, "block", "2020-01-01"),
         (None, 4, "block", "2020-01-01"), ("b.com", 5, "block", None)],
        "rule string, entry_id long, verdict string, day string").withColumn("entry_date", F.to_date("day"))
    got = [(r.page_id, r.rule, r.entry_id, r.verdict) for r in url_lists.judged_captures(captures, entries).collect()]
    assert sorted(got, key=str) == sorted([(1, "b.com", 2, "allow")] * 2 + [
        (2, "com", 3, "block"), (3, None, None, None), (4, None, None, None)], key=str)
    assert url_lists.judged_captures(captures.limit(0), entries).collect() == []
