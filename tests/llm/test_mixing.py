import re
from collections import defaultdict

from pyspark.sql import functions as F

from eventloom.llm import source_mixing
from tests.llm.support import blank_words, documents


def plain_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(blank_words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / share > 3 * sizes[s]} if share else set()
        if not over:
            return {s: (sizes[s], 3.0 * sizes[s] if s in full else rest * weight[s] / share) for s in names}
        full |= over


def judge(frame, **options):
    rows = [(r.doc_id, r.text, r.source) for r in frame.select("doc_id", "text", "source").collect()]
    expected = plain_targets(rows)
    out = source_mixing.mixed_documents(frame, **options).collect()
    assert len(out) == len(rows)
    source, size = {d: s for d, _, s in rows}, {d: len(blank_words(t)) for d, t, _ in rows}
    taken = defaultdict(int)
    for r in out:
        own, target = expected[source[r.doc_id]]
        assert (r.size, r.source_size) == (size[r.doc_id], own)
        assert abs(r.target - target) <= 1e-6 * max(1, target)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, (_, target) in expected.items():
        assert target - 1 <= taken[s] <= target or target < 1, (s, taken[s], target)
    return sorted(map(tuple, out), key=str)


def test_targets_and_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert judge(docs) == judge(docs.repartition(7))


def test_capped_sources_and_null_source(spark):
    rows = [(k, "w " * (k % 7), "en", ["a", "b", "B", "é", None][k % 5], None) for k in range(40)]
    rows += [(100, "x " * 4000, "en", "huge", None), (101, None, "en", "void", None), (102, "", None, "void", None)]
    judge(documents(spark, rows), slot_words=16)


def test_edges(spark):
    assert source_mixing.mixed_documents(documents(spark, [])).collect() == []
    nothing = documents(spark, [(1, "", None, "a", None), (2, None, None, None, None)])
    assert sorted(tuple(r)[1:] for r in source_mixing.mixed_documents(nothing).collect()) == [(0, 0, 0.0, 0)] * 2
    same = documents(spark, [(1, "a b c", None, "s", None)] * 3 + [(2, "d e", None, "t", None)]).withColumn(
        "size", F.lit("clash")).withColumn("source_rank", F.lit(1))
    out = source_mixing.mixed_documents(same).collect()
    assert sum(r.taken for r in out if r.doc_id == 1) + sum(r.taken for r in out if r.doc_id == 2) in (9, 10, 11)


def test_slots_keep_their_shares_in_any_stretch(spark):
    targets = spark.createDataFrame([(1, 600.0), (2, 300.0), (3, 100.0)], "source_rank int, target double")
    slots = sorted(tuple(r) for r in source_mixing.slot_schedule(targets, 1).collect())
    assert [s for s, _, _ in slots] == list(range(1001))
    for begin in range(0, 1000, 100):
        part = [s for _, s, _ in slots[begin:begin + 100]]
        assert abs(part.count(1) - 60) <= 3 and abs(part.count(2) - 30) <= 3
    for source in (1, 2, 3):
        assert [b for _, s, b in slots if s == source] == list(range(sum(s == source for _, s, _ in slots)))


def test_no_python_in_the_plan(spark):
    plan = source_mixing.mixed_documents(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
