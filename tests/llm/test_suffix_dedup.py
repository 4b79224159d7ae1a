import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import suffix_dedup
from eventloom.llm.loser_tree import front_coded, merged
from tests.llm.support import documents, plain_removals, texts


def judged(frame, **limits):
    out = suffix_dedup.without_repeats(frame, **limits)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}


def test_loser_tree_merges_and_knows_prefixes():
    draw = random.Random(1)
    for _ in range(200):
        runs = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 6)))
                for _ in range(draw.randint(0, 9))]
        out = list(merged([iter([(s, rest, None) for s, rest in front_coded(r)]) for r in runs]))
        assert [o[1] for o in out] == sorted(text for r in runs for text in r)
        before = b""
        for shared, text, _ in out:
            assert before[:shared] == text[:shared] and before[shared:shared + 1] != text[shared:shared + 1] or before == text
            before = text


def made_texts():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short, nested = prose(60), prose(34), prose(90)
    values = [prose(80) for _ in range(12)]
    for k in range(10):
        values.append(prose(draw.randint(0, 40)) + passage + prose(draw.randint(0, 40)))
        values.append(prose(20) + nested[draw.randint(0, 120):][:draw.randint(150, 420)] + prose(20))
        values.append(prose(3) + short[k:200 + k] + prose(3))
    values += ["ab" * 300, "x" * 500, "x" * 199, "x" * 200, values[0], values[0], values[3][:230], "", None, "é" * 120]
    values += [passage + passage, values[20].replace("a", "b", 1)]
    return values


@pytest.mark.parametrize("limits", [{}, {"group_rows": 4}, {"group_rows": 1}, {"range_rows": 7, "sample_rows": 50}])
def test_equals_counting_all_windows(spark, limits):
    values = made_texts()
    assert judged(texts(spark, values), **limits) == plain_removals(list(enumerate(values)))


def test_one_gram_in_most_rows(spark):
    """A passage in most texts, its surroundings alike in part, copied or distinct."""
    draw = random.Random(8)
    some = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, sides = some(150), [some(120) for _ in range(4)]
    values = [some(300) for _ in range(10)]
    for k in range(60):
        left = sides[k % 3][draw.randint(0, 110):] if k % 2 else some(draw.randint(0, 90))
        right = sides[3][:draw.randint(0, 120)] if k % 5 else some(draw.randint(0, 90))
        values.append(some(k % 7) + left + passage + right + some(k % 4))
    want = plain_removals(list(enumerate(values)))
    assert sum(removed > 0 for _, removed, _, _ in want.values()) > 30
    for group_rows in (2, 9):
        assert judged(texts(spark, values), group_rows=group_rows) == want


def test_grams_grow_to_whole_windows(spark):
    """Each window of an anchor is in one of the two that it gives, at every step, and contexts that
    are equal within a task are settled there."""
    import numpy as np
    draw = random.Random(3)
    text = bytes(draw.choice(b"abcd") for _ in range(900))
    place, first, owned, _ = suffix_dedup.anchors(np.frombuffer(text, np.uint8))
    held = [int(p) for p in suffix_dedup._packed(place, first, owned)]
    gram = suffix_dedup.GRAM
    while gram < 200:
        frame = spark.createDataFrame([(b"a", text, held)], "tid binary, text binary, frequent array<long>").coalesce(1)
        rows = suffix_dedup._grown(frame, 200, gram).collect()
        assert all(r.start is None for r in rows)
        held = [r.place for r in rows]
        gram = 200 - (200 - gram) // 2
        starts = []
        for p in held:
            position, most, owned = suffix_dedup._unpacked(p)
            assert most <= 200 - gram
            starts += range(position - most, position - most + owned)
        assert sorted(starts) == list(range(701))
    twice = spark.createDataFrame([(b"a", text, held), (b"b", text, held)],
                                  "tid binary, text binary, frequent array<long>").coalesce(1)
    spans = [r for r in suffix_dedup._grown(twice, 200, 64).collect() if r.start is not None]
    assert len(spans) == 2 * 701 and {r.tid for r in spans} == {b"a", b"b"}


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert judged(docs) == plain_removals(rows)


def test_anchor_across_stretches(monkeypatch):
    import numpy as np
    text = np.frombuffer(bytes(random.Random(2).choice(b"abc") for _ in range(5000)), np.uint8)
    whole = suffix_dedup.anchors(text)
    assert whole[2].sum() == len(text) - 199
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    for a, b in zip(whole, suffix_dedup.anchors(text)):
        assert (a == b).all()


def test_edges(spark):
    empty = documents(spark, [])
    assert judged(empty) == {}
    same = "word " * 60
    rows = [(1, same, None, None, None), (1, same, None, None, None), (None, None, None, None, None),
            (None, same + "end", None, None, None)]
    frame = documents(spark, rows).withColumn("n_bytes", F.lit("clash")).withColumn("tid", F.lit(0))
    out = suffix_dedup.without_repeats(frame).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(0, 0), (300, 300), (300, 300), (303, 300)]
    assert {c for c in out[0].asDict()} >= {"tid", "lang", "kept_text"}
