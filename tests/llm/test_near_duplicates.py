import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import hamming_dedup
from eventloom.llm.components import components
from tests.llm.support import documents, plain_components, shingle_set, texts


def judged(frame, **options):
    rows = hamming_dedup.near_duplicates(frame, **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, {r.doc_id: r.kept for r in rows}


def made_texts():
    draw = random.Random(7)
    prose = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    values = []
    for _ in range(12):
        base = prose(draw.randint(3, 120))
        values.append(" ".join(base))
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 99)}"
            values.append(" ".join(copy).upper() if draw.random() < .3 else "\n".join(copy))
    chain = prose(100)
    for k in range(12):
        values.append(" ".join(chain[4 * k:4 * k + 60]))
    shared = prose(40)
    values += [" ".join(shared + prose(30)) for _ in range(15)]
    return values + ["", None, "  \n", "one", "ONE", "one two", "a b c d", "a b c d e"]


@pytest.mark.parametrize("block_rows", [512, 3])
def test_equals_comparing_all_pairs(spark, block_rows):
    values = made_texts()
    found, kept = judged(texts(spark, values), block_rows=block_rows)
    expected = plain_components(list(enumerate(values)))
    assert found == expected
    assert kept == {d: d == c for d, (_, c) in expected.items()}


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert judged(docs)[0] == plain_components([(r.doc_id, r.text) for r in docs.collect()])


def test_every_signature_within_the_threshold_shares_a_key(spark):
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 1 << 16, (40, 64)).astype(np.uint16)
    frame = []
    for k, row in enumerate(rows):
        other = row.copy()
        other[draw.choice(64, 31, replace=False)] ^= 1
        frame += [(2 * k, bytearray(row.tobytes())), (2 * k + 1, bytearray(other.tobytes()))]
    keys = hamming_dedup.filing_keys(
        spark.createDataFrame(frame, "node long, signature binary")).collect()
    by_node = {}
    for r in keys:
        by_node.setdefault(r.node, set()).add(r.key)
    assert all(by_node[2 * k] & by_node[2 * k + 1] for k in range(40))
    assert all(len(v) == 64 for v in by_node.values())


def test_no_link_is_ruled_out_before_it_is_compared(spark):
    """Pairs just at the threshold, among them long ones whose buckets overflow."""
    draw, values = random.Random(11), []
    for size in (7, 28, 70, 700, 7_000, 350_000):
        base = [f"w{draw.randint(0, 10 ** 9)}" for _ in range(size + 4)]
        # 6 of 7 shingles are common: 6 / 8 of the union.
        values += [" ".join(base), " ".join(base[size // 7:] + [f"v{draw.randint(0, 10 ** 9)}" for _ in range(size // 7)])]
    rows = hamming_dedup.bucket_counts(spark.createDataFrame(list(enumerate(values)), "node long, text string")).collect()
    counts = {r.node: np.frombuffer(r.buckets, np.uint8) for r in rows}
    for k in range(0, len(values), 2):
        a, b = (shingle_set(v) for v in values[k:k + 2])
        assert 100 * len(a & b) == 75 * len(a | b)
        assert hamming_dedup.may_link(counts[k][None, :], np.array([len(a)]), counts[k + 1], len(b)).all()
    far = hamming_dedup.may_link(counts[6][None, :], np.array([700]), counts[5], 70)
    assert not far.any() and (counts[10] == 255).any()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []


def test_edges_and_stage(spark):
    assert judged(documents(spark, [])) == ({}, {})
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text, None, None, 1), (5, text, None, None, 1), (None, text + " more", None, None, None),
            (None, None, None, None, None), (9, "", None, None, None), (3, "other words that stay here", None, None, None)]
    frame = documents(spark, rows).withColumn("digest", F.lit("clash")).withColumn("node", F.lit(1))
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept)
                   for r in hamming_dedup.near_duplicates(frame).collect())
    assert found == sorted([("5", 26, "5", True), ("5", 26, "5", True), ("None", 27, "5", False),
                            ("None", 0, "None", True), ("9", 0, "9", True), ("3", 1, "3", True)])
    kept = hamming_dedup.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "9", "None"]
