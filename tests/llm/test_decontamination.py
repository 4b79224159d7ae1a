import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import decontamination
from tests.llm.support import documents, plain_contamination, texts


def items(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "item_id long, text string")


def judged(docs, bench, **options):
    found = decontamination.contamination(decontamination.benchmark_hits(docs, bench, **options))
    return {r.doc_id: tuple(r)[1:] for r in found.collect()}


def made_tables():
    draw = random.Random(5)
    prose = lambda n: [draw.choice(["A", "bé", "c3", "Dd", "e"]) + draw.choice(["", "x", "y"]) for _ in range(n)]
    bench = [prose(draw.randint(1, 40)) for _ in range(25)]
    docs = []
    for _ in range(40):
        words = prose(draw.randint(0, 900))
        for _ in range(draw.randint(0, 3)):
            item, at = draw.choice(bench), draw.randint(0, len(words))
            low = draw.randint(0, max(0, len(item) - 13))
            words[at:at] = item[low:low + draw.randint(12, 20)]
        docs.append(draw.choice([" ", ", ", "--", "\n"]).join(words))
    return docs + ["", None, "..."], [" ".join(b) for b in bench] + ["", None, "?!", " ".join(bench[0])]


@pytest.mark.parametrize("words_per_part", [2_000_000, 150])
def test_equals_plain_search(spark, words_per_part):
    docs, bench = made_tables()
    found = judged(texts(spark, docs), items(spark, bench), words_per_part=words_per_part)
    assert found == plain_contamination(list(enumerate(docs)), list(enumerate(bench)))


def test_no_part_holds_more_than_its_words(spark, monkeypatch):
    draw, held, searched = random.Random(9), [], decontamination._searched
    long = " ".join(draw.choice("abcdé") + str(draw.randint(0, 99)) for _ in range(1000))
    bench = ["copy " * 20] * 60 + [long, "É İ K", "a b"]
    docs = [long, " ".join(long.split()[90:140]), "copy " * 13, "x É İ K y", "a c", None]

    def noted(frame, rows, window):
        held.append(sum(len(words.split()) for _, words in rows))
        return searched(frame, rows, window)

    monkeypatch.setattr(decontamination, "_searched", noted)
    rows = spark.createDataFrame([(min(k, 60) if k < 60 else k, t) for k, t in enumerate(bench)], "item_id long, text string")
    rows = rows.unionByName(spark.createDataFrame([(7, bench[0])] * 60, rows.schema))
    found = judged(texts(spark, docs), rows, words_per_part=400)
    assert found == plain_contamination(list(enumerate(docs)), [(r.item_id, r.text) for r in rows.collect()])
    assert len(held) > 2 and max(held) <= 800


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = plain_contamination([(r.doc_id, r.text) for r in docs.collect()],
                                   [(r.item_id, r.text) for r in bench.collect()])
    assert judged(docs, bench) == expected
    assert any(row[-1] for row in expected.values())


def test_edges(spark):
    none = documents(spark, [])
    assert judged(none, items(spark, ["a b"])) == {}
    some = documents(spark, [(1, "a b c", None, None, None), (1, "a b c", None, None, None), (None, None, None, None, None)])
    empty = items(spark, [])
    assert [tuple(r)[1:4] for r in decontamination.contamination(
        decontamination.benchmark_hits(some, empty)).orderBy("n_words").collect()] == [(0, 0, 0), (3, 0, 0), (3, 0, 0)]
    clash = some.withColumn("hits", F.lit(0)).withColumn("items", F.lit("x")).withColumn("n_words", F.lit(0))
    kept = decontamination.clean_documents(clash, items(spark, ["b c"]))
    assert kept.columns == clash.columns
    assert [r.doc_id for r in kept.collect()] == [None]
