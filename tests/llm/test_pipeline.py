"""The stages of the pipeline against the plain versions, one after another."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import quality_ranking
from tests.llm.support import blank_words, documents, plain_components, plain_contamination, plain_removals

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, score double"


def made_rows():
    draw = random.Random(8)
    prose = lambda n: " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))
    bench, passage = prose(20), prose(60)
    whole = prose(60)
    values = [prose(40), prose(50), f"{prose(90)} {passage}", f"{passage} {prose(90)}", whole, f"{prose(60)} {whole} {prose(60)}",
              f"{prose(3)} {bench}", bench, "", None]
    near = prose(80)
    values += [near, near + " more"]
    rows = [(k, v, "en", "ab"[k % 2] if k % 5 else None, None, k, .5) for k, v in enumerate(values)]
    return [*rows, rows[0], (None, prose(30), None, "b", None, None, None)], [(1, bench), (2, None), (None, "w1")]


def write(spark, folder, rows, items):
    documents(spark, rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_stage_equals_its_plain_version(spark, tmp_path, monkeypatch):
    rows, items = made_rows()
    write(spark, tmp_path, rows, items)
    left = {}

    def kept_rows(name, stage):
        def run(*args):
            left[name] = stage(*args).localCheckpoint()
            return left[name]
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [kept_rows(*s) for s in corpus_pipeline.STAGES])
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {name: [tuple(r) for r in frame.collect()] for name, frame in left.items()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert all(frame.columns == names for name, frame in left.items() if name != "source_mix")

    assert sorted(found["quality"], key=str) == sorted(rows, key=str)
    # Keys of the plain versions are places in the list: ids may be null.
    components = plain_components([(k, r[1]) for k, r in enumerate(rows)])
    unlike = {}
    for k, row in enumerate(rows):
        unlike.setdefault(components[k][1], row)
    assert sorted(found["near_duplicates"], key=str) == sorted(unlike.values(), key=str)

    before = {r[0]: r for r in found["near_duplicates"]}
    removals = plain_removals([(d, r[1]) for d, r in before.items()])
    after = {r[0]: r for r in found["repeated_substrings"]}
    assert set(after) == set(before) and len(found["repeated_substrings"]) == len(before)
    for d, (size, gone, _, _) in removals.items():
        assert len((after[d][1] or "").encode()) == size - gone
        assert after[d][4] == (None if after[d][1] is None else len(after[d][1]))
        assert after[d][2:4] + after[d][5:] == before[d][2:4] + before[d][5:]
    assert after[4][1] == "" and removals[2][1] > 0

    judged = plain_contamination([(d, r[1]) for d, r in after.items()], [i for i in items if i[0] is not None])
    clean = {d: r for d, r in after.items() if not judged[d][-1]}
    assert {7, 6}.isdisjoint(clean) and {r[0]: r for r in found["benchmark_passages"]} == clean

    assert {r.doc_id: r.size for r in mix} == {d: len(blank_words(r[1])) for d, r in clean.items()}
    assert all(0 <= r.taken <= 3 * r.size for r in mix) and sum(r.taken for r in mix) > 0


def test_no_documents(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("cut", [1, 400])
def test_rejected_documents_go(spark, monkeypatch, tmp_path, cut):
    rows, items = made_rows()
    write(spark, tmp_path, rows, items)
    frame = documents(spark, rows, SCHEMA)
    monkeypatch.setattr(quality_ranking, "fit_quality", lambda *_: None)
    monkeypatch.setattr(quality_ranking, "quality_scores", lambda docs, _: docs.withColumn(
        "predicted", (F.length("text") < cut).cast("int")))
    left = corpus_pipeline.quality(spark, frame, str(tmp_path))
    assert left.columns == frame.columns
    expected = [r for r in rows if r[1] is not None and len(r[1]) < cut]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(expected, key=str)
