"""Rows that differ only in which of their values is null, and keys alike in their first 64 bits."""

import pytest
from pyspark.sql import functions as F

from eventloom.llm import hamming_dedup, line_dedup, source_mixing
from eventloom.llm.row_keys import row_key
from tests.llm.support import documents, plain_components


def test_near_duplicates_keep_both(spark):
    rows = documents(spark, [(None, "5", None, None, None), (5, None, None, None, None)])
    kept = hamming_dedup.without_near_duplicates(rows).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == ["(5, None)", "(None, '5')"]


def test_lines_are_charged_to_their_row(spark):
    rows = documents(spark, [(1, "5", None, None, None), (None, "5", None, None, None), (5, None, None, None, None)])
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeats(rows, least_words=1).collect()}
    assert out == {1: ("5", 0), None: ("", 1), 5: (None, 0)}


def test_a_null_text_takes_no_words(spark):
    rows = documents(spark, [(1, "a", None, None, None), (1, None, None, "a", None), (2, "b c d", None, "a", None)])
    for r in source_mixing.mixed_documents(rows, slot_words=1).collect():
        assert r.taken <= 3 * r.size


@pytest.fixture
def half_alike(monkeypatch):
    def key(*values):
        return F.struct(F.lit(7).cast("long").alias("one"), row_key(*values)["two"].alias("two"))
    for module in (hamming_dedup, source_mixing):
        monkeypatch.setattr(module, "row_key", key)


def test_the_second_half_is_a_hash_of_its_own(spark):
    keys = [r.k for r in spark.range(2000).select(row_key(F.col("id"), F.lit(None)).alias("k")).collect()]
    assert len({k.one for k in keys}) == len({k.two for k in keys}) == 2000
    assert len({k.one ^ k.two for k in keys}) == 2000


def test_near_duplicates_whose_keys_collide(spark, half_alike):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    values = [base, base + " aa", "one two three four five six", base, "seven eight nine ten eleven twelve", None, "", base[2:]]
    rows = documents(spark, [(k, t, None, None, None) for k, t in enumerate(values)])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in hamming_dedup.near_duplicates(rows).collect()}
    assert found == plain_components(list(enumerate(values)))
    kept = {(r.doc_id, r.text) for r in hamming_dedup.without_near_duplicates(rows).collect()}
    assert kept == {(k, values[k]) for k in (0, 2, 4, 5, 6)}


def test_mixed_documents_whose_keys_collide(spark, half_alike):
    rows = documents(spark, [(k, "w " * (k + 1), None, "s", None) for k in range(6)])
    found = {r.doc_id: (r.size, r.taken) for r in source_mixing.mixed_documents(rows, slot_words=2).collect()}
    assert found == {k: (k + 1, k + 1) for k in range(6)}
