"""Exact duplicates against grouping in plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact_copies as ec
from tests.llm.support import documents

BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def plain_copies(rows):
    """(doc_id, keep_id, group_size) of all rows, and how many of each are kept."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(BLANKS)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out, kept = [], []
    for members in groups.values():
        keep = min(members)[3]
        kept.append(keep)
        out += [(member[3], keep, len(members)) for member in members]
    return Counter(out), Counter(kept)


def made_rows():
    draw = random.Random(3)
    rows = [(k, draw.choice(["a b", "ab", " a b ", "a\tb\n", "A b", "é 😀", "é😀 ", "a b", "", None, " \n"]))
            for k in range(200)]
    rows += [(1000 + k, "hot text") for k in range(150)] + [(2000 + k, f"only {k}") for k in range(80)]
    return rows + [(7, "x y"), (7, "x y"), (None, "x y"), (None, None), (9, "z" * 100_000), (8, "z " * 100_000)]


DIGESTS = {"sha": ec.content_digest, "weak": lambda text: F.pmod(F.length(text), F.lit(3)).cast("string")}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("shares", [ec.SHARES, 8])
def test_equals_plain_groups(spark, digest, shares):
    rows = made_rows()
    frame = documents(spark, [(i, t, "en", None, None) for i, t in rows]).repartition(7).withColumns(
        {"row_no": F.lit(1), "row": F.lit("clash"), "digest": F.lit(2), "kept": F.lit("yes"), "a.b": F.lit(3)})
    out = ec.exact_copies(frame, digest=DIGESTS[digest], shares=shares).collect()
    expected, kept = plain_copies(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == expected
    assert Counter(r.doc_id for r in out if r.kept) == kept
    whole = ec.without_copies(frame, digest=DIGESTS[digest], shares=shares)
    assert whole.columns == frame.columns
    assert Counter(r.doc_id for r in whole.collect()) == kept


def test_kept_rows_are_unchanged(spark):
    rows = [(2, "a b", "en", "s", 3), (1, "ab", None, None, 2), (3, None, "de", None, None), (4, "", "fr", "t", 0)]
    kept = sorted(map(tuple, ec.without_copies(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([rows[0], rows[2]], key=str)


def test_no_rows(spark):
    assert ec.exact_copies(documents(spark, [])).collect() == []
    assert ec.without_copies(documents(spark, [])).collect() == []


def test_one_crowded_digest_spreads(spark):
    """Salts follow the size of the group, and only few digests can have several."""
    rows = documents(spark, [(k, "same" if k % 3 else str(k), None, None, None) for k in range(3000)])
    crowded = ec.crowded_digests(ec.repeated_digests(ec.tagged_rows(rows)), 3000).collect()
    assert [r.salts for r in crowded] == [2000 * ec.SHARES // 3000]
