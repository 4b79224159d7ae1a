"""Repeated passages of lines against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import line_dedup
from tests.llm.support import documents


def plain_lines(rows, least_words):
    """Sorted (doc_id, kept text, n_units, n_removed, removed_spans)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        units = (text or "").split("\n")
        starts = [sum(len(u) + 1 for u in units[:k]) for k in range(len(units))]
        norms = [line_dedup.normalised(u) for u in units]
        runs, repeated = [[]], []
        for k, norm in enumerate(norms):
            repeated.append(bool(norm) and norm in seen)
            if norm:
                seen.add(norm)
                if repeated[k]:
                    runs[-1].append(k)
                else:
                    runs.append([])
        gone = [k for run in runs if sum(len(norms[k].split(" ")) for k in run) >= least_words for k in run]
        kept = "\n".join(u for k, u in enumerate(units) if k not in gone)
        out.append((doc_id, None if text is None else kept, sum(map(bool, norms)), len(gone),
                    ",".join(f"{starts[k]}-{starts[k] + len(units[k])}" for k in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_words", [1, 4, line_dedup.LEAST_WORDS])
def test_equals_plain_passages(spark, least_words):
    draw = random.Random(least_words)
    lines = ["of.", "Of.", "", "  ", "a b c", "A  b\tc", "d e f g", "h", "\xa0", "p\xa0q", *(f"line {k} of many words here" for k in range(9))]
    rows = [(k, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 12)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "x " * 20_000), (103, "x " * 20_000), (104, "é b\n" * 9)]
    frame = documents(spark, [(i, t, "en", None, None) for i, t in rows]).withColumns(
        {"row_key": F.lit("clash"), "unit": F.lit(1), "digest": F.lit(None).cast("string")}).repartition(5)
    got = line_dedup.without_repeats(frame, least_words=least_words).select(
        "doc_id", "text", "n_units", "n_removed", "removed_spans").collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(rows, least_words)


def test_of_repeated_rows_one_keeps_its_lines(spark):
    text = "a passage of many words\n" * 4
    rows = documents(spark, [(5, text, None, None, None)] * 3 + [(None, text, None, None, None)] * 2)
    got = line_dedup.without_repeats(rows).collect()
    assert sorted(r.n_removed for r in got) == [3, 4, 4, 4, 4]
    assert line_dedup.without_repeats(documents(spark, [])).collect() == []
