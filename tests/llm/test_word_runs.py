"""Periodic runs against looking at every period of every text."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from eventloom.llm import queries, word_runs
from tests.llm.support import blank_words, documents, texts
from tests.support import TESTDATA


def plain_runs(words):
    """(start, length, period) of all runs."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = 0
        while start < len(words) - q:
            stop = start
            while stop < len(words) - q and words[stop] == words[stop + q]:
                stop += 1
            if stop + q - start >= max(24, 3 * q):
                found.setdefault((start, stop + q - start), q)
            start = stop + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def drawn(draw):
    """A text of few or many different words, often with a repeated tail and a word out of place."""
    kinds, n = draw.choice([1, 2, 3, 40]), draw.choice([0, 1, 5, 23, 24, 60, 200])
    words = [f"w{draw.randrange(kinds)}" for _ in range(n)]
    if n > 20 and draw.random() < .7:
        a = draw.randrange(n)
        p = draw.randint(1, max(1, (n - a) // 3))
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    if n > 20 and draw.random() < .5:
        words[draw.randrange(n)] = "x"
    return draw.choice([" ", "\n", " \t", "\x0b\x0c "]).join(words)


def test_equals_looking_at_every_period(spark):
    draw = random.Random(4)
    values = [drawn(draw) for _ in range(300)] + [None, "", " \n ", "é ü é ü " * 9, "a b " * 30, "b " * 5000]
    frame = texts(spark, values).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    for slice_bytes in (500, 1 << 20):
        got = {r.doc_id: r for r in word_runs.periodic_runs(frame, slice_bytes=slice_bytes).collect()}
        assert len(got) == len(values)
        for k, value in enumerate(values):
            words = blank_words(value)
            runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
            assert [tuple(r) for r in got[k].runs] == runs, value
            assert (got[k].n_words, got[k].collapsed) == (len(words), plain_collapsed(words, runs))


def test_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b " * 12, None, None, None)] * 2 + [(3, "a b " * 12, None, None, None)]
    got = word_runs.periodic_runs(documents(spark, rows)).collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 24, 2)]] * 3
    assert word_runs.periodic_runs(documents(spark, [])).collect() == []


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, blank_words(text))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest())


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_word_runs(spark, f"{TESTDATA}/sf0.001").collect()}
    assert set(got) == set(rows) and any(r.n_runs for r in got.values())
    for doc_id, text in rows.items():
        if len(text or "") < 20_000:
            assert tuple(got[doc_id])[1:] == expected(doc_id, text)


def test_the_run_of_most_periods(spark):
    """Ties of length / period go to the smallest start; nulls where there is no run."""
    found = spark.createDataFrame(
        [(1, [(0, 30, 10), (40, 24, 8), (70, 25, 8), (100, 50, 16)], "x"), (2, [], "")],
        "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    got = {r.doc_id: tuple(r)[1:6] for r in queries.run_digests(found).collect()}
    assert got == {1: (4, 70, 25, 8, 3125), 2: (0, None, None, None, None)}
