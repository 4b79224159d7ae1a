import os
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import audit, cleaning, increments
from eventloom.plans import jobs
from eventloom.sources import snapshots
from eventloom.sources.readers import MissingInput
from tests.support import event

D = "2026-01-0"


def rows(frame):
    return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))


def made_events(spark):
    draw = random.Random(5)
    made = [(draw.choice(["u1", "u2", None]), draw.choice(["tap", "view", None]),
             draw.choice([None, f"{D}{draw.randint(1, 2)} 23:59:59.{draw.randint(0, 40) * 5 + 800:03d}",
                          f"{D}{draw.randint(2, 3)} 00:00:00.{draw.randint(0, 40) * 5:03d}"])) for _ in range(240)]
    return event(spark, *made)


def test_logs_in_any_order_give_the_rows_of_one(spark, tmp_path):
    events = made_events(spark).cache()
    want = rows(cleaning.cleaned_events(events)), rows(audit.daily_repetition(events, repeated_only=False))
    for number, split in enumerate((lambda k: k % 3, lambda k: -(k // 100), lambda k: 0)):
        store = f"{tmp_path}/{number}"
        parts = sorted({split(k) for k in range(240)})
        for part in parts:
            chosen = [k for k in range(240) if split(k) == part]
            assert jobs.add_events(spark, events.where(F.col("event_pos").isin(chosen)), store, f"log{part}")
        kept, days = jobs.read_store(spark, store)
        assert (rows(kept), rows(days)) == want


def test_a_late_event_makes_a_kept_one_a_repeat(spark, tmp_path):
    first = event(spark, ("u", "a", D + "1 10:00:00.06"), ("u", "a", D + "2 10:00:00"))
    late = event(spark, ("u", "a", D + "1 10:00:00.02"))
    assert jobs.add_events(spark, first, str(tmp_path), "first")
    assert jobs.add_events(spark, late, str(tmp_path), "late")
    times = lambda frame: sorted(str(r.event_local) for r in frame.collect())
    assert times(jobs.read_store(spark, str(tmp_path))[0]) == ["2026-01-01 10:00:00.020000", "2026-01-02 10:00:00"]
    # The snapshot before is still there.
    assert times(jobs.read_store(spark, str(tmp_path), number=1)[0]) == ["2026-01-01 10:00:00.060000", "2026-01-02 10:00:00"]
    # Only the day that the late log touches was written again.
    runs = os.listdir(f"{tmp_path}/data/cells_50000us")
    assert sorted(len([d for d in os.listdir(f"{tmp_path}/data/cells_50000us/{r}") if d.startswith("day=")]) for r in runs) == [1, 2]


def test_a_log_is_added_once_and_a_lost_run_is_invisible(spark, tmp_path, monkeypatch):
    store, events = str(tmp_path), made_events(spark)
    with pytest.raises(MissingInput):
        jobs.read_store(spark, store)
    assert jobs.add_events(spark, events, store, "log")
    want = [rows(f) for f in jobs.read_store(spark, store)]
    assert not jobs.add_events(spark, events, store, "log")
    # A run that ends after its rows and before its manifest.
    def lost(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "publish", lost)
        with pytest.raises(RuntimeError):
            jobs.add_events(spark, events, store, "more")
    assert len(os.listdir(f"{store}/data/cells_50000us")) == 2
    # Of two runs from the same manifest, the later one finds the number taken.
    with monkeypatch.context() as behind:
        behind.setattr(snapshots, "manifest_number", lambda *_: 0)
        with pytest.raises(Exception, match="already exists"):
            jobs.add_events(spark, events, store, "more")
    assert [rows(f) for f in jobs.read_store(spark, store)] == want
    with pytest.raises(ValueError):
        jobs.add_events(spark, events, store, "more", threshold_ms=60)


def test_an_empty_log_changes_nothing(spark, tmp_path):
    store, events = str(tmp_path), made_events(spark)
    assert jobs.add_events(spark, events.limit(0), store, "empty")
    assert jobs.add_events(spark, events, store, "log") and jobs.add_events(spark, events.limit(0), store, "empty too")
    assert rows(jobs.read_store(spark, store)[0]) == rows(cleaning.cleaned_events(events))


def test_rows_to_merge_travel_once(spark, tmp_path, monkeypatch):
    """One exchange by range, whose order also serves the merge and the writer; a log alone needs no merge."""
    seen = []

    def watched(merge, keys):
        def run(rows):
            plan = merge(rows).sortWithinPartitions("day", *keys)._jdf.queryExecution().executedPlan().toString()
            seen.append((plan.count("rangepartitioning"), plan.count("Exchange"), plan.count("+- Sort [")))
            return merge(rows)
        return run

    for name, keys in (("merged_cells", increments.CELL_KEYS), ("merged_repetition", increments.REPETITION_KEYS)):
        monkeypatch.setattr(increments, name, watched(getattr(increments, name), keys))
    events = made_events(spark).cache()
    for k in range(3):
        assert jobs.add_events(spark, events.where(F.col("event_pos") % 3 == k), str(tmp_path), f"log{k}")
    assert seen == [(1, 1, 1)] * 4
