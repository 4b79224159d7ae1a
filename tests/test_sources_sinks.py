import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from eventloom.plans import jobs
from eventloom.sources import readers, shared, sinks

HEADER = "category,event_time,event_name,user_uuid,device\n"
ROWS = [
    "Application,2026-01-05 23:59:59.990000 +0530,tap,u1,x",
    "Application,2026-01-06 00:00:00.010 +0530,tap,u1,x",
    "system,2026-01-05 09:00:00.5 +05:30,boot,u1,y",
    "Application,2026-01-05 09:00:00.500000 +0530,\"say \"\"hi\"\", you\",a/b,x",
    "Application,2026-01-05 09:00:01.500000 +0530,tap,a_b,x",
    "Application,2026-01-05 03:30:00.250000 Z,tap,,x",
]


@pytest.fixture
def raw_csv(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "events.csv").write_text(HEADER + "\n".join(ROWS) + "\n")
    return str(folder)


def test_raw_csv(spark, raw_csv):
    rows = readers.read_raw_events(spark, raw_csv).orderBy("event_pos").collect()
    assert [r.event_name for r in rows] == ["tap", "tap", "boot", 'say "hi", you', "tap", "tap"]
    assert str(rows[0].event_local) == "2026-01-05 23:59:59.990000"
    assert [r.event_offset for r in rows] == ["+05:30"] * 5 + ["+00:00"]
    assert [r.device for r in rows] == ["x", "x", "y", "x", "x", "x"]
    instants = readers.read_raw_events(spark, raw_csv).select(F.unix_micros("event_time"))
    assert instants.collect()[3][0] - instants.collect()[5][0] == 250_000
    assert rows[5].user_uuid is None


@pytest.mark.parametrize("value", ["2026-01-05 10:00:00 +0530", "2026-01-05 10:00:00.5", "soon",
                                   "2026-02-30 10:00:00.5 +0530"])
def test_unreadable_times(spark, tmp_path, value):
    (tmp_path / "bad.csv").write_text(HEADER + ROWS[0] + f"\nsystem,{value},e,u,x\n")
    raw = readers.read_csv(spark, str(tmp_path))
    with pytest.raises(Exception, match="unreadable event_time"):
        readers.parse_raw(raw).collect()
    good, bad = readers.parse_raw_lenient(raw)
    assert [r.user_uuid for r in good.collect()] == ["u1"]
    assert [r.event_time for r in bad.collect()] == [value]


@pytest.mark.parametrize("line", [ROWS[0] + ",more,and more", ROWS[0] + ",",
                                  'Application,"2026-01-05 23:59:59.990000 +0530,tap,u1,x'])
def test_malformed_lines(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(f"{HEADER}{ROWS[1]}\n{line}\nsystem,,short\n")
    with pytest.raises(Exception, match="malformed line"):
        readers.read_raw_events(spark, str(tmp_path)).collect()
    good, bad = readers.read_raw_lenient(spark, str(tmp_path))
    assert sorted(r.event_name for r in good.collect()) == ["short", "tap"]
    assert [r.malformed_row for r in bad.collect()] == [line]


def test_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + ROWS[0] + "\n")
    (tmp_path / "b.csv").write_text("event_name,user_uuid,category,event_time,device\ntap,u,c,,x\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_missing_time_is_no_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "system,,e,u,x\n")
    row = readers.read_raw_events(spark, str(tmp_path)).first()
    assert (row.event_time, row.event_local, row.event_offset) == (None, None, None)


def test_stored_times(spark, tmp_path):
    values = ["2026-01-05 10:00:00+05:30", "2026-01-05T10:00:00.25+0530", "2026-01-05 04:30:00Z",
              "2026-01-05 04:30:00.5"]
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"system,{v},e,u,x\n" for v in values))
    rows = readers.parse_iso(readers.read_csv(spark, str(tmp_path))).orderBy("event_pos").select(
        F.unix_micros("event_time") - 1767587400000000, F.col("event_local").cast("string"),
        "event_offset").collect()
    assert [tuple(r) for r in rows] == [
        (0, "2026-01-05 10:00:00", "+05:30"), (250_000, "2026-01-05 10:00:00.25", "+05:30"),
        (0, "2026-01-05 04:30:00", "+00:00"), (500_000, "2026-01-05 04:30:00.5", "+00:00")]


def test_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_uuid,event_name\nu,e\n")
    with pytest.raises(ValueError, match="category, event_time"):
        readers.read_csv(spark, str(tmp_path))


def test_missing_table_names_the_job(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        with pytest.raises(readers.MissingInput, match="run the clean job first"):
            jobs.timeline(spark, str(tmp_path), str(tmp_path / "out"), fmt=fmt)


def read_back(path):
    rows = []
    for file in sorted(glob.glob(f"{path}/**/*.csv", recursive=True)):
        with open(file, newline="") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_csv_jobs_end_to_end(spark, raw_csv, tmp_path):
    first, second = str(tmp_path / "clean"), str(tmp_path / "time")
    jobs.clean(spark, raw_csv, first, fmt="csv", buckets=None)
    rows = read_back(f"{first}/cleaned_events")
    assert list(rows[0]) == ["user_uuid", "event_name", "category", "event_time", "event_date",
                             "event_day", "event_time_only", "device"]
    assert [(r["user_uuid"], r["event_name"]) for r in rows] == [
        ("a/b", 'say "hi", you'), ("a_b", "tap"), ("u1", "boot"), ("u1", "tap"), ("", "tap")]
    assert rows[3]["event_time"] == "2026-01-05 23:59:59.99+05:30"
    assert rows[3]["event_time_only"] == "'23:59:59.990000"
    assert rows[3]["event_day"] == "Monday"
    assert read_back(f"{first}/unique_users_count") == [
        {"metric": "total_unique_users", "value": "4"}]
    # The row of the missing user is an empty line there.
    assert len(read_back(f"{first}/unique_users_list")) == 3
    assert len(glob.glob(f"{first}/per_user_cleaned_events/user_key=*")) == 3

    jobs.timeline(spark, first, second, fmt="csv")
    ordered = read_back(f"{second}/cleaned_events_chronological")
    assert [(r["user_uuid"], r["event_name"]) for r in ordered] == [
        ("a/b", 'say "hi", you'), ("a_b", "tap"), ("u1", "boot"), ("u1", "tap"), ("", "tap")]
    assert ordered[3]["event_time"] == rows[3]["event_time"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jobs.timeline(spark, first, second, fmt="csv")


def test_parquet_jobs_end_to_end(spark, raw_csv, tmp_path):
    first, third = str(tmp_path / "clean"), str(tmp_path / "analysis")
    before = glob.glob(f"{shared.shared_folder(spark)}/in-order-*")
    jobs.clean(spark, raw_csv, first, buckets=4)
    jobs.timeline(spark, first, str(tmp_path / "time"), buckets=4)
    jobs.analyse(spark, first, third, "Say.")
    prompts = spark.read.parquet(f"{third}/prompts")
    assert sorted(r.user_uuid for r in prompts.collect()) == ["a/b", "a_b", "u1"]
    assert spark.read.parquet(f"{third}/session_summary").count() == 3
    events = spark.read.parquet(f"{third}/session_summary").agg(F.sum("event_count")).first()[0]
    for name, rows in (("session_cards", 3), ("journey_paths", 3), ("journey_records", 3), ("journey_nodes", events)):
        assert spark.read.parquet(f"{third}/{name}").count() == rows, name
    per_user = spark.read.parquet(f"{first}/per_user_cleaned_events")
    assert per_user.count() == 4
    assert glob.glob(f"{shared.shared_folder(spark)}/in-order-*") == before
    jobs.register_views(spark, first)
    assert spark.sql("select count(*) from cleaned_events").first()[0] == 5


def test_a_heavy_user_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 > 0, "big").otherwise(F.concat(F.lit("u"), F.col("id") % 40))
        .alias("user_uuid"),
        F.lit("e").alias("event_name"), F.lit("c").alias("category"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("event_time"),
        F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("event_local"),
        F.lit("+00:00").alias("event_offset"), F.col("id").alias("event_pos"))
    path = str(tmp_path / "users")
    sinks.write_per_user(rows, path, "parquet", partitions=8)
    files = sorted(glob.glob(f"{path}/user_key=big/*.parquet"))
    assert len(files) >= 5
    edges = []
    for file in files:
        times = [r[0] for r in spark.read.parquet(file).select("event_pos").collect()]
        assert times == sorted(times)
        edges.append((times[0], times[-1]))
    edges.sort()
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert spark.read.parquet(path).count() == 40_000
    assert os.path.isdir(f"{path}/user_key=u0")


def test_shuffles_grow_with_the_source(spark, monkeypatch):
    from eventloom import session
    from tests.support import TESTDATA

    table = spark.read.parquet(f"{TESTDATA}/sf0.01/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.fit_shuffles(table) == int(before)
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 10_000)
        assert session.fit_shuffles(table) > int(before)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1)
        job = session.keeps_shuffles(lambda spark: session.fit_shuffles(table))
        assert job(spark) > 40_000
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_replies_job(spark, raw_csv, tmp_path, monkeypatch):
    import sys

    from eventloom import __main__ as command

    clean, out = str(tmp_path / "clean"), str(tmp_path / "replies")
    jobs.clean(spark, raw_csv, clean, buckets=2)
    name = spark.read.parquet(f"{clean}/cleaned_events").where("user_uuid = 'u1'").first().event_name
    body = '{"interpreted_sessions": [{"events": ["%s"]}], "mood": 1}' % name
    rows = [("u1", 1, f"```json\n{body}\n```"), ("a/b", 1, "nothing"), ("u1", 2, body + ", 1")]
    spark.createDataFrame(rows, "user_uuid string, part bigint, content string").write.parquet(str(tmp_path / "model"))
    monkeypatch.setattr(sys, "argv", ["eventloom", "replies", str(tmp_path / "model"), out, "--events", clean])
    command.main()
    parsed = {(r.user_uuid, r.part): r for r in spark.read.parquet(f"{out}/parsed_replies").collect()}
    assert parsed["u1", 1].reply == '{"interpreted_sessions":[{"events":["%s"]}],"mood":1}' % name
    assert [parsed[key].parse_error for key in (("a/b", 1), ("u1", 2))] == ["Not a JSON object"] * 2
    audit = spark.read.parquet(f"{out}/reply_audit").collect()
    assert [(r.user_uuid, r.part, r.passes) for r in audit] == [("u1", 1, True)]
    assert spark.read.parquet(f"{out}/reply_sessions").count() == spark.read.parquet(f"{out}/reply_notes").count() == 1


def test_command_line(spark, raw_csv, tmp_path, monkeypatch):
    import sys

    from eventloom import __main__ as command

    target = str(tmp_path / "out")
    monkeypatch.setattr(sys, "argv", ["eventloom", "clean", raw_csv, target, "--buckets", "2",
                                      "--threshold-ms", "0"])
    command.main()
    assert spark.read.parquet(f"{target}/cleaned_events").count() == 6
    assert glob.glob(f"{target}/per_user_cleaned_events/user_bucket=*")
