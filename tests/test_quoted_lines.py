"""CSV with line breaks inside quotes, read in many splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from eventloom.sources import quoted_lines, readers

HEADER = ["user_uuid", "event_name", "category", "event_time"]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def made_file(path, seed, rows=300):
    draw = random.Random(seed)
    values = ["tap", "a\nb", 'say "hi"', 'x\n"y",\nz', "", "é, ü", "\n", "'", ",,\n,,", "long " * 30 + "\n" + "line " * 30]
    out = [(f"u{draw.randrange(5)}", draw.choice(values), draw.choice(values), f"t{k}") for k in range(rows)]
    with open(path, "w", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(HEADER)
        writer.writerows(out)
    return out


def fields(df):
    return sorted(tuple(r[name] or "" for name in HEADER) for r in df.collect())


def test_equals_reading_whole_files(spark, tmp_path, small_splits):
    made = [row for k in range(3) for row in made_file(tmp_path / f"part{k}.csv", k)]
    df = readers.marked_csv(spark, str(tmp_path), multi_line=True)
    assert quoted_lines.physical_lines(spark, str(tmp_path)).select("_file", "_split").distinct().count() > 100
    assert df.where("malformed_row is not null").count() == 0
    whole = spark.read.csv(str(tmp_path), header=True, escape='"', multiLine=True)
    assert fields(df) == fields(whole) == sorted(made)
    # Positions follow the order of the source.
    first = df.where(F.col("event_pos.file_path").endswith("part0.csv")).orderBy("event_pos").collect()
    assert [r.event_time for r in first] == [f"t{k}" for k in range(300)]


def test_faults_are_found(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(quoted_lines.records, "__defaults__", (20,))
    lines = [",".join(HEADER), "u,a,c,t1", 'u,"b\nb",c,t2', "u,a,c,t3,more", "", 'u,"open,c,t4', *(
        f"u,n{k},c,t" for k in range(60))]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    rows = readers.marked_csv(spark, str(tmp_path / "in.csv"), multi_line=True).orderBy("event_pos").collect()
    good = [r for r in rows if r.malformed_row is None]
    assert [(r.event_name, r.event_time) for r in good] == [("a", "t1"), ("b\nb", "t2")]
    # No line is lost: those after the open quote are malformed one by one.
    assert [r.malformed_row for r in rows if r.malformed_row] == [lines[3], *lines[5:]]
    with pytest.raises(Exception, match="malformed line"):
        readers.read_csv(spark, str(tmp_path / "in.csv"), multi_line=True).collect()


def test_headers_that_differ(spark, tmp_path):
    made_file(tmp_path / "a.csv", 1, 3)
    (tmp_path / "b.csv").write_text("event_name,user_uuid,category,event_time\nu,a,c,t\n")
    with pytest.raises(Exception, match="another header"):
        readers.read_csv(spark, str(tmp_path), multi_line=True).collect()


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(HEADER) + "\n")
    assert readers.read_csv(spark, str(tmp_path), multi_line=True).collect() == []
