"""Helpers shared by the tests."""

import datetime
import glob
import os

import duckdb

TESTDATA = os.environ.get("EVENTLOOM_TESTDATA", "/root/testdata")


def duck(sf_dir):
    connection = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file)[:-len(".parquet")]
        connection.execute(f"create view {name} as select * from read_parquet('{file}')")
    return connection


def comparable(rows):
    return sorted(rows, key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, comparable(tuple(row) for row in df.select(*names).collect())


def duck_rows(connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = dict(zip(names, [str(column[1]) for column in result.description]))
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(row[i] for i in order) for row in result.fetchall()]
    return [names[i] for i in order], comparable(rows), types


# Spark type to the type the other engine should report.
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER"}


def event(spark, *rows):
    """Events of rows (user, name, local time text[, category[, position]])."""
    from pyspark.sql import functions as F

    from eventloom.functions import times

    full = []
    for position, row in enumerate(rows):
        user, name, local = row[:3]
        category = row[3] if len(row) > 3 else "Application"
        position = row[4] if len(row) > 4 else position
        full.append((user, name, category, local, position))
    df = spark.createDataFrame(
        full, "user_uuid string, event_name string, category string, local string, event_pos bigint")
    local = F.col("local").cast("timestamp_ntz")
    return df.select(
        "user_uuid", "event_name", "category",
        F.timestamp_micros(times.local_micros(local)).alias("event_time"),
        local.alias("event_local"), F.lit("+00:00").alias("event_offset"), "event_pos")


def at(text):
    return datetime.datetime.fromisoformat(f"2026-01-05 {text}")
