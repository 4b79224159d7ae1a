"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library, once per application. Not needed where it is
    installed or on ``PYTHONPATH``."""
    top = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    application = spark.sparkContext.applicationId
    if top in known or application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="eventloom-")) / "eventloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((top / "eventloom").rglob("*.py")):
            out.write(path, path.relative_to(top))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Where it is unset, a temporary
    folder serves sessions with a local master; any other master is an error,
    as its executors could not see the files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="eventloom-")
    return _own_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stored_buckets(frame: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stored``, bucketed by a key: joins on it leave this side where it is."""
    spark = frame.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    (frame.write.bucketBy(count, key).option("compression", "zstd")
        .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)
