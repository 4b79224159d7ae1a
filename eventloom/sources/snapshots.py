"""Tables by day that grow by merging, one snapshot per log.

Below the store, ``data/<table>/run=<run>/day=<day>`` holds rows, and ``manifests/<number>`` is a table that
lists, for every day of every table, the run that has it, and the logs merged so far. A run
writes the days that its log touches anew, under a name of its own; its manifest is written under such a
name too and renamed last. Nothing is overwritten, what a lost run leaves is in no manifest, and of two
runs that start from the same manifest one fails. The file system must rename folders at once,
as HDFS and local ones do.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.sources.readers import MissingInput
from eventloom.sources.shared import stored

MANIFEST = "kind string, name string, day bigint, run string"


def manifest_number(spark: SparkSession, store: str) -> int:
    """Number of the last manifest that was written to its end; 0 without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return 0
    return max((int(status.getPath().getName()) for status in system.listStatus(path)), default=0)


def manifest(spark: SparkSession, store: str, number: int) -> DataFrame:
    """(kind, name, day, run): rows of the kind 'day' name a table, those of the kind 'log' a log."""
    if number == 0:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{number:08d}")


def read_days(spark: SparkSession, store: str, table: str, listed: DataFrame) -> DataFrame | None:
    """The rows of a table in the days that manifest rows list; None without any. The driver holds one
    path per day, whatever the days hold."""
    rows = listed.where((F.col("kind") == "day") & (F.col("name") == table)).select("day", "run").collect()
    base = f"{store}/data/{table}"
    paths = [f"{base}/run={r.run}/day={r.day}" for r in rows]
    if not paths:
        return None
    frame = spark.read.option("basePath", base).parquet(*paths)
    return frame.withColumn("day", F.col("day").cast("bigint")).drop("run")


def add_log(spark: SparkSession, store: str, log: str, tables: dict) -> bool:
    """Merge a log into a store. ``tables`` has, by name, its rows with a column ``day``, the function that
    merges rows of several logs, and the columns beside ``day`` that tell a log's rows apart and by
    which it groups them. False, and nothing is done, where a log of that name is in.
    A store with other tables is an error: its logs were added with other settings."""
    number = manifest_number(spark, store)
    # Held as rows in the driver: one per table and day, and one per log.
    listed = manifest(spark, store, number)
    if listed.where((F.col("kind") == "log") & (F.col("name") == log)).count():
        return False
    others = listed.where((F.col("kind") == "day") & ~F.col("name").isin(list(tables)))
    if (other := others.first()) is not None:
        raise ValueError(f"{store} has the table {other['name']}, but not in the log {log}")
    run = uuid.uuid4().hex
    entries = [("log", log, None, run)]
    for name, (rows, merge, keys) in tables.items():
        fresh = stored(rows, f"snapshot-{name}")
        days = [r.day for r in fresh.select("day").distinct().collect()]
        if not days:
            continue
        before = read_days(spark, store, name, listed.where(F.col("day").isin(days)))
        # Cut by the keys as well, so that many tasks write a full day. Rows to merge meet by this one
        # exchange and its order; those of a log alone are merged already.
        order = ["day", *keys]
        merged = fresh.repartitionByRange(*order) if before is None else merge(
            fresh.unionByName(before.select(*fresh.columns)).repartitionByRange(*order))
        merged.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("day").parquet(
            f"{store}/data/{name}/run={run}")
        entries += [("day", name, day, run) for day in days]
    added = spark.createDataFrame(entries, MANIFEST)
    kept = listed.join(added, (listed["kind"] == added["kind"]) & (listed["name"] == added["name"])
                       & listed["day"].eqNullSafe(added["day"]), "left_anti")
    staged = f"{store}/staged/{run}"
    kept.unionByName(added).coalesce(1).write.mode("errorifexists").parquet(staged)
    publish(spark, staged, f"{store}/manifests/{number + 1:08d}")
    return True


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a folder; an error where the new name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.mkdir(hadoop.Path(path).getParent(), hadoop.permission.FsPermission.getDirDefault(), True)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    context.rename(hadoop.Path(staged), hadoop.Path(path), options)


def read_snapshot(spark: SparkSession, store: str, table: str, number: int | None = None) -> DataFrame:
    """A table as of a manifest, by default the last."""
    number = manifest_number(spark, store) if number is None else number
    rows = read_days(spark, store, table, manifest(spark, store, number))
    if rows is None:
        raise MissingInput(f"{store} has no rows of {table}; add a log first")
    return rows
