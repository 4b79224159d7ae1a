"""Intermediate tables and stream state in the folder all executors share."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_folders = {}
_made = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Where it is unset, sessions with a local master get
    a temporary one, which goes with the process; any other master is an error, as its
    executors could not see the files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        folder = _local_folders[application] = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; ``drop_intermediate`` removes it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read back. It survives lost executors, and what
    reads it sees one fixed version of rows whose numbers depend on where they were read."""
    path = new_path(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def in_order(events: DataFrame, *order) -> DataFrame:
    """The events, stored in order over all files, with ``_row``, which grows in that order and has
    no gaps within a ``_part``.

    Stored, since row ids depend on how the events fell into partitions: what is counted and what
    is numbered must be the same partitions, also after a lost executor."""
    rows = events.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumns({
        "_row": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "in-order")


def drops_intermediate(job):
    """For a job that takes the session first and writes all its results: the intermediate tables made
    inside go at its end."""
    @functools.wraps(job)
    def run(spark: SparkSession, *args, **options):
        before = len(_made.get(spark.sparkContext.applicationId, []))
        try:
            return job(spark, *args, **options)
        finally:
            drop_intermediate(spark, before)

    return run


def drop_intermediate(spark: SparkSession, first: int = 0) -> None:
    """Remove the intermediate tables of this application from the ``first`` on."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    made = _made.get(spark.sparkContext.applicationId, [])
    while len(made) > first:
        name = made.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(configuration).delete(path, True)
