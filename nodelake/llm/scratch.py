"""Where intermediate results live: the folder named in ``spark.checkpoint.dir``.

Executors can be lost at any time, so a result that several jobs read is written as a Parquet table in the shared
folder and read again; no step relies on one executor's copy of anything.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where the session names none and runs in one process (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="nodelake-")
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there.rstrip('/')}/nodelake-{spark.sparkContext.applicationId}"


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def tables(spark: SparkSession) -> set[str]:
    """Names of the tables that :func:`table` has written for this application."""
    files, path = _files(spark)
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def clear(spark: SparkSession, *keep: DataFrame, names: set[str] = frozenset()) -> None:
    """Remove the tables that :func:`table` has written, but for those that ``keep`` reads, and ``names``. Call it when no
    other result is read any more."""
    files, path = _files(spark)
    kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    for name in tables(spark) - kept - names:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of texts that go to a Python worker at once. Spark's default of 10,000 is meant for short rows.
BATCH = "1000"


def tune(spark: SparkSession) -> SparkSession:
    """Keep batches of texts small in memory, unless the session says how large they are to be."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH)
    return spark
