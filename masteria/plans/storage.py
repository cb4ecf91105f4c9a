"""Tables written in the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, the checkpoint folder of the running application is used; a folder of
    its own is made in local mode only, where all tasks run on one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """Tables of one application lie below a folder of their own."""
    return f"{shared_folder(spark)}/masteria/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stored. Frames that read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame once and read it back."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    for tables in _recording:
        tables.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Write the frame once in buckets by ``keys``, one file each, and read it back.

    Buckets are known to the catalogue of the session only, so the table has a name there; its files lie with the others.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    table = f"masteria_{name}_{uuid.uuid4().hex}"
    # The shuffle and the buckets hash alike, so each task writes one bucket.
    frame.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    for tables in _recording:
        tables.append(path)
    return spark.table(table)


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are stored inside the block."""
    tables: list[str] = []
    _recording.append(tables)
    try:
        yield tables
    finally:
        _recording[:] = [t for t in _recording if t is not tables]


def drop(spark: SparkSession, tables: list[str], kept: DataFrame) -> list[str]:
    """Remove stored tables but those that ``kept`` reads, which are returned."""
    read = {unquote(urlparse(file).path) for file in kept.inputFiles()}
    needed = [t for t in tables if any(file.startswith(f"{urlparse(t).path}/") for file in read)]
    for table in tables:
        if table not in needed:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return needed
