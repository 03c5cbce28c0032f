"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ROWS_PER_TASK = 100_000  # rows that one task groups or joins, however well they were compressed before


def scratch_folder(spark: SparkSession) -> str:
    """Folder of this application for intermediate files, removed when its JVM ends.

    It lies in ``spark.checkpoint.dir`` where the session names one, else below the
    warehouse, which Spark resolves on its default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    folder = f"{base.rstrip('/')}/stages-{spark.sparkContext.applicationId}"
    fs, path = _hadoop(spark, folder)
    fs.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, name: str = "stage") -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate files, if it is there."""
    fs, path = _hadoop(spark, folder)
    fs.delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    For tables that several branches of a plan read: they are built once, and a
    lost executor costs a re-read, not the work before the stage.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads again."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            remove(table.sparkSession, folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle that end in here goes from the disks when they end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tasks(spark: SparkSession) -> int:
    """Tasks over which a small table is spread whose rows cost much: all cores, or the shuffle's partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(rows: int, spark: SparkSession, each: int = ROWS_PER_TASK) -> int:
    """Tasks that share so many rows. Their bytes on disk say little of what tasks hold of them."""
    return max(tasks(spark), -(-rows // each))


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
