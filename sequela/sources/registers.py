"""Reading registers, test results, stages and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_FILE = 5_000_000  # of a stage, at most


def load_register(
    spark: SparkSession, path: str, columns: Mapping[str, str], id_col: str
) -> DataFrame:
    """Project ``columns`` (name -> SQL expression) and drop rows without an id."""
    raw = spark.read.parquet(path)
    picked = raw.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])
    return picked.filter(F.col(id_col).isNotNull())


def positive_tests(tests: DataFrame, since: date, positive: str = "POSITIVE") -> DataFrame:
    """Positive tests taken on or after ``since``."""
    return tests.filter((F.col("result") == positive) & (F.col("specimen_date") >= F.lit(since)))


def positive_test_days(tests: DataFrame, positive: str = "POSITIVE") -> DataFrame:
    """One row per person and day with a positive test."""
    return (
        tests.filter(F.col("result") == positive)
        .select("person_id", F.to_date("specimen_date").alias("specimen_date"))
        .dropDuplicates(["person_id", "specimen_date"])
    )


def write_stage(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write a stage, with one folder per endpoint where rows have one.

    Rows meet by endpoint before they are written, so the number of files follows from the endpoints
    and the bytes, not from the tasks. Adaptive execution splits an endpoint that is larger than its
    advisory partition size over several tasks and lets small ones share a task; no file holds more
    than ``rows_per_file`` rows.
    """
    folders = [c for c in df.columns if c == "endpoint"]
    dealt = df.hint("rebalance", *[F.col(c) for c in folders]) if folders else df
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).parquet(path)
    return path


def read_stage(
    spark: SparkSession, path: str, schema: StructType, endpoint: str | None = None
) -> DataFrame:
    """Read a stage; naming an endpoint reads that endpoint's folder only."""
    stage = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    return stage if endpoint is None else stage.filter(F.col("endpoint") == endpoint)


def write_results(df: DataFrame, path: str) -> str:
    """Write a result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def stack_results(spark: SparkSession, paths: Sequence[str], schema: StructType) -> DataFrame:
    """Read result tables of one layout and stack them."""
    return spark.read.schema(schema).option("header", True).csv(list(paths))
