"""File scans and sinks. Paths may be local, HDFS or any URI the cluster knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Headered CSV. Without a declared schema the types are inferred, at the price of one more pass."""
    reader = spark.read.options(header=True, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; inference (no schema) loses columns that are null in every row."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """JSON lines, one file per task; ``single_file`` gives up parallelism and is for small samples only."""
    (df.coalesce(1) if single_file else df).write.mode(mode).json(path)
