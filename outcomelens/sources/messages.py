"""Records as JSON messages, published to and read from Kafka or files.

The format is a parameter. The Kafka connector comes with spark-submit (``--packages``); the ``text`` format has the
same ``value`` column and needs nothing. Pacing is set on the reader: ``maxOffsetsPerTrigger`` for Kafka,
``maxFilesPerTrigger`` for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON text per row in ``value``, with the record key in ``key`` if asked for."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def publish(
    df: DataFrame, format: str = "kafka", path: str | None = None, limit: int | None = None, key: str | None = None,
    **options,
) -> None:
    """Write every row (or the first ``limit``) as a message, in parallel from all tasks."""
    messages = to_messages(df if limit is None else df.limit(limit), key if format == "kafka" else None)
    writer = messages.write.format(format).options(**options)
    if format == "kafka":
        writer.save()
    else:
        writer.mode("append").save(path)


def read_message_stream(spark: SparkSession, format: str = "kafka", path: str | None = None, **options) -> DataFrame:
    """Streaming frame with a ``value`` column; Kafka starts at the earliest offset unless told otherwise."""
    if format == "kafka":
        options = {"startingOffsets": "earliest", **options}
    reader = spark.readStream.format(format).options(**options)
    stream = reader.load(path) if path else reader.load()
    return stream.select(F.col("value").cast("string").alias("value"))
