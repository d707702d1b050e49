"""Connected components of links, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start there, whatever executors are lost."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``a``, ``b``): the root is the least node of the component.

    Large-star, then small-star, until the edges no longer change: every edge then joins a node to its root. The steps are a
    grouped minimum and a join each, their number grows with the logarithm of the largest component's size. A node with many links is a skewed
    join key, which Spark splits; its minimum is merged before the shuffle.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "small-star")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            break
        state = tuple(after)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
