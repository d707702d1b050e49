"""A third of all rows on one key."""

import pytest
from pyspark.sql import functions as F

from outcomelens.functions import mean
from outcomelens.operators.preparation import dedup_counts, dedup_rows
from outcomelens.operators.segments import segment_report


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "rows")
    rows = spark.range(0, 90_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 100).alias("x"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_skewed_join_partition_is_split(spark, hot):
    names = spark.range(90_000).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = hot.join(names, F.col("k") == F.col("key"))
        report = segment_report(joined, {"x": "x"}, {"avg_len": mean(F.length("payload"), 2)})
        assert report.agg(F.sum("total_rows")).first()[0] == 90_000
        report.collect()
        assert "skew=true" in report._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_group_is_merged_before_the_shuffle(spark, hot):
    for frame in (segment_report(hot, {"k": "k"}, {"m": mean("x")}), dedup_rows(hot.select("k")),
                  dedup_counts(hot.select("k"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.rindex("Exchange hashpartitioning"):]
        assert "HashAggregate" in below
    distinct = len({7 if i % 3 == 0 else i for i in range(90_000)})
    assert tuple(dedup_counts(hot.select("k")).first()) == (90_000, distinct, 90_000 - distinct)
