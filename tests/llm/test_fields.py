import random

from pyspark.sql import functions as F

from outcomelens.llm import warc
from outcomelens.llm.fields import hashed_field, held


def test_nothing_put_in_is_missed(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    for bits in (64, 1 << 12, 1 << 20):
        some = df.where("id % 7 = 0")
        field = hashed_field(some, F.col("h"), bits)
        found = {r["id"] for r in df.where(held(df, field, F.col("h"))).collect()}
        assert found >= {i for i in range(5000) if i % 7 == 0}
        assert bits < 1 << 20 or len(found) < 760
    assert df.where(held(df, hashed_field(df.limit(0), F.col("h")), F.col("h"))).count() == 0


def test_archives_do_not_hang_on_the_field(spark):
    draw = random.Random(3)
    bodies = ["x" * 150 + str(i) for i in range(12)] + ["short", "", None]
    data = [(draw.choice([None, *range(80)]), f"http://h/{i}", draw.choice(bodies)) for i in range(200)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    want = None
    for bits in (64, 1 << 10, 1 << 22):  # the smallest lets every page through in vain
        got = sorted(r["value"] for r in warc.render(pages, "page_id", "url", "html", 100, "2024-01-01T00:00:00Z", bits).collect())
        want = want or got
        assert got == want and len(got) == 200


def test_payloads_are_not_shuffled(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.concat((F.col("id") % 2000).cast("string"), F.lit("a")), 90).alias("html"))
    plan = warc.render(pages, "page_id", "url", "html", 100, "2024-01-01T00:00:00Z")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
