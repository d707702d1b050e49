import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from outcomelens.operators.ordering import dense_ranks, exact_quantiles, previous_row, running_before


@pytest.mark.parametrize("seed", range(3))
def test_running_before_matches_brute_force(spark, seed):
    draw = random.Random(seed)
    data = {(g, v): draw.randint(0, 9) for g in "ab" for v in draw.sample(range(500), 120)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in data.items()], "g string, v int, n long")
    got = running_before(df, [F.col("v")], {"before": "n"}, by=["g"], ranges=7)
    for r in got.collect():
        assert r["before"] == sum(n for (g, v), n in data.items() if g == r["g"] and v < r["v"])
    assert got.count() == len(data)
    down = running_before(df.filter("g = 'a'"), [F.col("v").desc()], {"before": "n"}, ranges=5)
    for r in down.collect():
        assert r["before"] == sum(n for (g, v), n in data.items() if g == "a" and v > r["v"])


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_exact_quantiles_match_percentile_disc(spark, q):
    draw = random.Random(5)
    data = [(draw.choice([None, float("nan"), 7.0, draw.random()]), draw.randint(1, 3) * 1.0, None) for _ in range(901)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {r["column"]: r["value"] for r in exact_quantiles(df, ["a", "b", "c"], q).collect()}
    for c in "ab":
        want = df.filter(~F.isnan(c)).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias("m")).first()
        assert got[c] == want["m"]
    assert "c" not in got  # no value at all


def test_distributed_dense_rank_equals_window(spark, rows):
    draw = random.Random(1)
    data = [(i, draw.choice([None, *range(15)])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, x int")
    ranks = {"r": F.coalesce(F.col("x"), F.lit(-1)), "s": F.col("x") % 4}
    whole = Window.partitionBy()
    want = df.withColumns({n: F.dense_rank().over(whole.orderBy(v.desc())).cast("long") for n, v in ranks.items()})
    assert rows(dense_ranks(df, ranks), "i", "x", "r", "s") == rows(want, "i", "x", "r", "s")


def test_distributed_rank_inside_groups(spark, rows):
    draw = random.Random(2)
    data = [(draw.choice([None, "a", "b"]), draw.choice([None, 1, 2]), float(draw.randrange(30)), str(draw.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, h int, x double, t string")
    ranks = {"r": F.col("x"), "s": F.col("t")}
    groups = Window.partitionBy("g", "h")
    want = df.withColumns({n: F.dense_rank().over(groups.orderBy(v.desc())).cast("long") for n, v in ranks.items()})
    assert rows(dense_ranks(df, ranks, within=["g", "h"])) == rows(want)


def test_hot_value_is_one_row_before_ordering(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    want = sorted(r["x"] for r in df.collect())[14_999]
    assert exact_quantiles(df, ["x"]).first()["value"] == want


def test_previous_row_crosses_ranges_and_groups(spark):
    draw = random.Random(3)
    # one group holds most rows, others one to three, one is null
    data = [("hot", i) for i in draw.sample(range(100_000), 3000)] + [(f"g{k}", i) for k in range(60) for i in range(1 + k % 3)] + [(None, 5), (None, 2)]
    df = spark.createDataFrame([(g, i, i * 2) for g, i in data], "g string, i long, v long").repartition(6)
    got = previous_row(df, ["g"], ["i"], {"before": F.col("v"), "place": F.col("i") + 1}).collect()
    want, last = {}, {}
    for g, i in sorted(data, key=lambda r: (r[0] or "", r[1])):
        want[g, i], last[g] = last.get(g), i
    assert len(got) == len(data)
    for r in got:
        p = want[r["g"], r["i"]]
        assert (r["before"], r["place"]) == ((None, None) if p is None else (2 * p, p + 1))


def test_previous_row_has_no_task_per_group(spark):
    df = spark.range(30_000).select(F.lit("one").alias("g"), "id")
    placed = previous_row(df, ["g"], ["id"], {"before": F.col("id")})
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert placed.filter("before = id - 1").count() == 29_999
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan and sizes


def test_a_tied_value_crosses_ranges_and_counts_once(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 50).alias("x"), F.lit(1).alias("one"))
    whole = Window.partitionBy()
    want = {(r["id"], r["r"]) for r in df.withColumn("r", F.dense_rank().over(whole.orderBy(F.col("x").desc()))).collect()}
    got = dense_ranks(df, {"r": F.col("x"), "s": F.col("one")})
    assert {(r["id"], r["r"]) for r in got.collect()} == want and got.filter("s <> 1").count() == 0


def test_equal_rows_keep_their_number(spark, rows):
    df = spark.createDataFrame([(1, 2.0)] * 3 + [(2, None)] * 2, "i int, x double")
    assert rows(dense_ranks(df, {"r": F.col("x"), "s": F.col("i")})) == [(1, 2.0, 1, 2)] * 3 + [(2, None, 2, 1)] * 2
