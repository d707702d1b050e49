import hashlib
import random

import pytest
from pyspark.sql import functions as F

from outcomelens.config import ColumnGroups
from outcomelens.operators.preparation import (
    Preparer, dedup_counts, dedup_rows, fill_unknown, fill_values, label_set, medians, standardize_types, target_set,
)
from outcomelens.operators.splitting import (
    exact_split,
    ClassWeights, class_weight_table, hash_bucket, hash_split, stable_sample,
)

GROUPS = ColumnGroups(
    status="status", target="apr", numeric=("term", "ratio"), categorical=("income",), boolean=("owner",),
    dates=("listed", "originated"))


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([
        ("Completed", 0.1, 36, 1.0, "low", "TRUE", "2012-01-01", "2012-01-31"),
        ("Chargedoff", None, 60, float("nan"), None, None, "2012-02-01", None),
        ("Current", float("nan"), None, 3.0, "high", "no idea", "rubbish", "2012-05-01"),
        (None, 0.3, 12, None, "low", "false", None, "2012-06-01"),
    ], "status string, apr double, term int, ratio double, income string, owner string, listed string, originated string")


def preparer(**options):
    return Preparer(GROUPS, date_parts={"listing": "listed"}, day_spans={"wait_days": ("originated", "listed")}, **options)


def test_types(raw):
    typed = standardize_types(raw, GROUPS)
    assert dict(typed.dtypes)["term"] == "double"
    assert [r["owner"] for r in typed.collect()] == ["true", "Unknown", "no idea", "false"]
    flags = raw.select((F.col("term") > 36).alias("owner"))
    assert [r["owner"] for r in standardize_types(flags, GROUPS).collect()] == ["false", "true", "Unknown", "false"]
    text = raw.select(F.lit("12x").alias("ratio"))
    assert standardize_types(text, GROUPS).first()["ratio"] is None


@pytest.mark.parametrize("exact", [False, True])
def test_fit_on_train_fills_others_and_leaves_the_target(raw, exact):
    train = raw.filter("income = 'low'")
    prepared = preparer(exact=exact).fit(train)
    assert prepared.fill == {"term": 12.0, "ratio": 1.0, "listing_year": 2012.0, "listing_month": 1.0, "wait_days": 30.0}
    out = prepared.transform(raw)
    got = out.select("term", "ratio", "income", "owner", "listing_year", "wait_days").collect()
    assert [tuple(r) for r in got] == [
        (36.0, 1.0, "low", "true", 2012.0, 30.0), (60.0, 1.0, "Unknown", "Unknown", 2012.0, 30.0),
        (12.0, 3.0, "high", "no idea", 2012.0, 30.0), (12.0, 1.0, "low", "false", 2012.0, 30.0)]
    assert "listed" not in out.columns and "originated" not in out.columns
    assert target_set(out, "apr", "status").count() == 2  # the target was not imputed, so the filter has work to do


def test_impute_target_compatibility(raw):
    out = preparer(impute_target=True).fit(raw).transform(raw)
    assert target_set(out, "apr").count() == 4


def test_column_without_values_is_filled_with_zero(raw):
    empty = raw.withColumn("ratio", F.lit(None).cast("double"))
    for exact in (False, True):
        assert preparer(exact=exact).fit(empty).fill["ratio"] == 0.0


def test_imputation_changes_no_present_value(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(i, draw.choice([None, float("nan"), draw.random()])) for i in range(300)],
                               "i int, x double")
    both = df.join(fill_values(df, {"x": 5.0}).withColumnRenamed("x", "y"), "i")
    assert both.filter("y IS NULL OR isnan(y)").count() == 0
    assert both.filter("x IS NOT NULL AND NOT isnan(x) AND x <> y").count() == 0


def test_median_all_columns_in_one_pass(raw):
    one = medians(raw, ["term", "ratio", "apr"])
    assert tuple(one.first()) == (36.0, 1.0, 0.1)
    assert one._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_transform_is_a_projection(raw):
    plan = preparer().fit(raw).transform(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dedup(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    assert rows(dedup_rows(df)) == [(1, None), (2, "a"), (3, "b")]
    assert rows(dedup_counts(df)) == [(6, 3, 3)]
    assert rows(dedup_counts(df.limit(0))) == [(0, 0, 0)]


def test_label_and_target_sets(raw, rows):
    labelled = label_set(raw, "status", ["Chargedoff", "Defaulted"], ["Completed"], exclude=["apr"])
    assert "status" not in labelled.columns and "apr" not in labelled.columns
    assert rows(labelled, "term", "label") == [(36, 0), (60, 1)]
    with pytest.raises(ValueError):
        label_set(raw, "state", ["x"], ["y"])
    with pytest.raises(ValueError):
        target_set(raw, "price")


def test_fill_unknown_skips_absent(raw):
    assert [r["income"] for r in fill_unknown(raw, ["income", "absent"]).collect()] == ["low", "Unknown", "high", "low"]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))


def test_split_is_disjoint_exhaustive_and_stratified(keyed):
    parts = hash_split(keyed, ["k"], {"train": 7, "test": 2, "stream": 1})
    counts = {n: {r["label"]: r["count"] for r in p.groupBy("label").count().collect()} for n, p in parts.items()}
    assert sum(sum(c.values()) for c in counts.values()) == 10_000
    assert parts["train"].unionByName(parts["test"]).unionByName(parts["stream"]).select("k").distinct().count() == 10_000
    for label, total in ((0, 6666), (1, 3334)):
        for name, share in (("train", 0.7), ("test", 0.2), ("stream", 0.1)):
            assert abs(counts[name][label] / total - share) < 0.02


def test_split_does_not_depend_on_layout(keyed, rows):
    split = {"a": 8, "b": 2}
    once = hash_split(keyed, ["k"], split)["b"]
    again = hash_split(keyed.repartition(13).orderBy(F.desc("k")), ["k"], split)["b"]
    assert rows(once, "k") == rows(again, "k")
    assert rows(once, "k") != rows(hash_split(keyed, ["k"], split, salt="s")["b"], "k")
    assert keyed.select(hash_bucket(["k"], 10).alias("b")).agg(F.min("b"), F.max("b")).first()[:] == (0, 9)


def test_class_weights(spark, keyed):
    weights = ClassWeights.fit(keyed)
    assert weights.bad == pytest.approx(10_000 / (2 * 3334)) and weights.good == pytest.approx(10_000 / (2 * 6666))
    total = weights.transform(keyed).agg(F.sum("class_weight")).first()[0]
    assert total == pytest.approx(10_000)
    assert class_weight_table(keyed.filter("label = 0")).first()["bad_weight"] == 3333.0


def test_stable_sample(keyed, rows):
    one = stable_sample(keyed, ["k"], 50)
    assert rows(one) == rows(stable_sample(keyed.repartition(7), ["k"], 50)) and one.count() == 50
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()


def quotas(n, shares):
    total = sum(shares)
    even = [n * s // total for s in shares]
    order = sorted(range(len(shares)), key=lambda i: (-(n * shares[i] % total), i))
    for i in order[:n - sum(even)]:
        even[i] += 1
    return even


def test_exact_split_meets_every_quota(spark):
    # a third of all rows under one label, labels of one to thirteen rows, a null label
    data = [(i, "hot") for i in range(3000)] + [(10_000 + 100 * k + i, f"l{k}") for k in range(1, 14) for i in range(k)] + [(20_000 + i, None) for i in range(17)]
    df = spark.createDataFrame(data, "k long, label string").repartition(5)
    shares = {"train": 7, "test": 2, "stream": 1}
    split = exact_split(df, ["k"], "label", shares, salt="s")
    counts = {}
    for r in split.groupBy("label", "part").count().collect():
        counts.setdefault(r["label"], {})[r["part"]] = r["count"]
    for label, found in counts.items():
        n = sum(1 for _, other in data if other == label)
        assert [found.get(p, 0) for p in shares] == quotas(n, list(shares.values())), label
    again = exact_split(df.repartition(2), ["k"], "label", shares, salt="s")
    assert split.exceptAll(again).count() == 0 and split.count() == len(data)
    other = exact_split(df, ["k"], "label", shares, salt="t")
    assert split.exceptAll(other).count() > 500


def test_exact_split_keeps_a_key_together(spark, rows):
    df = spark.createDataFrame([(i % 40, "a") for i in range(200)], "k long, label string")
    parts = {}
    for k, part in rows(exact_split(df, ["k"], "label", {"x": 1, "y": 1}).select("k", "part").distinct()):
        assert parts.setdefault(k, part) == part
    assert sorted(parts) == list(range(40)) and exact_split(df.limit(0), ["k"], "label", {"x": 1, "y": 1}).count() == 0


def test_exact_split_orders_a_hot_label_in_many_tasks(spark):
    from outcomelens.operators.ordering import in_ranges
    from outcomelens.operators.splitting import key_digest
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("label"), key_digest(["id"]).alias("d"))
    sizes = [r["count"] for r in in_ranges(df, ["label", "d"], 8).filter("label = 'hot'").groupBy("_range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 4000


def test_exact_split_puts_only_buckets_with_an_end_in_order(spark, monkeypatch):
    from outcomelens.operators import ordering, splitting
    ordered = []

    def counting(df, *args, **kwargs):
        ordered.append(df.count())
        return ordering.running_before(df, *args, **kwargs)

    monkeypatch.setattr(splitting, "running_before", counting)
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        split = exact_split(df, ["k"], "label", {"a": 7, "b": 2, "c": 1}, salt="s")
        assert "SortMergeJoin" not in split._jdf.queryExecution().executedPlan().toString()  # whole rows stay where they are
        found = {r["k"]: r["part"] for r in split.collect()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert {r["k"]: r["part"] for r in exact_split(df, ["k"], "label", {"a": 7, "b": 2, "c": 1}, salt="s").collect()} == found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(ordered) <= 2 * 16 ** splitting.BUCKET_DIGITS  # before: all 40,000 digests
    for label in (0, 1):
        keys = sorted(range(label, 40_000, 2), key=lambda k: hashlib.md5(f"s-{k}".encode()).hexdigest())
        assert [found[k] for k in keys] == ["a"] * 14_000 + ["b"] * 4_000 + ["c"] * 2_000


def test_features_are_what_the_groups_name(spark):
    df = spark.createDataFrame([("k1", 1.0, 2.0, "x", "y", 2010, 0.1, 7.0)],
                               "loan_key string, term double, ratio double, income string, owner string, listed_year int, apr double, unknown double")
    found = Preparer(GROUPS, {"listed": "listed"}, {}).features(df)
    assert found.numeric == ["term", "ratio", "listed_year"] and found.categorical == ["income", "owner"]
    assert Preparer(GROUPS, {"listed": "listed"}, {}).features(df, more=["apr", "absent"]).numeric == ["term", "ratio", "listed_year", "apr"]
