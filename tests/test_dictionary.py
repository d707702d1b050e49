import random

import pytest
from pyspark.sql import functions as F

from outcomelens.operators.dictionary import fit_dictionary, index_columns


def by_hand(values, most=None, min_rows=1):
    counts = {}
    for v in values:
        if v is not None:
            counts[str(v)] = counts.get(str(v), 0) + 1
    order = sorted((v for v in counts if counts[v] >= min_rows), key=lambda v: (-counts[v], v.encode()))
    return {v: i for i, v in enumerate(order if most is None else order[:most])}


@pytest.mark.parametrize("most, min_rows", [(None, 1), (3, 1), (None, 5), (0, 1)])
def test_slots_by_frequency(spark, most, min_rows):
    draw = random.Random(2)
    data = [(draw.choice([None, "a", "b", "é", "Z", "", "b"]), draw.choice([None, 1, 22, 3]), None) for _ in range(200)] + [("rare", 9, None)]
    df = spark.createDataFrame(data, "x string, `y z` int, w string")
    dictionary = fit_dictionary(df, ["x", "y z", "w"], most, min_rows)
    wanted = {c: by_hand([r[i] for r in data], most, min_rows) for i, c in enumerate(["x", "y z", "w"])}
    assert {(r["column"], r["value"]): r["slot"] for r in dictionary.collect()} == {(c, v): s for c, slots in wanted.items() for v, s in slots.items()}
    indexed = index_columns(df, dictionary, ["x", "y z", "w"])
    assert indexed.count() == len(data)
    for r in indexed.collect():
        for c, slots in wanted.items():
            assert r[f"{c}_slot"] == slots.get(None if r[c] is None else str(r[c]), len(slots))


def test_same_slots_as_the_indexer(spark):
    from pyspark.ml.feature import StringIndexer
    df = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 7 * F.col("id") % 11).alias("x"))
    fitted = StringIndexer(inputCol="x", outputCol="slot", handleInvalid="keep").fit(df)
    seen = df.union(spark.createDataFrame([("new",), (None,)], "x string"))
    want = {r["x"]: r["slot"] for r in fitted.transform(seen).collect()}
    got = {r["x"]: r["x_slot"] for r in index_columns(seen, fit_dictionary(df, ["x"]), ["x"]).collect()}
    assert got == want


def test_a_million_values_and_a_hot_one(spark):
    rows = spark.range(0, 1_500_000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    dictionary = fit_dictionary(rows, ["key"])
    facts = dictionary.agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"),
                           F.min_by("value", "slot").alias("first")).first()
    assert tuple(facts) == (1_000_001, 0, 1_000_000, 1_000_001, "hot")
    indexed = index_columns(rows, dictionary, ["key"])
    assert indexed.agg(F.count_if(F.col("key_slot") == 0), F.count_distinct("key_slot")).first()[:] == (500_000, 1_000_001)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x string")
    assert index_columns(df, fit_dictionary(df, ["x"]), ["x"]).columns == ["x", "x_slot"]
