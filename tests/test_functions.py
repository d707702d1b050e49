from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from outcomelens.config import feature_types, quoted
from outcomelens.functions import Band, eq, ge, le, lt, mean, outcome, outcome_group, pct_error, safe_corr, share_pct
from outcomelens.operators.segments import bad_rate_all, bad_rate_pct

NEGATIVE, POSITIVE = ["Chargedoff", "Defaulted"], ["Completed"]


def test_outcome_and_group(spark):
    df = spark.createDataFrame([("Chargedoff",), ("Defaulted",), ("Completed",), ("Current",), (None,)], "s string")
    got = df.select(outcome("s", NEGATIVE, POSITIVE).alias("o"), outcome_group("s", NEGATIVE, POSITIVE).alias("g"))
    assert [tuple(r) for r in got.collect()] == [
        (1.0, "Bad"), (1.0, "Bad"), (0.0, "Good"), (None, "Other"), (None, "Other")]


@pytest.mark.parametrize("band, values, expected", [
    (Band((lt(0.1, "low"), lt(0.3, "mid")), "high"), [0.0, 0.0999, 0.1, 0.2999, 0.3, None, float("nan")],
     ["low", "low", "mid", "mid", "high", "high", "high"]),
    (Band((eq(0, "none"), le(2, "1-2"), le(5, "3-5")), "6+"), [0.0, 1.0, 2.0, 2.5, 5.0, 6.0, None],
     ["none", "1-2", "1-2", "3-5", "3-5", "6+", "6+"]),
    (Band((ge(1.0, "full"), ge(0.8, "most")), "part"), [1.2, 1.0, 0.9999, 0.8, 0.7999, None],
     ["full", "full", "most", "most", "part", "part"]),
    (Band((eq(0, "none"), eq(1, "one")), "more", null_as=0), [None, 0.0, 1.0, 2.0], ["none", "none", "one", "more"]),
])
def test_band_boundaries(spark, band, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    assert [r["b"] for r in df.select("i", band.of("x").alias("b")).orderBy("i").collect()] == expected
    assert set(expected) <= set(band.labels)


def test_rare_rate_is_not_rounded_early(spark):
    df = spark.range(30007).select(outcome(F.when(F.col("id") == 0, "Chargedoff").otherwise("Completed"),
                                           NEGATIVE, POSITIVE).alias("o"))
    assert df.agg(bad_rate_pct(F.col("o"), 6).alias("r")).first()["r"] == 0.003333


def test_correlation_uses_complete_pairs_only(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 9.0)], "a double, b double")
    assert round(df.agg(safe_corr("a", "b").alias("r")).first()["r"], 6) == 0.963123
    assert round(df.agg(F.corr("a", "b").alias("r")).first()["r"], 6) == 0.963123


def test_correlation_with_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    got = df.agg(safe_corr("a", "b").alias("x"), safe_corr("b", "a").alias("y"), safe_corr("b", "b").alias("z")).first()
    assert tuple(got) == (None, None, None)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.agg(F.corr("a", "b")).collect()
    assert df.limit(0).agg(safe_corr("a", "b").alias("r")).first()["r"] is None
    assert df.limit(1).agg(safe_corr("a", "b").alias("r")).first()["r"] is None


def test_perfect_correlations(spark):
    df = spark.range(20).select(F.col("id").alias("a"), (F.col("id") * -3 + 7).alias("b"), (F.col("id") * 2).alias("c"))
    got = df.agg(safe_corr("a", "b").alias("x"), safe_corr("a", "c").alias("y")).first()
    assert got["x"] == pytest.approx(-1) and got["y"] == pytest.approx(1)


def test_means_and_shares(spark):
    df = spark.createDataFrame([(1.0, "Chargedoff"), (None, "Completed"), (2.0, "Current"), (None, None)],
                               "x double, s string")
    got = df.agg(
        mean("x").alias("m"), mean("x", null_as=0).alias("m0"), share_pct(F.col("x") < 2).alias("p"),
        bad_rate_pct(outcome("s", NEGATIVE, POSITIVE)).alias("resolved"), bad_rate_all("s", NEGATIVE).alias("all"),
    ).first()
    assert tuple(got) == (1.5, 0.75, 25.0, 50.0, 0.25)


def test_pct_error_skips_zero_target(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert df.agg(F.avg(pct_error(F.col("y"), F.col("p"))).alias("m")).first()["m"] == 0.5


def test_feature_types_and_quoted_names(spark):
    df = spark.createDataFrame(
        [(1, 2, Decimal(3), "a", True)], "`a b (percentage)` tinyint, i smallint, d decimal(5,2), s string, b boolean")
    types = feature_types(df, exclude={"i"})
    assert types.numeric == ["a b (percentage)", "d"] and types.categorical == ["s", "b"]
    assert df.select(F.col(quoted("a b (percentage)"))).first()[0] == 1
