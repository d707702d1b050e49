import pytest
from pyspark.sql import functions as F

from outcomelens.operators import profiling as P
from outcomelens.sources import read_csv, read_json, write_csv, write_json


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, None, float("nan")), (None, None, None), (4, "b", 3.0)], "`the id` int, s string, x double")


def test_shape(small):
    assert P.shape(small, min_rows=3, min_columns=2).first().asDict() == {
        "row_count": 4, "column_count": 3, "enough_rows": True, "enough_columns": True, "accepted": True}
    assert not P.shape(small).first()["accepted"]


def test_missing_summary_counts_nulls_not_nan(small, rows):
    assert rows(P.missing_summary(small, exclude=["x"])) == [
        ("s", "string", 2, 2, 50.0), ("the id", "int", 1, 3, 25.0)]
    assert rows(P.missing_summary(small.limit(0)), "column", "missing_percent") == [
        ("s", 0.0), ("the id", 0.0), ("x", 0.0)]
    assert [r["column"] for r in P.missing_top(small, 2).collect()] == ["s", "the id"]


def test_required_columns(small, rows):
    with pytest.raises(ValueError, match="y"):
        P.required_column_report(small, ["x", "y"])
    assert rows(P.required_column_report(small, ["x", "s"])) == [("s", 4, 2, 0, False), ("x", 4, 1, 1, False)]


def test_target_summary(small):
    got = P.target_summary(small.filter(~F.isnan("x")), "x").first()
    assert (got["row_count"], got["target_mean"], got["target_min"], got["target_max"]) == (2, 2.0, 1.0, 3.0)
    assert round(got["target_stddev"], 6) == 1.414214


def test_histogram_covers_all_rows(spark, rows):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    bins = P.histogram(df, "x", 10)
    assert bins.agg(F.sum("n")).first()[0] == 101
    assert rows(bins.filter("bin = 10"), "bin_start", "bin_end", "n") == [(90.0, 100.0, 11)]
    assert rows(P.histogram(df.select(F.lit(2.0).alias("x")), "x", 10), "bin", "n") == [(1, 101)]
    assert P.histogram(df.limit(0), "x", 10).count() == 0


def test_distributions(spark, rows):
    df = spark.createDataFrame([("b",), ("b",), ("a",), (None,), ("z",)], "v string")
    assert rows(P.distribution(df, "v", "v", with_percent=True)) == [
        ("a", 1, 20.0), ("b", 2, 40.0), ("z", 1, 20.0), (None, 1, 20.0)]
    ordered = [(r["v"], r["position"]) for r in P.ordinal_distribution(df, "v", ["b", "a"]).collect()]
    assert ordered == [("b", 1), ("a", 2), (None, 3), ("z", 3)]
    assert [tuple(r) for r in P.nulls_last_distribution(df, "v").collect()] == [
        ("a", 1), ("b", 2), ("z", 1), ("Missing", 1)]


def test_csv_and_json_round_trip(spark, small, rows, tmp_path):
    write_csv(small, f"{tmp_path}/csv")
    declared = read_csv(spark, f"{tmp_path}/csv", small.schema)
    assert declared.schema.simpleString() == small.schema.simpleString()
    assert repr(rows(declared)) == repr(rows(small))
    assert dict(read_csv(spark, f"{tmp_path}/csv").dtypes)["the id"] == "int"
    write_json(small.drop("x"), f"{tmp_path}/json", single_file=True)
    assert len(list((tmp_path / "json").glob("*.json"))) == 1
    assert rows(read_json(spark, f"{tmp_path}/json", small.drop("x").schema)) == rows(small.drop("x"))
