import random

import pytest
from pyspark.sql import functions as F

from outcomelens.functions import Band, lt, mean, outcome, safe_corr
from outcomelens.operators.ordering import dense_ranks
from outcomelens.operators.segments import bad_rate_pct, segment_report
from outcomelens.operators.temporal import date_features, quarter_change

BAND = Band((lt(0.3, "low"), lt(0.7, "mid")), "high")


@pytest.fixture(scope="module")
def loans(spark):
    draw = random.Random(7)
    data = [(
        draw.choice(["Completed", "Chargedoff", "Current", None]), draw.choice([None, draw.random()]),
        draw.choice([None, draw.gauss(1000, 3)]), draw.gauss(-5, 1), draw.choice(["x", "y", None]),
    ) for _ in range(600)]
    return spark.createDataFrame(data, "status string, util double, apr double, loss double, k string")


def measures():
    return {"avg_apr": mean("apr", 4), "rate": bad_rate_pct(outcome("status", ["Chargedoff"], ["Completed"]))}


def test_counts_over_bands_sum_to_required_rows(loans):
    report = segment_report(loans, {"b": (BAND, "util")}, measures(), require=["util", "apr"])
    assert report.agg(F.sum("total_rows")).first()[0] == loans.filter("util IS NOT NULL AND apr IS NOT NULL").count()
    everything = segment_report(loans, {"b": (BAND, "util")}, measures())
    assert everything.agg(F.sum("total_rows")).first()[0] == 600


def test_min_rows_drops_small_segments(loans):
    full = segment_report(loans, {"b": (BAND, "util"), "k": "k"}, measures()).collect()
    some = segment_report(loans, {"b": (BAND, "util"), "k": "k"}, measures(), min_rows=60).collect()
    assert {tuple(r) for r in some} == {tuple(r) for r in full if r["total_rows"] >= 60}


@pytest.mark.parametrize("require", [["util"], ["util", "apr"], []])
def test_pooled_and_subquery_correlations_agree_with_whole_table(loans, require):
    pairs = {"c1": ("apr", "loss"), "c2": ("util", "apr")}
    want = loans.agg(*[F.round(safe_corr(a, b), 4).alias(n) for n, (a, b) in pairs.items()]).first()
    banded = segment_report(loans, {"b": (BAND, "util")}, measures(), require, correlations=pairs)
    raw = segment_report(loans, {"b": (BAND, "util"), "k": "k"}, measures(), require, correlations=pairs)
    for report in (banded, raw):
        assert {(r["c1"], r["c2"]) for r in report.collect()} == {tuple(want)}
    plain = segment_report(loans, {"b": (BAND, "util")}, measures(), require)
    assert sorted(map(tuple, plain.collect())) == sorted(
        tuple(r) for r in banded.select(*plain.columns).collect())


def test_correlation_with_constant_or_absent_column_is_null(spark):
    df = spark.createDataFrame([(0.1, 1.0, None), (0.5, 1.0, None), (0.9, 1.0, None)], "u double, one double, n double")
    report = segment_report(df, {"b": (BAND, "u")}, {"m": mean("u")}, correlations={
        "constant": ("u", "one"), "absent": ("u", "n")})
    assert {(r["constant"], r["absent"]) for r in report.collect()} == {(None, None)}


def test_correlations_do_not_use_a_cross_join(loans):
    report = segment_report(loans, {"b": (BAND, "util")}, measures(), correlations={"c": ("apr", "loss")})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unresolved_segment_ranks_last(spark):
    df = spark.createDataFrame([("a", "Current", 9.0), ("b", "Completed", 1.0), ("c", "Chargedoff", 5.0)],
                               "k string, status string, apr double")
    report = segment_report(df, {"k": "k"}, measures())
    ranked = dense_ranks(report, {"p": F.col("avg_apr"), "d": F.coalesce("rate", F.lit(-1.0))})
    assert {r["k"]: (r["rate"], r["p"], r["d"]) for r in ranked.collect()} == {
        "a": (None, 1, 3), "b": (0.0, 3, 2), "c": (100.0, 2, 1)}


def test_quarter_change_over_a_gap(spark):
    df = spark.createDataFrame([("k", 2010, 4, 1.0), ("k", 2011, 1, 3.0), ("k", 2011, 3, 4.5), ("j", 2011, 3, 9.0)],
                               "k string, year long, quarter long, m double")

    def change(calendar):
        got = quarter_change(df, "m", by=["k"], calendar=calendar)
        return {(r["k"], r["year"], r["quarter"]): (r["prev_m"], r["m_change"]) for r in got.collect()}

    present, calendar = change(False), change(True)
    assert present[("k", 2011, 1)] == calendar[("k", 2011, 1)] == (1.0, 2.0)
    assert present[("k", 2011, 3)] == (3.0, 1.5) and calendar[("k", 2011, 3)] == (None, None)
    assert present[("j", 2011, 3)] == (None, None)


def test_date_features_from_text_and_timestamps(spark):
    df = spark.createDataFrame([("2012-03-05", "2012-01-05 10:00:00"), ("rubbish", None)], "a string, b string")
    df = df.withColumn("b", F.to_timestamp("b"))
    got = date_features(df, {"a": "a", "x": "absent"}, {"days": ("a", "b"), "none": ("a", "absent")}, drop=["a", "b", "z"])
    assert got.columns == ["a_year", "a_month", "days"]
    assert [tuple(r) for r in got.collect()] == [(2012, 3, 60), (None, None, None)]


def test_correlations_come_from_the_scan_of_the_report(spark, tmp_path):
    import random

    import numpy as np
    draw = random.Random(8)
    data = []
    for i in range(800):
        x = draw.gauss(1e6, 1)
        data.append((draw.choice(["a", "b", "c", None]), x, draw.choice([None, x + draw.gauss(0, 2)]), 4.0, i))
    spark.createDataFrame(data, "g string, x double, y double, flat double, i int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    report = segment_report(df, {"g": "g"}, {"top": F.max("i")}, require=["g"], min_rows=1, correlations={"xy": ("x", "y"), "xf": ("x", "flat")}, digits=9)
    both = [(x, y) for _, x, y, _, _ in data if y is not None]
    want = float(np.corrcoef(*zip(*both))[0, 1])
    assert {r["g"] for r in report.collect()} == {"a", "b", "c"}
    assert all(abs(r["xy"] - want) < 1e-6 and r["xf"] is None for r in report.collect())
    assert "Scan parquet" not in report._jdf.queryExecution().executedPlan().toString()  # the table was read before, once
    nothing = segment_report(df.limit(0), {"g": "g"}, {}, require=["g"], correlations={"xy": ("x", "y")})
    assert nothing.collect() == []
