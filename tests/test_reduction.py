import random

import pytest
from pyspark.sql import functions as F

from outcomelens.config import DropGroup
from outcomelens.functions import safe_corr
from outcomelens.operators import correlation as C
from outcomelens.operators.reduction import Reduction, drop_present, reduction_ledger, removal_ledger, sparse_columns


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        a = draw.random()
        rows.append((
            a, a + draw.gauss(0, 0.02), a + draw.gauss(0, 0.05), draw.choice([None, draw.random()]), 1.0,
            a if i % 10 == 0 else None, "c", a * 2 + draw.gauss(0, 0.1),
        ))
    return spark.createDataFrame(
        rows, "f1 double, f2 double, f3 double, noise double, constant double, sparse double, kind string, "
        "`the price` double")


NUMERIC = ["f1", "f2", "f3", "noise", "constant", "sparse", "the price"]


def test_pairs_equal_single_correlations(table):
    pairs = C.corr_pairs(table, NUMERIC, "the price").collect()
    assert len(pairs) == 21
    for p in pairs:
        want = table.agg(safe_corr(f"`{p['feature_1']}`", f"`{p['feature_2']}`").alias("r")).first()["r"]
        assert p["r"] == (want if want is None else pytest.approx(want))
        assert p["r"] is None or -1 <= p["r"] <= 1 + 1e-12
        if p["feature_2"] == "the price":
            assert p["target_r_1"] == p["r"] and p["target_r_2"] is None


def test_pairs_with_a_target_outside_the_columns(table):
    inside = {(p["feature_1"], p["feature_2"]): p for p in C.corr_pairs(table, NUMERIC, "the price").collect()}
    for p in C.corr_pairs(table, NUMERIC[:3], "the price").collect():
        assert p["target_r_1"] == pytest.approx(inside[p["feature_1"], p["feature_2"]]["target_r_1"])
    assert {p["target_r_1"] for p in C.corr_pairs(table, NUMERIC[:3]).collect()} == {None}


def test_pairs_need_one_scan(table):
    plan = C.corr_pairs(table, NUMERIC, "the price")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_empty_table(table):
    assert C.corr_pairs(table.limit(0), NUMERIC, "the price").count() == 0
    assert removal_ledger(table.limit(0), NUMERIC, "the price", {}).count() == 0


def test_target_list_is_sorted_and_leaves_out_constants(table):
    found = C.corr_with_target(table, NUMERIC, "the price").collect()
    assert "constant" not in {r["feature"] for r in found}
    assert [r["abs_r"] for r in found] == sorted((r["abs_r"] for r in found), reverse=True)


def greedy(pairs, target, threshold):
    """The pairwise rule, written out."""
    strength = {}
    for p in pairs:
        strength[p["feature_1"]] = abs(p["target_r_1"] or 0)
        strength[p["feature_2"]] = abs(p["target_r_2"] or 0)
    out = set()
    for p in pairs:
        if target in (p["feature_1"], p["feature_2"]) or p["r"] is None or abs(p["r"]) < threshold:
            continue
        out.add(p["feature_2"] if strength[p["feature_1"]] >= strength[p["feature_2"]] else p["feature_1"])
    return out


def test_redundant_pick_is_pairwise(table):
    pairs = C.corr_pairs(table, NUMERIC, "the price")
    got = {r["feature"] for r in C.redundant_features(pairs, "the price").collect()}
    assert got == greedy(pairs.collect(), "the price", 0.85)
    assert {"f2", "f3"} <= got  # f1, f2, f3 are all alike: a marked feature still knocks out another
    assert "the price" not in got


def test_tie_drops_the_second(spark):
    df = spark.range(30).select(F.col("id").alias("a"), F.col("id").alias("b"), (F.col("id") % 7).alias("y"))
    assert [r["feature"] for r in C.redundant_features(C.corr_pairs(df, ["a", "b", "y"], "y"), "y").collect()] == ["b"]


def test_sparse_columns_threshold_is_inclusive(spark):
    df = spark.range(10).select(F.when(F.col("id") < 2, 1).alias("at80"), F.when(F.col("id") < 3, 1).alias("at70"))
    assert [r["column"] for r in sparse_columns(df, 80).collect()] == ["at80"]
    assert sparse_columns(df, 80, protect=["at80"]).count() == 0
    assert [r["column"] for r in sparse_columns(df, 70, candidates=["at70"]).collect()] == ["at70"]


def test_removal_ledger_keeps_first_reason(table, rows):
    ledger = removal_ledger(table, NUMERIC, "the price", {"kind": "by hand", "sparse": "too late", "absent": "x"})
    stages = {r["feature"]: r["stage"] for r in ledger.collect()}
    assert stages == {"sparse": "sparse", "kind": "manual", "f2": "redundant", "f3": "redundant"}
    assert {r["missing_percent"] for r in ledger.filter("feature = 'sparse'").collect()} == {90.0}
    reduced = Reduction.fit(ledger).transform(table)
    assert sorted([*reduced.columns, *stages]) == sorted(table.columns)


def test_reduction_ledger_counts_columns_left(spark, rows):
    df = spark.createDataFrame([(1, None, 3, 4), (1, 2, None, 4)], "a int, b int, c int, d int")
    groups = [DropGroup("one", ("a", "zz"), "ids"), DropGroup("two", ("b", "a"), "rest")]
    got = rows(reduction_ledger(df, groups), "stage", "column", "dropped", "missing_count", "columns_left", "row_count")
    assert got == [("one", "a", True, 0, 3, 2), ("one", "zz", False, None, 3, 2), ("two", "a", False, 0, 2, 2),
                   ("two", "b", True, 1, 2, 2)]
    left, dropped, skipped = drop_present(df, ["a", "zz"])
    assert left.columns == ["b", "c", "d"] and dropped == ["a"] and skipped == ["zz"]
