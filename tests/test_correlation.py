import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcomelens.operators.correlation import corr_pairs, moment_corr, pair_cells, pair_moments

NAMES = ["flat", "far", "some", "line", "none", "few", "shifted"]


def made(n=400):
    draw = random.Random(6)
    data = []
    for i in range(n):
        x = draw.gauss(0, 1)
        data.append((7.25, 1e9 + x, draw.choice([None, x, x + draw.random()]), -2.0 * x, None, draw.choice([None] * 40 + [3.0]), 1e15 if i == 0 else 5e6 + x * 1e-3))
    return data


def by_numpy(data, i, j):
    both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
    if not both:
        return 0, None
    x, y = (np.array(c, dtype=np.longdouble) for c in zip(*both))
    x, y = x - x.mean(), y - y.mean()
    spread = (x @ x) * (y @ y)
    return len(both), float((x @ y) / np.sqrt(spread)) if spread > 0 else None


@pytest.mark.parametrize("block, held", [(128, 1 << 28), (2, 1 << 28), (3, 10)])
def test_blocks_match_pair_by_pair(spark, block, held):
    data = made()
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in NAMES)).repartition(5)
    got = {(r["a"], r["b"]): r for r in pair_moments(df, NAMES, ["few", "none"], block, held).withColumn("r", moment_corr()).collect()}
    for i in range(len(NAMES)):
        for j in range(i, len(NAMES)):
            n, r = by_numpy(data, i, j)
            found = got.get((i, j))
            assert (found["n"] if found else 0) == n, (i, j)
            assert found["r"] is None if r is None else math.isclose(found["r"], r, rel_tol=1e-6, abs_tol=1e-6), (NAMES[i], NAMES[j], found["r"], r)
    few = sum(r[5] is not None for r in data)
    assert got[7, 7]["n"] == few and got[8, 8]["n"] == 0 and got[-1, -1]["n"] == len(data)


def test_cells_are_ordered_and_whole(spark):
    df = spark.createDataFrame(made(50), ", ".join(f"{n} double" for n in NAMES))
    cells = pair_cells(df, NAMES[:3], ["few"]).first()["cells"]
    assert [(c["a"], c["b"]) for c in cells] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (3, 3)]
    assert {c["row_count"] for c in cells} == {50}
    assert pair_cells(df.limit(0), NAMES).first()["cells"] == [] and pair_cells(df, [], ["few"]).first()["cells"][0]["row_count"] == 50


def test_values_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1.0, 1.0, nan), (2.0, 3.0, 1.0), (3.0, inf, 2.0), (4.0, None, 5.0), (5.0, 4.0, None)]
    df = spark.createDataFrame(data, "x double, y double, z double")
    r = {(p["feature_1"], p["feature_2"]): p["r"] for p in corr_pairs(df, ["x", "y", "z"]).collect()}
    assert all(math.isnan(r[pair]) for pair in [("x", "y"), ("x", "z"), ("y", "z")])
    assert math.isclose({(p["feature_1"], p["feature_2"]): p["r"] for p in corr_pairs(df.where("x <> 3"), ["x", "y"]).collect()}["x", "y"],
                        np.corrcoef([1, 2, 5], [1, 3, 4])[0, 1])


def test_many_columns_in_one_scan(spark):
    names = [f"c{i}" for i in range(200)]
    df = spark.range(0, 2000, 1, 4).select(*[F.randn(i).alias(n) for i, n in enumerate(names)]).withColumn("c199", F.col("c0") * -3)
    pairs = corr_pairs(df, names)
    assert pairs.count() == 200 * 199 // 2
    top = pairs.orderBy(F.abs("r").desc()).first()
    assert (top["feature_1"], top["feature_2"], round(top["r"], 9)) == ("c0", "c199", -1.0)
