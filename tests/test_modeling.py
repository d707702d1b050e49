import random

import pytest
from pyspark.sql import functions as F

from outcomelens.operators import modeling as M
from outcomelens.operators import scoring as S
from outcomelens.operators.splitting import ClassWeights, hash_split
from outcomelens.streaming import score

NUMERIC, CATEGORICAL = ["x", "z"], ["kind"]


@pytest.fixture(scope="module")
def parts(spark):
    draw = random.Random(4)
    data = []
    for i in range(3000):
        x, z, kind = draw.random(), draw.random(), draw.choice(["p", "q", "r"])
        price = 10 * x + {"p": 0, "q": 2, "r": 5}[kind] + draw.gauss(0, 0.2)
        data.append((i, x, z, kind, price, int(price > 8)))
    df = spark.createDataFrame(data, "k int, x double, z double, kind string, price double, label int")
    return hash_split(df, ["k"], {"train": 7, "test": 3})


@pytest.fixture(scope="module")
def comparison(parts):
    weights = ClassWeights.fit(parts["train"])
    specs = M.classifier_specs(lr_iter=20, trees=10, forest_depth=4, boost_iter=5, boost_depth=3)
    return M.compare_classifiers(weights.transform(parts["train"]), parts["test"], NUMERIC, CATEGORICAL, specs)


def test_classifiers_learn_and_best_has_highest_pr_auc(comparison):
    metrics = {r["model"]: r for r in comparison.metrics.collect()}
    assert len(metrics) == 3 and all(r["roc_auc"] > 0.9 for r in metrics.values())
    assert metrics[comparison.best_name]["pr_auc"] == max(r["pr_auc"] for r in metrics.values())


def test_saved_model_scores_the_same(spark, comparison, parts, rows, tmp_path):
    comparison.save_best(f"{tmp_path}/model")
    records = parts["test"].drop("label")
    columns = ["k", "prediction", "bad_probability", "prediction_label"]
    before = score(records, comparison.best)
    after = score(records, M.load_model(f"{tmp_path}/model"))
    assert rows(before, *columns) == rows(after, *columns)
    assert after.columns == [*records.columns, "prediction", "bad_probability", "good_probability", "prediction_label",
                             "prediction_time"]


def test_unseen_category_is_scored(comparison, parts):
    odd = parts["test"].drop("label").withColumn("kind", F.lit("new"))
    assert score(odd, comparison.best).filter("bad_probability IS NULL").count() == 0


@pytest.mark.parametrize("name", ["Logistic Regression", "Random Forest"])
def test_importance_sums_to_hundred_per_source_column(comparison, parts, name):
    got = M.importance_rollup(comparison.models[name], parts["test"], NUMERIC, CATEGORICAL).collect()
    assert {r["feature"] for r in got} == {"x", "z", "kind"}
    assert sum(r["importance_pct"] for r in got) == pytest.approx(100, abs=0.01)
    assert next(r["rank"] for r in got if r["feature"] == "z") == 3


def test_regressors_beat_the_mean_baseline(parts):
    train = parts["train"].withColumn("x", F.when(F.col("k") % 50 != 0, F.col("x")))  # some to impute
    specs = M.regressor_specs("price", trees=10, forest_depth=5, boost_iter=10, step=0.3)
    result = M.compare_regressors(train, parts["test"], NUMERIC, CATEGORICAL, "price", specs)
    metrics = {r["model"]: r for r in result.metrics.collect()}
    base = metrics.pop(M.BASELINE)
    assert all(r["rmse"] < base["rmse"] / 2 for r in metrics.values()) and base["r2"] < 0.01
    assert result.best_name == min(metrics, key=lambda m: metrics[m]["rmse"])
    rolled = M.importance_rollup(result.best, parts["test"], NUMERIC, CATEGORICAL)
    assert rolled.orderBy("rank").first()["feature"] == "x"


def test_feature_scores(parts):
    ranked = S.classification_scores(parts["train"], NUMERIC, CATEGORICAL, trees=10, depth=4).orderBy("rank").collect()
    assert [r["feature"] for r in ranked][0] == "x" and ranked[-1]["feature"] == "z"
    assert all(r["selected"] for r in ranked) and ranked[0]["chi_square_score_normalized"] == 1.0
    top = S.regression_scores(parts["train"], NUMERIC, CATEGORICAL, "price", trees=10, depth=4, top_k=1)
    assert {r["feature"]: r["selected"] for r in top.collect()} == {"x": True, "kind": False, "z": False}
    assert top.filter("feature = 'kind'").first()["absolute_correlation"] == 0.0


def test_categories_beyond_the_usual_number_of_bins(spark):
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"),
                                  F.concat(F.lit("c"), (F.col("id") % 60).cast("string")).alias("kind"), F.col("id").cast("double").alias("price"))
    ranked = S.classification_scores(df, ["x"], ["kind"], trees=3, depth=3).collect()
    assert {r["feature"] for r in ranked} == {"x", "kind"}
    assert S.regression_scores(df, ["x"], ["kind"], "price", trees=3, depth=3).count() == 2


def test_chi_square_has_no_limit_on_values(spark):
    df = spark.range(24_000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 12_000).alias("x"))
    row = S.chi_square(df, ["x"], "label").first()
    assert row["statistic"] == pytest.approx(24_000) and row["degrees_of_freedom"] == 11_999


def test_combine_scores_handles_undefined_values(spark):
    df = spark.createDataFrame([("a", float("nan"), -1.0), ("b", 2.0, -2.0), ("c", None, -3.0), ("d", 1.0, -4.0)],
                               "feature string, s double, t double")
    got = S.combine_scores(df, ["s", "t"]).orderBy("rank").collect()
    assert [(r["feature"], r["combined_score"]) for r in got] == [("b", 0.5), ("d", 0.25), ("a", 0.0), ("c", 0.0)]


def test_held_caches_spreads_and_releases(parts):
    one = parts["test"].coalesce(1)
    with M.held(one) as (cached,):
        assert cached.is_cached
    assert not cached.is_cached
    with M.held(one, spread_by=["k"]) as (spread,):
        used = spread.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used > 1 and spread.count() == one.count()


def test_features_are_fitted_once_for_all_models(spark, monkeypatch):
    calls = []
    stages = M.feature_stages
    monkeypatch.setattr(M, "feature_stages", lambda *a, **k: (calls.append(a), stages(*a, **k))[1])
    rows = spark.range(400).selectExpr("id", "cast(id % 13 as double) x", "if(id % 7 = 0, null, cast(id % 5 as double)) y", "if(id % 3 = 0, 'a', 'b') kind",
                                       "1.0 + id % 13 + id % 5 as price", "1.0 + id % 2 as w")
    specs = M.regressor_specs("price", lr_iter=5, trees=3, forest_depth=3, boost_iter=3, boost_depth=2)
    specs[0].estimator.setWeightCol("w")
    result = M.compare_regressors(rows, rows, ["x", "y"], ["kind"], "price", specs, spread_by=["id"])
    assert len(calls) == 1  # before: one of each model
    whole = {r["model"]: r["rmse"] for r in result.metrics.collect()}
    for spec in specs:  # the models take raw rows, and are those of a pipeline fitted as a whole
        with M.held(rows, spread_by=["id"]) as (cached,):
            again = M.fit_spec(spec, cached, ["x", "y"], ["kind"], impute=True)
        for model in (result.models[spec.name], again):
            assert M.regression_metrics(model.transform(rows), "price").first()["rmse"] == pytest.approx(whole[spec.name], rel=1e-9)
        assert [type(s) for s in again.stages] == [type(s) for s in result.models[spec.name].stages]
    rolled = M.importance_rollup(result.models["Linear Regression"], rows, ["x", "y"], ["kind"])
    assert {r["feature"] for r in rolled.collect()} == {"x", "y", "kind"}
