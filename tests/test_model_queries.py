"""The model queries on a made-up table: what they fit, and what their checks say."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier

from outcomelens.operators import modeling, scoring
from outcomelens.plans import QUERIES
from outcomelens.plans import models as P


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Folder of a ``lineitem`` of 600 rows."""
    draw, folder = random.Random(7), str(tmp_path_factory.mktemp("lines"))
    data = [(i // 4, draw.randrange(99), draw.randrange(9), i % 4, float(draw.randint(1, 50)), draw.randint(0, 10) / 100, draw.randint(0, 8) / 100,
             draw.choice("FO"), draw.choice("ANR")) for i in range(600)]
    spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                                "l_linestatus string, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def fitted(monkeypatch, *estimators):
    """The models that ``fit`` of these estimators returns from now on."""
    models = []
    for kind in estimators:
        monkeypatch.setattr(kind, "fit", lambda self, *a, whole=kind.fit, **k: models.append(whole(self, *a, **k)) or models[-1])
    return models


def test_features_are_ranked_by_the_whole_forest(spark, lines, monkeypatch):
    models = fitted(monkeypatch, RandomForestClassifier)
    ranked = QUERIES["feature_rank"](spark, lines).collect()
    assert {r["feature"] for r in ranked if r["rank_follows"]} == {*P.NUMERIC, *P.CATEGORICAL}
    assert [(m.getNumTrees, m.getMaxDepth()) for m in models] == [(80, 6)]  # before: 5 trees, 4 deep
    assert max(t.depth for t in models[0].trees) == 6 and models[0].getSubsamplingRate() == 1.0


def test_ranks_may_follow_differences_in_the_seventh_digit(spark):
    """The two low scores were one when rounded to six digits, and then had to stand by name."""
    scores = spark.createDataFrame([("c", 289.0, 0.998), ("b", 8.1e-5, 1.136e-5), ("a", 2.9e-4, 1.021e-5)], "feature string, s double, random_forest_importance double")
    ranked = scoring.combine_scores(scoring._typed(scores, ["c"]), ["s", "random_forest_importance"])
    assert [r["feature"] for r in ranked.orderBy("rank").collect()] == ["c", "b", "a"]
    assert all(r["rank_follows"] for r in P._sound(ranked, "s", 8).collect())
    swapped = ranked.withColumn("rank", 4 - ranked["rank"])
    assert not all(r["rank_follows"] for r in P._sound(swapped, "s", 8).collect())
    doubled = ranked.withColumn("rank", ranked["rank"] * 2)
    assert not any(r["rank_follows"] for r in P._sound(doubled, "s", 8).collect())


def test_regressors_are_compared_with_their_whole_settings(spark, lines, monkeypatch):
    taken = []

    def compare(train, test, numeric, categorical, target, specs, spread_by=()):
        taken.extend(spec.estimator for spec in specs)
        small = modeling.regressor_specs(target, lr_iter=5, trees=2, forest_depth=2, boost_iter=2, boost_depth=2)
        return whole(train, test, numeric, categorical, target, small, spread_by)

    whole = modeling.compare_regressors
    monkeypatch.setattr(modeling, "compare_regressors", compare)
    found = {r["model"]: r["near_best"] for r in QUERIES["train_regressors"](spark, lines).collect()}
    linear, forest, boosted = taken
    assert (linear.getMaxIter(), linear.getRegParam()) == (60, 0.01)  # before: 15 iterations
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSubsamplingRate()) == (100, 8, 1.0)  # before: 5 trees, 4 deep
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize(), boosted.getSubsamplingRate()) == (60, 5, 0.05, 1.0)  # before: 5, 3, 0.3
    assert not found["Random Forest Regressor"] and not found["GBTRegressor"]  # what was fitted here is small, and the query says so
