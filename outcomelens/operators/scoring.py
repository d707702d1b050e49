"""Feature scores: chi-square, forest importance, target correlation; normalised, combined and ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlation import corr_with_target
from .modeling import held
from .ordering import quantile_table

SEED = 42
LEAST_BINS = 32


def discrete_columns(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, buckets: int = 5
) -> DataFrame:
    """``label`` and one column per feature: numbers as exact quantile buckets (from 0; a missing value has a bucket of its
    own, -1), categories as text. All numeric columns share one ordering.
    """
    splits = {}
    if numeric:
        shares = [i / buckets for i in range(1, buckets)]
        splits = {r["column"]: sorted(set(r["values"])) for r in quantile_table(df, numeric, shares).collect()}  # a row per column

    def bucket(c: str) -> Column:
        value = F.col(c).cast("double")
        steps = [F.when(value >= F.lit(float(x)), 1).otherwise(0) for x in splits.get(c, [])]
        return F.when(value.isNull() | F.isnan(value), -1).otherwise(sum(steps, F.lit(0))).cast("int").alias(c)

    return df.select(label, *map(bucket, numeric), *[F.col(c).cast("string").alias(c) for c in categorical])


def chi_square(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, statistic, degrees_of_freedom) of each discrete column against the label, null being a value.

    One grouped count over (feature, value, label), merged before the shuffle; any number of values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    cells = df.select(F.col(label).alias("_y"), pairs.alias("_p")).groupBy("_p.feature", "_p.value", "_y").agg(F.count("*").alias("o"))
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"), F.collect_list(F.struct("_y", "o")).alias("cells"))  # a label each
    by_label = cells.groupBy("feature", "_y").agg(F.sum("o").alias("c"))
    margins = by_label.groupBy("feature").agg(F.sum("c").alias("n"), F.count("*").alias("labels"))
    margin = by_label.select(F.col("feature").alias("_f"), F.col("_y").alias("_z"), "c")
    same = (F.col("feature") == F.col("_f")) & F.col("_y").eqNullSafe(F.col("_z"))
    cell = rows.select("feature", "r", F.inline("cells")).join(margin, same)
    sums = cell.groupBy("feature").agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c").cast("double"))).alias("s"))
    values = rows.groupBy("feature").agg(F.count("*").alias("values"))
    return sums.join(margins, "feature").join(values, "feature").select(
        "feature", (F.col("n") * (F.col("s") - 1)).alias("statistic"),
        ((F.col("values") - 1) * (F.col("labels") - 1)).alias("degrees_of_freedom"))


def forest_importance(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, regression: bool = False, trees: int = 80,
    depth: int = 6, seed: int = SEED,
) -> DataFrame:
    """(feature, importance) of a random forest, one slot per feature. Trees get as many bins as the largest category has values."""
    features, stages, bins = [*numeric, *categorical], [], LEAST_BINS
    if categorical:
        indexer = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep").fit(df)
        bins = max(bins, *(len(labels) + 1 for labels in indexer.labelsArray))
        stages.append(indexer)
    inputs = [*numeric, *[f"{c}__index" for c in categorical]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    vectors = PipelineModel(stages).transform(df).select(label, "features")
    forest = RandomForestRegressor if regression else RandomForestClassifier
    model = forest(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, maxBins=bins).fit(vectors)
    values = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def max_normalised(score: Column, everything) -> Column:
    """score / max(score); undefined scores count as zero and a maximum of zero or less gives zeros."""
    clean = F.when(F.isnan(score) | score.isNull() | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    top = F.max(clean).over(everything)
    return F.when(top > 0, clean / top).otherwise(0.0)


def combine_scores(
    scores: DataFrame, columns: Sequence[str], weights: Sequence[float] = (0.5, 0.5), top_k: int | None = None,
    digits: int = 8,
) -> DataFrame:
    """Normalise each score column by its maximum, combine them and rank the features.

    ``scores`` has one row per feature, so the unpartitioned window is bounded by the number of columns of the data.
    All features stay selected unless ``top_k`` is given.
    """
    everything = Window.partitionBy()
    normalised = {f"{c}_normalized": max_normalised(F.col(c), everything) for c in columns}
    combined = sum(w * F.col(f"{c}_normalized") for w, c in zip(weights, columns))
    ranked = (
        scores.withColumns(normalised).withColumn("combined_score", combined)
        .withColumn("rank", F.row_number().over(everything.orderBy(F.desc("combined_score"), "feature")).cast("long"))
    )
    rounded = ranked.withColumns({
        c: F.round(c, digits) for c in (*columns, *normalised, "combined_score")
    })
    return rounded.withColumn("selected", F.lit(True) if top_k is None else F.col("rank") <= top_k)


def _typed(scores: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return scores.withColumn(
        "feature_type", F.when(F.col("feature").isin(*numeric), "numeric").otherwise("categorical"))


def classification_scores(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "label", trees: int = 80,
    depth: int = 6, top_k: int | None = None, spread_by: Sequence[str] = (),
) -> DataFrame:
    """Chi-square statistic and forest importance per feature, combined and ranked."""
    features = [*numeric, *categorical]
    with held(train, spread_by=spread_by) as (cached,):
        with held(discrete_columns(cached, numeric, categorical, label)) as (discrete,):
            chi = chi_square(discrete, features, label).select("feature", "statistic").collect()  # one row per column
            forest = forest_importance(discrete, numeric, categorical, label, trees=trees, depth=depth)
    chi = train.sparkSession.createDataFrame(chi, "feature string, chi_square_score double")
    scores = chi.join(forest.withColumnRenamed("importance", "random_forest_importance"), "feature")
    return combine_scores(
        _typed(scores, numeric), ["chi_square_score", "random_forest_importance"], top_k=top_k)


def regression_scores(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, trees: int = 80, depth: int = 6,
    top_k: int | None = None, spread_by: Sequence[str] = (),
) -> DataFrame:
    """Absolute target correlation (numeric only) and forest importance per feature, combined and ranked."""
    with held(train, spread_by=spread_by) as (cached,):
        forest = forest_importance(cached, numeric, categorical, target, regression=True, trees=trees, depth=depth)
    corr = corr_with_target(train, numeric, target).select("feature", F.col("abs_r").alias("absolute_correlation"))
    scores = forest.withColumnRenamed("importance", "random_forest_importance").join(corr, "feature", "left")
    return combine_scores(
        _typed(scores.fillna(0.0, ["absolute_correlation"]), numeric),
        ["absolute_correlation", "random_forest_importance"], top_k=top_k)
