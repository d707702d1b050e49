"""Model pipelines: build, compare, pick, store, explain."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import best_model, confusion, exact_auc, regression_metrics, threshold_metrics, with_mean_baseline

SEED = 42
INDEX, ONEHOT, FILLED = "__index", "__onehot", "__filled"
ASSEMBLED = "assembled"
# Names of the models, here and in the specs below, whose settings are fixed defaults too.
BASELINE = "Baseline Mean Predictor"


@dataclass(frozen=True)
class Spec:
    """One model to compare: its name, its estimator on ``features``, and whether features are scaled."""

    name: str
    estimator: Estimator
    scale: bool = False


def classifier_specs(
    label: str = "label", weight: str | None = "class_weight", lr_iter: int = 60, trees: int = 100,
    forest_depth: int = 6, boost_iter: int = 50, boost_depth: int = 5, seed: int = SEED,
) -> list[Spec]:
    common = {"labelCol": label, "featuresCol": "features", **({"weightCol": weight} if weight else {})}
    return [
        Spec("Logistic Regression", LogisticRegression(maxIter=lr_iter, **common), scale=True),
        Spec("Random Forest", RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=seed, **common)),
        Spec("GBTClassifier", GBTClassifier(maxIter=boost_iter, maxDepth=boost_depth, seed=seed, **common)),
    ]


def regressor_specs(
    target: str, lr_iter: int = 60, reg: float = 0.01, trees: int = 100, forest_depth: int = 8, boost_iter: int = 60,
    boost_depth: int = 5, step: float = 0.05, seed: int = SEED,
) -> list[Spec]:
    common = {"labelCol": target, "featuresCol": "features"}
    return [
        Spec("Linear Regression", LinearRegression(maxIter=lr_iter, regParam=reg, **common), scale=True),
        Spec("Random Forest Regressor", RandomForestRegressor(
            numTrees=trees, maxDepth=forest_depth, seed=seed, **common)),
        Spec("GBTRegressor", GBTRegressor(
            maxIter=boost_iter, maxDepth=boost_depth, stepSize=step, seed=seed, **common)),
    ]


def feature_stages(
    numeric: Sequence[str], categorical: Sequence[str], scale: bool = False, impute: bool = False
) -> list:
    """Index and one-hot the categories, optionally mean-fill the numbers, assemble, optionally scale.

    Each kind is one multi-column stage, so fitting costs one job per kind and not per column.
    """
    stages, inputs = [], []
    if categorical:
        indexed, onehot = [c + INDEX for c in categorical], [c + ONEHOT for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=onehot, handleInvalid="keep"))
        inputs += onehot
    if numeric and impute:
        filled = [c + FILLED for c in numeric]
        stages.append(Imputer(inputCols=list(numeric), outputCols=filled))
        inputs += filled
    else:
        inputs += list(numeric)
    if scale:
        stages.append(VectorAssembler(inputCols=inputs, outputCol=ASSEMBLED, handleInvalid="keep"))
        stages.append(StandardScaler(inputCol=ASSEMBLED, outputCol="features", withStd=True, withMean=False))
    else:
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


@contextmanager
def held(*frames: DataFrame, spread_by: Sequence[str] = (), columns: Sequence[str] = ()):
    """Frames cached (memory, then disk) while a fit or an evaluation passes over them.

    ``spread_by`` names key columns to lay the rows out evenly first. It costs one shuffle and pays when the input has
    few or uneven partitions; it also takes the layout of the input out of what a forest learns. ``columns``: only these are kept.
    """
    laid = [df.repartition(*spread_by) if spread_by else df for df in frames]
    cached = [(df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK) for df in laid]
    try:
        yield cached
    finally:
        for df in cached:
            df.unpersist()


def fit_spec(
    spec: Spec, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], impute: bool = False
) -> PipelineModel:
    stages = feature_stages(numeric, categorical, spec.scale, impute)
    return Pipeline(stages=[*stages, spec.estimator]).fit(train)


def weight_columns(specs: Sequence[Spec]) -> list[str]:
    return sorted({spec.estimator.getWeightCol() for spec in specs if spec.estimator.hasParam("weightCol") and spec.estimator.isSet("weightCol")})


class Prepared:
    """Feature stages fitted once for several specs, and frames of ready vectors, so that the passes of the fits do not assemble them again."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], impute: bool = False):
        *stages, self._assembler = feature_stages(numeric, categorical, impute=impute)
        self._stages = Pipeline(stages=stages).fit(train).stages
        self._assembler = self._assembler.setOutputCol(ASSEMBLED)

    def vectors(self, df: DataFrame, *columns: str) -> DataFrame:
        return PipelineModel([*self._stages, self._assembler]).transform(df).select(*columns, ASSEMBLED)

    def fit(self, spec: Spec, train: DataFrame) -> PipelineModel:
        """The pipeline that ``fit_spec`` would give, fitted on ``vectors`` of its train rows."""
        if spec.scale:
            scaler = StandardScaler(inputCol=ASSEMBLED, outputCol="features", withStd=True, withMean=False).fit(train)
            return PipelineModel([*self._stages, self._assembler, scaler, spec.estimator.fit(scaler.transform(train))])
        assembler = self._assembler.copy({self._assembler.outputCol: "features"})
        return PipelineModel([*self._stages, assembler, spec.estimator.fit(train.withColumnRenamed(ASSEMBLED, "features"))])

    def score(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        """What ``model`` of this says about ``vectors``."""
        after = model.stages[len(self._stages) + 1:]
        return PipelineModel(after).transform(df if len(after) > 1 else df.withColumnRenamed(ASSEMBLED, "features"))


@dataclass
class Comparison:
    metrics: DataFrame
    models: dict[str, PipelineModel]
    best_name: str

    @property
    def best(self) -> PipelineModel:
        return self.models[self.best_name]

    def save_best(self, path: str) -> None:
        self.best.write().overwrite().save(path)


def compare_classifiers(
    train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], specs: Sequence[Spec],
    label: str = "label", spread_by: Sequence[str] = (),
) -> Comparison:
    """Fit every spec on train and measure it on test; best is the highest PR-AUC.

    All threshold metrics come from one confusion aggregate, the areas from every distinct score.
    """
    rows, models = [], {}
    weights = weight_columns(specs)
    kept = list(dict.fromkeys([*numeric, *categorical, label]))
    with held(train, spread_by=spread_by, columns=[*kept, *weights]) as (train,), held(test, spread_by=spread_by, columns=kept) as (test,):
        prepared = Prepared(train, numeric, categorical)
        with held(prepared.vectors(train, label, *weights), prepared.vectors(test, label)) as (ready, unseen):
            for spec in specs:
                model = prepared.fit(spec, ready)
                with held(prepared.score(model, unseen).select(label, "prediction", "rawPrediction")) as (scored,):
                    row = threshold_metrics(confusion(scored, label)).first().asDict()
                    row |= exact_auc(scored, label, vector_to_array("rawPrediction")[1]).first().asDict()
                models[spec.name] = model
                rows.append({"model": spec.name, **row})
    metrics = train.sparkSession.createDataFrame(rows).select(
        "model", "accuracy", "f1", "weighted_precision", "weighted_recall", "roc_auc", "pr_auc", "bad_precision",
        "bad_recall", "tn", "fp", "fn", "tp")
    return Comparison(metrics, models, pick_classifier(metrics).first()["model"])


def pick_classifier(metrics: DataFrame) -> DataFrame:
    return best_model(metrics, [F.desc("pr_auc")])


def compare_regressors(
    train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
    specs: Sequence[Spec], spread_by: Sequence[str] = (),
) -> Comparison:
    """Fit every spec, add the mean baseline; best is the lowest rmse, then mae, then the highest r2."""
    weights = weight_columns(specs)
    kept = list(dict.fromkeys([*numeric, *categorical, target]))
    with held(train, spread_by=spread_by, columns=[*kept, *weights]) as (train,), held(test, spread_by=spread_by, columns=kept) as (test,):
        guessed = with_mean_baseline(train, test, target)
        base = regression_metrics(guessed, target).withColumn("baseline_mean", guessed.agg(F.first("prediction").alias("m")).scalar())
        rows, models = [{"model": BASELINE, **base.first().asDict()}], {}
        prepared = Prepared(train, numeric, categorical, impute=True)
        with held(prepared.vectors(train, target, *weights), prepared.vectors(test, target)) as (ready, unseen):
            for spec in specs:
                model = prepared.fit(spec, ready)
                rows.append({"model": spec.name, **regression_metrics(prepared.score(model, unseen), target).first().asDict()})
                models[spec.name] = model
    metrics = train.sparkSession.createDataFrame(
        [(r["model"], r["rmse"], r["mae"], r["r2"], r["mape"], r["n"], r["zero_targets"], r.get("baseline_mean")) for r in rows],
        "model string, rmse double, mae double, r2 double, mape double, n long, zero_targets long, baseline_mean double")
    return Comparison(metrics, models, pick_regressor(metrics).first()["model"])


def pick_regressor(metrics: DataFrame) -> DataFrame:
    return best_model(metrics, [F.asc("rmse"), F.asc("mae"), F.desc("r2")], exclude=[BASELINE])


def importance_rollup(
    model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """(feature, feature_type, importance, importance_pct, rank): slot importances summed per source column.

    Trees give their importances, linear models the absolute coefficients. Slot names are read from the assembler's
    output, which keeps them also when a scaler follows.
    """
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    meta = model.transform(df.limit(0)).schema[assembler.getOutputCol()].metadata["ml_attr"]["attrs"]
    sources = {c + ONEHOT + "_": c for c in categorical} | {c + FILLED: c for c in numeric}

    def source(slot: str) -> str:
        return next((c for mark, c in sources.items() if slot.startswith(mark)), slot)

    values = weights.toArray()
    rows = [(source(a["name"]), abs(float(values[a["idx"]]))) for kind in meta.values() for a in kind]
    slots = df.sparkSession.createDataFrame(rows, "feature string, weight double")
    per_feature = slots.groupBy("feature").agg(F.sum("weight").alias("importance"))
    everything = Window.partitionBy()  # one row per source column
    return per_feature.select(
        "feature",
        F.when(F.col("feature").isin(*numeric), "numeric").otherwise("categorical").alias("feature_type"),
        F.round("importance", 8).alias("importance"),
        F.round(F.try_divide(F.col("importance"), F.sum("importance").over(everything)) * 100, 4)
        .alias("importance_pct"),
        F.row_number().over(everything.orderBy(F.desc("importance"), "feature")).cast("long").alias("rank"),
    )


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
