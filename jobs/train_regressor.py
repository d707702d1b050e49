"""Score features, compare price regressors against the mean baseline, save and explain the best."""

from common import arguments, save_report, start
from pyspark.sql import functions as F

from outcomelens.operators import evaluation, modeling, scoring
from outcomelens.operators.preparation import Preparer
from outcomelens.operators.profiling import histogram
from outcomelens.operators.splitting import stable_sample
from outcomelens.plans.loans import APR_ERROR_BANDS, TARGET


def main():
    args = arguments(
        __doc__, "regression", "model", "reports", lr_iter=60, reg=0.01, trees=100, forest_depth=8, boost_iter=60,
        boost_depth=5, step=0.05, score_trees=80)
    spark, preset = start(args, "train-regressor")
    train, test = (spark.read.parquet(f"{args.regression}/part={p}") for p in ("train", "test"))
    types = Preparer(preset.column_groups(), preset.date_parts, preset.day_spans).features(train)
    spread = sorted(train.columns)  # rows are distinct: their layout, and so what a forest learns, does not hang on the files
    save_report(
        scoring.regression_scores(
            train, types.numeric, types.categorical, TARGET, trees=args.score_trees, spread_by=spread).orderBy("rank"),
        args.reports, "feature_scores")
    specs = modeling.regressor_specs(
        TARGET, lr_iter=args.lr_iter, reg=args.reg, trees=args.trees, forest_depth=args.forest_depth,
        boost_iter=args.boost_iter, boost_depth=args.boost_depth, step=args.step)
    result = modeling.compare_regressors(train, test, types.numeric, types.categorical, TARGET, specs, spread_by=spread)
    result.save_best(args.model)
    predicted = result.best.transform(test).select(*test.columns, "prediction")
    with modeling.held(predicted) as (predicted,):
        errors = evaluation.residuals(predicted, TARGET, keep=test.columns)
        for name, report in {
            "metrics": result.metrics,
            "best_model": modeling.pick_regressor(result.metrics),
            "importance": modeling.importance_rollup(result.best, test, types.numeric, types.categorical).orderBy("rank"),
            "error_by_band": evaluation.error_by_band(predicted, TARGET, APR_ERROR_BANDS).orderBy("band"),
            "residual_histogram": histogram(errors, "residual", 50),
            "prediction_sample": stable_sample(errors, test.columns, 200).select(
                *[F.round(c, 6).alias(c) for c in ("actual", "predicted", "absolute_error")]),
        }.items():
            save_report(report, args.reports, name)
    spark.stop()


if __name__ == "__main__":
    main()
