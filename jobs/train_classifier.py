"""Score features, compare classifiers, save the best, write its reports and the stream sample."""

from common import arguments, save_report, start

from outcomelens.operators import modeling, scoring
from outcomelens.operators.evaluation import confusion
from outcomelens.operators.preparation import Preparer
from outcomelens.operators.profiling import distribution
from outcomelens.operators.splitting import ClassWeights
from outcomelens.plans.loans import TARGET
from outcomelens.sources import write_json, write_parquet


def main():
    args = arguments(
        __doc__, "classification", "model", "stream", "reports", lr_iter=60, trees=100, forest_depth=6, boost_iter=50,
        boost_depth=5, score_trees=80)
    spark, preset = start(args, "train-classifier")
    parts = {p: spark.read.parquet(f"{args.classification}/part={p}") for p in ("train", "test", "stream")}
    train = ClassWeights.fit(parts["train"]).transform(parts["train"])
    types = Preparer(preset.column_groups(), preset.date_parts, preset.day_spans).features(train, more=[TARGET])
    spread = sorted(parts["train"].columns)  # rows are distinct: their layout, and so what a forest learns, does not hang on the files
    save_report(distribution(parts["train"], "label", "label", with_percent=True), args.reports, "label_distribution")
    save_report(
        scoring.classification_scores(
            train, types.numeric, types.categorical, trees=args.score_trees, spread_by=spread).orderBy("rank"),
        args.reports, "feature_scores")
    specs = modeling.classifier_specs(
        lr_iter=args.lr_iter, trees=args.trees, forest_depth=args.forest_depth, boost_iter=args.boost_iter,
        boost_depth=args.boost_depth)
    result = modeling.compare_classifiers(train, parts["test"], types.numeric, types.categorical, specs, spread_by=spread)
    result.save_best(args.model)
    save_report(result.metrics.orderBy("pr_auc", ascending=False), args.reports, "metrics")
    save_report(modeling.pick_classifier(result.metrics), args.reports, "best_model")
    save_report(confusion(result.best.transform(parts["test"])), args.reports, "confusion")
    sample = parts["stream"].drop("label")
    write_parquet(sample, f"{args.stream}/parquet")
    write_json(sample, f"{args.stream}/json")
    spark.stop()


if __name__ == "__main__":
    main()
