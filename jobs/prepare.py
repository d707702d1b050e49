"""Deduplicate, split by record key, prepare with medians of the train part, write both modelling sets by part."""

from common import arguments, save_report, start
from pyspark.sql import functions as F

from outcomelens.operators.preparation import Preparer, dedup_rows, label_set, target_set
from outcomelens.operators.profiling import missing_summary, target_summary
from outcomelens.operators.progress import Progress
from outcomelens.operators.splitting import split_name
from outcomelens.plans.loans import NEGATIVE, POSITIVE, STATUS, TARGET
from outcomelens.session import scratch_path


def main():
    args = arguments(
        __doc__, "reduced", "classification", "regression", "reports", keep_price=0, impute_target=0)
    spark, preset = start(args, "prepare")
    progress = Progress(spark)
    reduced = progress.session.read.parquet(args.reduced)
    distinct = scratch_path(spark, "distinct")  # every pass below reads its columns of the result of the one shuffle
    progress.watch(dedup_rows(progress.watch(reduced, "read")), "distinct").write.parquet(distinct)
    rows = progress.session.read.parquet(distinct)
    counted = [(progress.facts("read")["rows"], progress.facts("distinct")["rows"])]
    save_report(spark.createDataFrame(counted, "rows_before long, rows_after long"), args.reports, "duplicates")
    save_report(missing_summary(rows), args.reports, "missing")
    # without an identifier the whole row is the key; parts are fixed before anything is learnt
    key = sorted(rows.columns)
    shares = {"classification": {"train": 7, "test": 2, "stream": 1}, "regression": {"train": 8, "test": 2}}
    for task, path in (("classification", args.classification), ("regression", args.regression)):
        tagged = rows.withColumn("part", split_name(key, shares[task], salt=task))
        preparer = Preparer(
            preset.column_groups(), preset.date_parts, preset.day_spans, impute_target=bool(args.impute_target))
        prepared = preparer.fit(tagged.filter("part = 'train'")).transform(tagged)
        if task == "classification":
            ready = label_set(prepared, STATUS, NEGATIVE, POSITIVE, exclude=[] if args.keep_price else [TARGET])
        else:
            ready = target_set(prepared, TARGET, STATUS)
            save_report(target_summary(ready.drop("part"), TARGET), args.reports, "target_summary")
        parts = [F.count_if(F.col("part") == part).alias(part) for part in shares[task]]
        progress.watch(ready, task, *parts).write.mode("overwrite").partitionBy("part").parquet(path)
    save_report(progress.table(), args.reports, "progress")
    spark.stop()


if __name__ == "__main__":
    main()
