"""Read the raw table by its declared types, quarantine what does not fit; shape, required columns, missing values, distributions."""

from common import arguments, save_report, start

from outcomelens.functions import outcome_group
from outcomelens.operators import profiling as P
from outcomelens.operators.progress import Progress
from outcomelens.plans.loans import INCOME_ORDER, NEGATIVE, OUTCOME_NAMES, POSITIVE, STATUS, TARGET
from outcomelens.sources import write_parquet
from outcomelens.sources.declared import account_rows, field_accounts, read_csv_declared, split_bad


def main():
    args = arguments(__doc__, "csv", "table", "reports", quarantine="")
    spark, preset = start(args, "check-table")
    # parse the text once; every later job reads the columns it needs from Parquet. The accounts are taken from the same pass
    declared, progress = preset.declared(), Progress(spark)
    read = read_csv_declared(progress.session, args.csv, declared)
    kept, bad = split_bad(progress.watch(read, "read", *field_accounts(read, declared)[1:]))
    write_parquet(progress.watch(kept, "kept"), args.table)
    facts = spark.createDataFrame([progress.facts("read")])
    save_report(account_rows(read, declared, facts), args.reports, "fields")
    save_report(progress.table().filter("metric IN ('rows', 'bad_rows', 'bad_records')"), args.reports, "progress")
    if progress.facts("read").get("bad_rows"):
        write_parquet(split_bad(read)[1], args.quarantine or f"{args.table.rstrip('/')}-quarantine")
    df = spark.read.parquet(args.table)
    outcomes = P.distribution(df, outcome_group(STATUS, NEGATIVE, POSITIVE, OUTCOME_NAMES), "outcome_group", True)
    for name, report in {
        "shape": P.shape(df),
        "required_columns": P.required_column_report(df, [STATUS, TARGET]),
        "missing": P.missing_summary(df).orderBy("missing_percent", ascending=False),
        "missing_top": P.missing_top(df, 15),
        "outcomes": outcomes.orderBy("n", ascending=False),
        "statuses": P.distribution(df, STATUS, STATUS).orderBy("n", ascending=False),
        "incomes": P.ordinal_distribution(df, "IncomeRange", INCOME_ORDER),
        "scores": P.nulls_last_distribution(df, preset.score),
        "price_histogram": P.histogram(df, TARGET, 40),
    }.items():
        save_report(report, args.reports, name)
    spark.stop()


if __name__ == "__main__":
    main()
