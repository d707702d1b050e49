"""Drop the domain groups, then the sparse, hand-picked and redundant columns; write the table and both ledgers."""

from common import arguments, save_report, start

from outcomelens.config import feature_types
from outcomelens.operators.correlation import corr_pairs, corr_with_target, high_pairs
from outcomelens.operators.progress import Progress
from outcomelens.operators.reduction import Reduction, drop_present, reduction_ledger, removal_ledger
from outcomelens.plans.loans import STATUS, TARGET
from outcomelens.sources import write_parquet


def main():
    args = arguments(__doc__, "table", "reduced", "reports", sparse=80.0, corr=0.85)
    spark, preset = start(args, "reduce")
    progress = Progress(spark)
    raw = progress.session.read.parquet(args.table)
    groups = preset.drop_groups()
    save_report(reduction_ledger(raw, groups), args.reports, "domain_ledger")
    domain, _, _ = drop_present(raw, [c for g in groups for c in g.columns])

    numeric = feature_types(domain).numeric
    ledger = removal_ledger(
        domain, numeric, TARGET, preset.manual_reasons(), protect=[STATUS], sparse_threshold=args.sparse,
        corr_threshold=args.corr)
    reduction = Reduction.fit(ledger)
    reduced = reduction.transform(domain)
    write_parquet(progress.watch(reduced, "reduced"), args.reduced)
    columns = [(0, "raw", "columns", len(raw.columns)), (0, "domain", "columns", len(domain.columns)), (0, "reduced", "columns", len(reduced.columns))]
    save_report(progress.table().union(spark.createDataFrame(columns, progress.table().schema)), args.reports, "progress")
    kept = feature_types(reduced).numeric
    save_report(ledger, args.reports, "removal_ledger")
    save_report(corr_with_target(domain, kept, TARGET), args.reports, "correlation_with_target")
    save_report(high_pairs(corr_pairs(domain, kept, TARGET), args.corr), args.reports, "high_correlation_pairs")
    spark.stop()


if __name__ == "__main__":
    main()
