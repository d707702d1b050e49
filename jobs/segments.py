"""Write every segment report of the raw table."""

from common import arguments, save_report, start


def main():
    args = arguments(__doc__, "table", "reports")
    spark, preset = start(args, "segments")
    for name, report in preset.reports(spark.read.parquet(args.table)).items():
        save_report(report, args.reports, name)
    spark.stop()


if __name__ == "__main__":
    main()
