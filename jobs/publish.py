"""Publish records as JSON messages to a topic (Kafka) or a folder (text)."""

from common import arguments, start

from outcomelens.sources import publish


def main():
    args = arguments(__doc__, "records", format="kafka", path="", servers="", topic="", limit=0)
    spark, _ = start(args, "publish")
    options = {"kafka.bootstrap.servers": args.servers, "topic": args.topic} if args.format == "kafka" else {}
    publish(spark.read.parquet(args.records), args.format, args.path or None, args.limit or None, **options)
    spark.stop()


if __name__ == "__main__":
    main()
