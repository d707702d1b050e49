"""Score a message stream with the saved classifier until stopped (or, with --every "", until the input is used up).

A file at --stop-file, or an interrupt, ends it after the running batch; a restart goes on with the next one.
"""

from common import arguments, start

from outcomelens.operators.modeling import load_model
from outcomelens.sources import read_message_stream
from outcomelens.streaming import OrderlyStop, file_mark, score_stream


def main():
    args = arguments(
        __doc__, "schema-from", "model", "out", "quarantine", "checkpoint", format="kafka", path="", servers="", topic="",
        per_trigger="", every="5 seconds", stop_file="")
    spark, _ = start(args, "score-stream")
    if args.format == "kafka":
        options = {"kafka.bootstrap.servers": args.servers, "subscribe": args.topic}
        pace = "maxOffsetsPerTrigger"
    else:
        options, pace = {}, "maxFilesPerTrigger"
    if args.per_trigger:
        options[pace] = args.per_trigger
    stream = read_message_stream(spark, args.format, args.path or None, **options)
    schema = spark.read.parquet(args.schema_from).schema  # declared by the model input, not guessed from a JSON sample
    stop = OrderlyStop(file_mark(spark, args.stop_file)) if args.stop_file else OrderlyStop()
    query = score_stream(
        stream, schema, load_model(args.model), args.out, args.quarantine, args.checkpoint, every=args.every or None, stop=stop)
    try:
        stop.wait(query)
    except KeyboardInterrupt:
        stop.ask()
        stop.wait(query)
    spark.stop()


if __name__ == "__main__":
    main()
