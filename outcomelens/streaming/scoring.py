"""Decode JSON messages, score them with a stored pipeline, write micro-batches that can be replayed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .stopping import OrderlyStop

CORRUPT = "_corrupt"


def parse(messages: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """(value, data, valid) of ``value`` messages.

    A message is invalid if it is null, not an object of this schema, has a field of the wrong type, fills none of the
    fields, or lacks a ``required`` one. Unknown fields are ignored, other missing fields are null.
    """
    tagged = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # the explode of one element keeps filters on the parsed fields from parsing the text again
    parsed = messages.select("value", F.explode(F.array(F.from_json("value", tagged, options))).alias("data"))
    filled = [F.col("data").getField(f.name).isNotNull() for f in schema.fields]
    needed = [F.col("data").getField(name).isNotNull() for name in required]
    valid = F.col("data").isNotNull() & F.col(f"data.{CORRUPT}").isNull() & reduce(or_, filled)
    valid = reduce(and_, needed, valid)
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def split_valid(parsed: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined messages) of a ``parse`` result."""
    fields = [F.col("data").getField(f.name).alias(f.name) for f in schema.fields]
    return parsed.filter("valid").select(*fields), parsed.filter("NOT valid").select("value")


def decode(messages: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split ``value`` messages into (records, quarantine)."""
    return split_valid(parse(messages, schema, required), schema)


def score(
    records: DataFrame, model: PipelineModel, names: tuple[str, str] = ("Good", "Bad"), with_time: bool = True
) -> DataFrame:
    """The input columns plus prediction, both class probabilities, the label text and the scoring time.

    Used for batches and streams alike; no intermediate model column is left in the output.
    """
    probability = vector_to_array("probability")
    return model.transform(records).select(
        *records.columns,
        "prediction",
        probability[1].alias("bad_probability"),
        probability[0].alias("good_probability"),
        F.when(F.col("prediction") == 1.0, names[1]).otherwise(names[0]).alias("prediction_label"),
        *([F.current_timestamp().alias("prediction_time")] if with_time else []),
    )


def commit_log(out: str) -> str:
    """Folder of the commit markers; its leading underscore hides it from scans of ``out``."""
    return f"{out.rstrip('/')}/_commits"


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(run, batch_id, scored, rejected): the batches of which both outputs are whole."""
    try:
        return spark.read.schema("scored long, rejected long, run string, batch_id long").parquet(commit_log(out))
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], "scored long, rejected long, run string, batch_id long")


def read_committed(spark: SparkSession, out: str, folder: str | None = None) -> DataFrame:
    """Rows of ``out`` (or of ``folder``, the quarantine beside it) that belong to committed batches. A batch shows in both or in neither."""
    rows = spark.read.parquet(folder or out)
    rows = rows.withColumns({"run": F.col("run").cast("string"), "batch_id": F.col("batch_id").cast("long")})
    return rows.join(committed(spark, out).select("run", "batch_id"), ["run", "batch_id"], "left_semi").select(rows.columns)


def write_batch(
    schema: T.StructType, model: PipelineModel, out: str, quarantine: str, required: Sequence[str] = (),
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function. Each batch owns ``run=<query id>/batch_id=<n>`` of both folders, so writing it again replaces it.

    The query id belongs to the checkpoint and survives restarts from it. Batch numbers restart with a new checkpoint, whose
    batches go to another ``run`` of the same folders. A marker with the row counts of both is written last: ``read_committed``
    shows a batch only with it. A batch that has its marker is not written again when it is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        if not committed(spark, out).where((F.col("run") == run) & (F.col("batch_id") == batch_id)).isEmpty():
            return
        # parsed once for both outputs: plain columns, far cheaper to keep than a record, and the text of what goes to the quarantine only
        fields = [F.col("data").getField(f.name).alias(f"_f{i}") for i, f in enumerate(schema.fields)]
        batch = parse(batch, schema, required).select("valid", F.when(~F.col("valid"), F.col("value")).alias("value"), *fields).persist()
        try:
            if batch.isEmpty():
                return
            place = f"run={run}/batch_id={batch_id}"
            records = batch.filter("valid").select(*[F.col(f"_f{i}").alias(f.name) for i, f in enumerate(schema.fields)])
            rejected = batch.filter("NOT valid").select("value")
            score(records, model).write.mode("overwrite").parquet(f"{out}/{place}")
            rejected.write.mode("overwrite").parquet(f"{quarantine}/{place}")
            counts = [tuple(spark.read.parquet(f"{folder}/{place}").count() for folder in (out, quarantine))]  # from the files' footers
            marker = spark.createDataFrame(counts, "scored long, rejected long").coalesce(1)
            marker.write.mode("overwrite").parquet(f"{commit_log(out)}/{place}")
        finally:
            batch.unpersist()

    return write


def score_stream(
    stream: DataFrame, schema: T.StructType, model: PipelineModel, out: str, quarantine: str, checkpoint: str,
    required: Sequence[str] = (), every: str | None = "5 seconds", stop: OrderlyStop | None = None,
) -> StreamingQuery:
    """Start scoring; ``every=None`` processes what is there and stops. With ``stop`` the query ends between two batches."""
    write = write_batch(schema, model, out, quarantine, required)
    if stop:
        stream.sparkSession.streams.addListener(stop)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(stop.between(write) if stop else write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
