"""Message and stream queries over the test tables, on files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import publish, read_json, read_message_stream, to_messages, write_json
from ..streaming import parse, score, score_stream
from .models import CATEGORICAL, NUMERIC, _weighted, forest, learnable
from .registry import query
from .tables import ROW_KEY, Tables

KEYS = ", ".join(ROW_KEY)
MESSAGE = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType()),
])


@query("json_publish", """
    SELECT CAST(to_json(struct_pack(l_orderkey := l_orderkey, l_partkey := l_partkey, l_linenumber := l_linenumber,
        l_returnflag := l_returnflag)) AS VARCHAR) AS value FROM lineitem""")
def json_publish(t: Tables):
    path = scratch_path(t.spark, "messages")
    publish(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "text", path)
    return t.spark.read.text(path)


@query("json_roundtrip", f"SELECT {KEYS}, l_quantity, l_discount, l_returnflag FROM lineitem")
def json_roundtrip(t: Tables):
    path = scratch_path(t.spark, "json")
    rows = t.lineitem.select(*ROW_KEY, "l_quantity", "l_discount", "l_returnflag")
    write_json(rows, path)
    return read_json(t.spark, path, rows.schema)


def damaged_messages(t: Tables) -> DataFrame:
    """One message per record; line 7 is cut short, line 6 has text for a number, line 5 is no object at all."""
    whole = F.col("value")
    line = F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    message = rows.select("l_linenumber", F.to_json(F.struct("*")).alias("value"))
    return message.select(
        F.when(line == 7, F.expr("substr(value, 1, length(value) - 5)"))
        .when(line == 6, F.regexp_replace(whole, '"l_quantity":[0-9.]+', '"l_quantity":"many"'))
        .when(line == 5, F.lit("not json")).otherwise(whole).alias("value"))


@query("json_parse", """
    SELECT CASE WHEN l_linenumber >= 5 THEN 'quarantined' ELSE 'decoded' END AS status, count(*) AS n,
        CAST(sum(CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS quantity,
        count(DISTINCT CASE WHEN l_linenumber < 5 THEN l_returnflag END) AS flags FROM lineitem GROUP BY 1""")
def json_parse(t: Tables):
    data, valid = F.col("data"), F.col("valid")
    return parse(damaged_messages(t), MESSAGE).groupBy(
        F.when(valid, "decoded").otherwise("quarantined").alias("status")
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.when(valid, data["l_quantity"]).cast("long")).alias("quantity"),
        F.count_distinct(F.when(valid, data["l_returnflag"])).alias("flags"),
    )


@query("event_props", """
    SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def event_props(t: Tables):
    return t.read("events").select(
        "event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


INPUT = [*ROW_KEY, *NUMERIC, *CATEGORICAL]


def run_stream(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publish every record, line 7 damaged, and score the messages as a stream: (scored, quarantined, batch scores)."""
    train, _ = _weighted(t)
    model = forest(train)
    records = learnable(t).select(*INPUT)
    source = scratch_path(t.spark, "topic")
    broken = F.col("l_linenumber") == 7
    messages = to_messages(records.filter(~broken)).unionByName(
        to_messages(records.filter(broken)).select(F.expr("substr(value, 1, length(value) - 8)").alias("value")))
    messages.write.text(source)
    out, rejected = scratch_path(t.spark, "scored"), scratch_path(t.spark, "rejected")
    stream = read_message_stream(t.spark, "text", source, maxFilesPerTrigger=100)
    done = score_stream(
        stream, records.schema, model, out, rejected, scratch_path(t.spark, "offsets"), required=["l_orderkey"],
        every=None)
    done.awaitTermination()
    return t.spark.read.parquet(out), t.spark.read.parquet(rejected), score(records.filter(~broken), model)


@query("stream_score", """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, TRUE AS sums_to_one, TRUE AS label_agrees,
        TRUE AS timed FROM lineitem WHERE l_linenumber <> 7""")
def stream_score(t: Tables):
    """Every scored row with what must hold of its scores."""
    scored, _, _ = run_stream(t)
    bad, good = F.col("bad_probability"), F.col("good_probability")
    return scored.select(
        *[F.col(c).cast("long").alias(c) for c in ROW_KEY], (F.abs(bad + good - 1) < 1e-9).alias("sums_to_one"),
        ((F.col("prediction_label") == "Bad") == (F.col("prediction") == 1)).alias("label_agrees"),
        F.col("prediction_time").isNotNull().alias("timed"))


PARITY_SQL = """
    SELECT count(*) FILTER (WHERE l_linenumber <> 7) AS scored, count(*) FILTER (WHERE l_linenumber = 7) AS quarantined,
        CAST(0 AS BIGINT) AS different FROM lineitem"""


@query("stream_batch_parity", PARITY_SQL)
def stream_batch_parity(t: Tables):
    scored, rejected, batch = run_stream(t)
    columns = [*ROW_KEY, "prediction", "bad_probability", "good_probability", "prediction_label"]
    both = scored.select(*columns, F.lit(1).alias("side")).unionByName(batch.select(*columns, F.lit(-1).alias("side")))
    unequal = both.groupBy(*columns).agg(F.sum("side").alias("d")).agg(
        F.coalesce(F.sum(F.abs("d")), F.lit(0)).cast("long").alias("different"))
    counts = scored.agg(F.count("*").alias("scored"))
    return counts.withColumns({
        "quarantined": rejected.agg(F.count("*").alias("n")).scalar(), "different": unequal.scalar()})
