import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcomelens.operators.modeling import feature_stages
from outcomelens.sources import publish, read_message_stream, to_messages
from outcomelens.streaming import OrderlyStop, committed, decode, file_mark, read_committed, score, score_stream, write_batch

SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("kind", T.StringType())])
GOOD = ['{"k":1,"x":0.5,"kind":"a"}', '{"k":2,"x":0.25}', '{"k":3,"x":1.0,"kind":"b","extra":9}']
BAD = ['{"k":"four","x":1.0}', '{"k":5,"x":', "junk", None, "[1,2]", '{"x":1.0,"kind":"no key"}', "{}", '{"other":1}']


@pytest.fixture(scope="module")
def model(spark):
    train = spark.range(200).select(
        "id", (F.col("id") / 200).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
        (F.col("id") > 90).cast("int").alias("label"))
    return Pipeline(stages=[*feature_stages(["x"], ["kind"]), LogisticRegression(maxIter=10)]).fit(train)


def test_decode_quarantines_everything_unreadable(spark, rows):
    messages = spark.createDataFrame([(m,) for m in GOOD + BAD], "value string")
    records, rejected = decode(messages, SCHEMA, required=["k"])
    empty = decode(messages.filter("value IN ('{}', '{\"other\":1}')"), SCHEMA)
    assert empty[0].count() == 0 and empty[1].count() == 2  # not scored as records of nulls
    assert rows(records) == [(1, 0.5, "a"), (2, 0.25, None), (3, 1.0, "b")]
    assert rows(rejected) == sorted([(m,) for m in BAD], key=repr)


def test_text_is_parsed_once_per_output(spark):
    messages = spark.createDataFrame([(m,) for m in GOOD], "value string")
    records, _ = decode(messages, SCHEMA, required=["k"])
    assert records._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_publish_limit_and_key(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit(0.5).alias("x"))
    publish(df, "text", f"{tmp_path}/m", limit=7)
    assert spark.read.text(f"{tmp_path}/m").count() == 7
    keyed = to_messages(df, key="k").orderBy(F.col("key").cast("int")).first()
    assert (keyed["key"], keyed["value"]) == ("0", '{"k":0,"x":0.5}')


def test_stream_scores_equal_batch_scores(spark, model, rows, tmp_path):
    records = spark.range(100).select(
        F.col("id").alias("k"), (F.col("id") / 100).alias("x"), F.lit("a").alias("kind"))
    for part in range(4):  # several files, several micro-batches
        publish(records.filter(F.col("k") % 4 == part).coalesce(1), "text", f"{tmp_path}/topic")
    spark.createDataFrame([("junk",)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/topic")

    def run():
        stream = read_message_stream(spark, "text", f"{tmp_path}/topic", maxFilesPerTrigger=2)
        score_stream(stream, SCHEMA, model, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", ["k"],
                     every=None).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    columns = ["k", "x", "prediction", "bad_probability", "good_probability", "prediction_label"]
    out = run()
    assert len(list((tmp_path / "out").glob("run=*/batch_id=*"))) == 3
    assert rows(out, *columns) == rows(score(records, model), *columns)
    assert rows(spark.read.parquet(f"{tmp_path}/bad"), "value") == [("junk",)]
    assert run().count() == 100  # nothing new: nothing written


def test_a_new_checkpoint_leaves_earlier_output(spark, model, rows, tmp_path):
    records = spark.range(30).select(F.col("id").alias("k"), (F.col("id") / 30).alias("x"), F.lit("a").alias("kind"))
    for half in range(2):  # batch numbers begin at 0 twice
        publish(records.filter(F.col("k") % 2 == half), "text", f"{tmp_path}/topic{half}")
        stream = read_message_stream(spark, "text", f"{tmp_path}/topic{half}")
        score_stream(stream, SCHEMA, model, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp{half}", ["k"], every=None).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["k"] for r in out.collect()) == list(range(30)) and out.select("run").distinct().count() == 2


def test_replayed_batch_leaves_one_copy(spark, model, tmp_path):
    write = write_batch(SCHEMA, model, f"{tmp_path}/out", f"{tmp_path}/bad")
    batch = spark.createDataFrame([(m,) for m in GOOD], "value string")
    write(batch, 5)
    write(batch, 5)
    write(batch.limit(0), 6)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 3 and [r["batch_id"] for r in out.select("batch_id").distinct().collect()] == [5]


def test_a_crash_between_the_writes_shows_nothing(spark, model, rows, tmp_path, monkeypatch):
    out, bad = f"{tmp_path}/out", f"{tmp_path}/bad"
    write = write_batch(SCHEMA, model, out, bad, ["k"])
    batch = spark.createDataFrame([(m,) for m in GOOD + BAD[:2]], "value string")
    write(batch.limit(1), 4)
    whole = DataFrameWriter.parquet
    for step in ("bad/", "_commits/"):

        def crash(self, path, *args, step=step, **kwargs):
            if step in path:
                raise OSError("lost")
            return whole(self, path, *args, **kwargs)

        with monkeypatch.context() as patch:
            patch.setattr(DataFrameWriter, "parquet", crash)
            with pytest.raises(OSError):
                write(batch, 5)
        assert spark.read.parquet(out).filter("batch_id = 5").count() == 3  # half of it is there
        assert rows(committed(spark, out), "batch_id") == [(4,)]
        assert read_committed(spark, out).count() == 1
    write(batch, 5)
    assert rows(committed(spark, out), "batch_id", "scored", "rejected") == [(4, 1, 0), (5, 3, 2)]
    assert rows(read_committed(spark, out), "k") == [(1,), (1,), (2,), (3,)] and read_committed(spark, out, bad).count() == 2
    before = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    write(batch, 5)  # whole already: a replay leaves it
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.parquet")) == before


def test_no_batch_yet(spark, tmp_path):
    assert committed(spark, f"{tmp_path}/nothing").count() == 0


def test_stop_finishes_the_batch_and_a_restart_goes_on(spark, model, rows, tmp_path):
    records = spark.range(60).select(F.col("id").alias("k"), (F.col("id") / 60).alias("x"), F.lit("a").alias("kind"))
    for part in range(6):
        publish(records.filter(F.col("k") % 6 == part).coalesce(1), "text", f"{tmp_path}/topic")
    out, mark = f"{tmp_path}/out", tmp_path / "stop"

    def run(stop, every):
        stream = read_message_stream(spark, "text", f"{tmp_path}/topic", maxFilesPerTrigger=1)
        query = score_stream(stream, SCHEMA, model, out, f"{tmp_path}/bad", f"{tmp_path}/cp", ["k"], every=every, stop=stop)
        stop.wait(query)
        assert not query.isActive

    class AfterTwo(OrderlyStop):
        def onQueryProgress(self, event):
            if event.progress.batchId == 1:
                mark.write_text("")
            super().onQueryProgress(event)

    run(AfterTwo(file_mark(spark, str(mark))), "0 seconds")
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("run=*/batch_id=*"))
    done = sorted(r["batch_id"] for r in committed(spark, out).collect())
    assert batches == done and 2 <= len(done) < 6  # nothing half written, and not all
    mark.unlink()
    run(OrderlyStop(file_mark(spark, str(mark))), None)
    assert sorted(r["k"] for r in read_committed(spark, out).collect()) == list(range(60))
    assert spark.read.parquet(out).count() == 60


def test_an_idle_stream_stops_and_failures_are_raised(spark, model, tmp_path):
    publish(spark.range(1).select(F.col("id").alias("k")), "text", f"{tmp_path}/topic")

    def start(stop):
        stream = read_message_stream(spark, "text", f"{tmp_path}/topic")
        return score_stream(stream, SCHEMA, model, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", every="0 seconds", stop=stop)

    stop = OrderlyStop(lambda: bool(stop.finished))
    stop.wait(start(stop), poll=0.1)
    assert list(stop.finished.values()) == [[0]]

    class Failing(OrderlyStop):
        def between(self, write):
            def fail(batch, batch_id):
                raise ValueError("no room")
            return fail

    publish(spark.range(1).select(F.col("id").alias("k")), "text", f"{tmp_path}/topic")
    failing = Failing()
    with pytest.raises(Exception, match="no room"):
        failing.wait(start(failing))


def test_a_batch_keeps_plain_columns_and_only_bad_texts(spark, model, rows, tmp_path, monkeypatch):
    messages = spark.createDataFrame([(m,) for m in GOOD + BAD], "value string")
    kept, persist = [], type(messages).persist

    def looking(df, *args):
        kept.append((df.schema, df.where("valid and value is not null").count()))
        return persist(df, *args)

    monkeypatch.setattr(type(messages), "persist", looking)
    write_batch(SCHEMA, model, f"{tmp_path}/out", f"{tmp_path}/bad", ["k"])(messages, 0)
    (schema, texts), = kept
    assert texts == 0 and not any(isinstance(f.dataType, T.StructType) for f in schema)  # before: all texts, and records
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("k", "x", "kind")) == [(1, 0.5, "a"), (2, 0.25, None), (3, 1.0, "b")]
    assert rows(spark.read.parquet(f"{tmp_path}/bad").select("value")) == sorted([(m,) for m in BAD], key=repr)
