import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcomelens.sources.declared import account, convert, is_bad, read_csv_declared, split_bad
from outcomelens.sources.inferred import json_conflicts, json_paths, json_schema

DECLARED = {"id": "bigint", "when": "timestamp", "share (pct)": "double", "flag": "boolean", "gone": "int"}


@pytest.fixture
def table(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'note,id,share (pct),when,flag\n"a, b",1,0.5,2007-08-26 19:09:29.263000000,True\n,x,,yesterday,False\nshort,2\n'
        '"two\nlines",3,1e3,2008-01-01,maybe\n')
    (tmp_path / "b.csv").write_text("note,id,share (pct),when,flag\nlong,4,1,2008-01-01,True,5,6\n,,,,\n")
    return read_csv_declared(spark, str(tmp_path), DECLARED, multiLine=True)


def test_values_faults_and_broken_records(table):
    got = {r["note"]: r for r in table.filter("note IS NOT NULL").collect()}
    assert table.schema["when"].dataType == T.TimestampType() and table.schema["note"].dataType == T.StringType()
    assert got["a, b"]["id"] == 1 and got["a, b"]["flag"] is True and got["a, b"]["when"].year == 2007
    assert got["two\nlines"]["_bad_fields"] == ["flag"] and got["two\nlines"]["share (pct)"] == 1000.0
    rest = table.filter("note IS NULL").collect()
    assert sorted(r["_bad_record"][:5] for r in rest if r["_bad_record"]) == ["long,", "short"]
    assert [r["_bad_fields"] for r in rest if r["_bad_fields"]] == [["id", "when"]]
    assert table.count() == 6 and table.filter(is_bad()).count() == 4


def test_account_and_quarantine(table, rows):
    assert rows(account(table, DECLARED)) == sorted([
        ("(record)", "csv", 4, 2), ("id", "bigint", 2, 1), ("when", "timestamp", 2, 1), ("share (pct)", "double", 2, 0), ("flag", "boolean", 2, 1),
        ("gone", "int", None, None)], key=repr)
    kept, bad = split_bad(table)
    assert kept.count() == 2 and bad.count() == 4 and "_bad_fields" not in kept.columns


def test_nothing_declared_and_empty(spark):
    read = convert(spark.createDataFrame([("1",), (None,)], "x string"), {})
    assert account(read, {}).collect()[0]["present"] == 2 and split_bad(read)[1].count() == 0
    assert account(read.limit(0), {"x": "int"}).count() == 2


def shape(value, path="$"):
    """(path, type) of a value, by walking it."""
    kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "NULL"}[type(value)]
    found = {(path, kind)}
    for name, inner in (value.items() if kind == "OBJECT" else [("[]", v) for v in value] if kind == "ARRAY" else []):
        found |= shape(inner, path + (name if kind == "ARRAY" else "." + name))
    return found


def made(draw, depth):
    kinds = [None, True, draw.randint(0, 99), draw.randint(0, 9) + 0.5, "t", "é \"q\""]
    if depth:
        kinds += [{k: made(draw, depth - 1) for k in draw.sample("abcd", draw.randint(0, 3))}, [made(draw, depth - 1) for _ in range(draw.randint(0, 3))]] * 3
    return draw.choice(kinds)


def test_paths_match_a_walk_over_the_values(spark, rows):
    draw = random.Random(4)
    values = [made(draw, 4) for _ in range(150)]
    texts = [json.dumps(v) for v in values] + ["{", "", None]
    want = {}
    for v in values:
        for cell in shape(v):
            want[cell] = want.get(cell, 0) + 1
    want["$", "UNREADABLE"] = 2
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert rows(json_paths(df, "j"), "path", "type", "n") == sorted(((*k, n) for k, n in want.items()), key=repr)
    cut = {k: n for k, n in want.items() if k[0].count(".") + k[0].count("[]") <= 2}
    assert rows(json_paths(df, "j", depth=2), "path", "type", "n") == sorted(((*k, n) for k, n in cut.items()), key=repr)


def test_schema_reads_what_it_was_inferred_from(spark):
    texts = ['{"a":1,"b":{"c":[1,2.5],"x.y":null},"d":[{"e":"t"},{"e":2}]}', '{"a":2.5,"b":{"c":[]},"f":true}', '{"d":[]}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    conflicts = json_conflicts(json_paths(df, "j"))
    assert [r["path"] for r in conflicts.filter("conflict").collect()] == ["$.d[].e"]
    schema = json_schema(conflicts)
    assert schema.simpleString() == "struct<a:double,b:struct<c:array<double>,x.y:string>,d:array<struct<e:string>>,f:boolean>"
    first = df.select(F.from_json("j", schema).alias("r")).first()["r"]
    assert first["a"] == 1.0 and first["b"]["c"] == [1.0, 2.5] and [e["e"] for e in first["d"]] == ["t", "2"]


def test_a_name_with_a_dot_is_not_a_path(spark, rows):
    df = spark.createDataFrame([('{"a.b":1}',), ('{"a":{"b":"t"}}',)], "j string")
    found = json_conflicts(json_paths(df, "j"))
    assert rows(found.filter("path = '$.a.b'"), "parent", "name", "merged") == [("$", "a.b", "BIGINT"), ("$.a", "b", "STRING")]
    assert json_conflicts(json_paths(df.limit(0), "j")).count() == 0 and json_schema(found.limit(0)) == T.StructType([])


ODD = ['{"a":1}', '{"a": -7 }', '{"a":12345678901234567890}', '{"a":1.5}', '{"a":100.0}', '{"a":1e5}', '{"a":0.1234567890123456789}', '{"a":01}', '{"a":1.}',
       '{"a":"x,y:"}', '{"a":"q\\"1\\\\"}', '{"q\\"1":"\\n"}', '{"a":"\\x"}', '{"a":"t\tb"}', '["a,",":",1,2.5,null,true,[],{}]', '[]', '[5]', '"1', '["a","', '"',
       '"a"', '5', '\x01', '[\x01]', '{"a":1,"a":2}', '{"a.b":{"c":[{"d":[1,"x"]}]}}', '[1.5e400,"s"]', '{"a" \n:\t[ 1 , "2" ]}', '', ' ']


def test_a_shape_has_the_paths_of_its_texts(spark):
    from outcomelens.sources.inferred import json_shape, shape_text, walked
    df = spark.createDataFrame([(t,) for t in ODD], "value string")
    # a bit per text: a sum tells which ones it is of, so two wrong ones cannot make up for each other
    bits = df.select("value", F.expr("shiftleft(1L, cast(row_number() over (order by value) as int))").alias("n"))
    whole = walked(bits, "value", "n", 5)
    shapes = walked(bits.select(shape_text(json_shape(F.col("value"))).alias("value"), "n"), "value", "n", 5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, shapes.collect()))
    counted = walked(df.withColumn("n", F.lit(1)), "value", "n", 5)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, json_paths(df, "value").collect()))


def test_records_of_one_shape_are_walked_once(spark, monkeypatch):
    from outcomelens.sources import inferred
    seen = []
    walked = inferred.walked
    monkeypatch.setattr(inferred, "walked", lambda texts, *rest: (seen.append(texts.count()), walked(texts, *rest))[1])
    df = spark.range(5000).select(F.concat(F.lit('{"k":'), "id", F.lit(',"v":["n'), "id", F.lit('",'), "id", F.lit(".5]}")).alias("value"))
    found = {r["path"] + " " + r["type"]: r["n"] for r in inferred.json_paths(df, "value").collect()}
    assert seen == [1]  # before: all 5000
    assert found == dict.fromkeys(["$ OBJECT", "$.k BIGINT", "$.v ARRAY", "$.v[] STRING", "$.v[] DECIMAL"], 5000)
