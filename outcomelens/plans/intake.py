"""Reading what was not written here: declared CSV with its faults counted, JSON whose schema is not known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.progress import Progress
from ..session import scratch_path
from ..sources.declared import BAD_FIELDS, BAD_RECORD, RECORD, account, read_csv_declared, split_bad
from ..sources.inferred import json_conflicts, json_paths, json_schema
from .registry import query
from .tables import Tables

NAMES = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_comment_code"]
DECLARED = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "date", "l_comment_code": "int", "l_absent": "date"}


def damaged_csv(t: Tables) -> DataFrame:
    """The records as CSV lines. Line 7 has no number for its quantity, 6 a date of another form, 5 no quantity; every other line 4 lacks its last two fields."""
    line = F.col("l_linenumber")
    fields = [
        F.col("l_orderkey").cast("string"), line.cast("string"),
        F.when(line == 7, "n/a").when(line == 5, "").otherwise(F.col("l_quantity").cast("string")),
        F.when(line == 6, F.date_format("l_shipdate", "dd.MM.yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")),
    ]
    rest = [F.col("l_returnflag"), F.when(line == 3, F.col("l_linestatus")).otherwise(line.cast("string"))]
    short = (line == 4) & (F.col("l_orderkey") % 2 == 0)
    path = scratch_path(t.spark, "damaged-csv")
    t.lineitem.select(F.when(short, F.concat_ws(",", *fields)).otherwise(F.concat_ws(",", *fields, *rest)).alias("value")).write.text(path)
    return read_csv_declared(t.spark, path, DECLARED, NAMES)


DAMAGED_SQL = """(
    SELECT *, l_linenumber = 4 AND l_orderkey % 2 = 0 AS short, CAST(l_orderkey AS VARCHAR) AS f_key, CAST(l_linenumber AS VARCHAR) AS f_line,
        CASE l_linenumber WHEN 7 THEN 'n/a' WHEN 5 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS f_quantity,
        CASE l_linenumber WHEN 6 THEN strftime(l_shipdate, '%d.%m.%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS f_date,
        CASE l_linenumber WHEN 3 THEN l_linestatus ELSE CAST(l_linenumber AS VARCHAR) END AS f_code FROM lineitem)"""


def _field_sql(name: str, column: str, kind: str) -> str:
    return (f"SELECT '{name}' AS field, '{kind}' AS type, count(TRY_CAST({column} AS {kind})) AS present, "
            f"count({column}) - count(TRY_CAST({column} AS {kind})) AS failed FROM {DAMAGED_SQL} WHERE NOT short")


@query("csv_field_accounts", f"""
    SELECT '{RECORD}' AS field, 'csv' AS type, count(*) FILTER (WHERE NOT short) AS present, count(*) FILTER (WHERE short) AS failed
    FROM {DAMAGED_SQL} UNION ALL """ + " UNION ALL ".join(_field_sql(*f) for f in [
        ("l_orderkey", "f_key", "bigint"), ("l_linenumber", "f_line", "int"), ("l_quantity", "f_quantity", "double"),
        ("l_shipdate", "f_date", "date"), ("l_comment_code", "f_code", "int")]) + " UNION ALL SELECT 'l_absent', 'date', NULL, NULL")
def csv_field_accounts(t: Tables):
    """Per declared column the values that are there and those that its type cannot hold, and the records that are no records."""
    return account(damaged_csv(t), DECLARED)


@query("csv_quarantine", f"""
    SELECT CASE WHEN short THEN '{RECORD}' ELSE concat_ws('+',
            CASE WHEN f_quantity IS NOT NULL AND TRY_CAST(f_quantity AS DOUBLE) IS NULL THEN 'l_quantity' END,
            CASE WHEN TRY_CAST(f_date AS DATE) IS NULL THEN 'l_shipdate' END,
            CASE WHEN TRY_CAST(f_code AS INT) IS NULL THEN 'l_comment_code' END) END AS reason,
        count(*) AS n, CAST(coalesce(sum(CASE WHEN NOT short THEN l_orderkey END), 0) AS BIGINT) AS order_keys,
        count(CASE WHEN NOT short THEN TRY_CAST(f_date AS DATE) END) AS dated
    FROM {DAMAGED_SQL} GROUP BY 1""")
def csv_quarantine(t: Tables):
    """Kept rows (no reason) and quarantined ones by what is wrong with them."""
    kept, bad = split_bad(damaged_csv(t))
    reason = F.when(F.col(BAD_RECORD).isNotNull(), RECORD).otherwise(F.array_join(BAD_FIELDS, "+"))
    rows = kept.withColumn("reason", F.lit("")).unionByName(bad.withColumn("reason", reason).drop(BAD_FIELDS, BAD_RECORD))
    return rows.groupBy("reason").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("l_orderkey"), F.lit(0)).alias("order_keys"), F.count("l_shipdate").alias("dated"))


def mixed_json(t: Tables) -> DataFrame:
    """A JSON text per record whose shape hangs on the line: a key that is text (5) or null (6), a part that is a number (6), a text cut short (7)."""
    line = F.col("l_linenumber")
    key = F.when(line == 5, F.concat(F.lit('"K'), "l_orderkey", F.lit('"'))).when(line == 6, "null").otherwise(F.col("l_orderkey").cast("string"))
    part = F.when(line == 6, "3").otherwise(F.concat(
        F.lit('{"no":'), "l_partkey", F.lit(',"flags":["'), "l_returnflag", F.lit('",'), line, F.lit("]}")))
    amount = F.when(line == 2, F.col("l_quantity").cast("int").cast("string")).otherwise(
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5")))
    whole = F.concat(F.lit('{"key":'), key, F.lit(',"part":'), part, F.lit(',"amount":'), amount, F.lit("}"))
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    # a text costs far more to parse than its record to move, and the table may be one file
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.lineitem.select(columns).repartition(tasks, "l_orderkey", "l_linenumber").select(F.when(line == 7, '{"key":1,').otherwise(whole).alias("value"))


def _paths_sql(*cells: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{path}' AS path, '{kind}' AS type, count(*) AS n FROM lineitem WHERE {where} HAVING count(*) > 0" for path, kind, where in cells)


PATHS = [
    ("$", "UNREADABLE", "l_linenumber = 7"), ("$", "OBJECT", "l_linenumber <> 7"),
    ("$.key", "BIGINT", "l_linenumber < 5"), ("$.key", "STRING", "l_linenumber = 5"), ("$.key", "NULL", "l_linenumber = 6"),
    ("$.part", "BIGINT", "l_linenumber = 6"), ("$.part", "OBJECT", "l_linenumber < 6"), ("$.part.no", "BIGINT", "l_linenumber < 6"),
    ("$.part.flags", "ARRAY", "l_linenumber < 6"), ("$.part.flags[]", "STRING", "l_linenumber < 6"), ("$.part.flags[]", "BIGINT", "l_linenumber < 6"),
    ("$.amount", "BIGINT", "l_linenumber = 2"), ("$.amount", "DECIMAL", "l_linenumber NOT IN (2, 7)"),
]


@query("json_path_types", _paths_sql(*PATHS))
def json_path_types(t: Tables):
    """Which types every path of the texts holds, and in how many rows."""
    return json_paths(mixed_json(t), "value").select("path", "type", "n")


@query("json_conflicts", f"""
    WITH p AS ({_paths_sql(*PATHS)})
    SELECT path, array_to_string(list_sort(list(type) FILTER (WHERE type NOT IN ('NULL', 'UNREADABLE'))), '+') AS types,
        CASE WHEN path IN ('$', '$.part.flags', '$.part.no') THEN max(CASE WHEN type <> 'UNREADABLE' THEN type END)
            WHEN path = '$.amount' THEN 'DECIMAL' ELSE 'STRING' END AS merged,
        path IN ('$.key', '$.part', '$.part.flags[]') AS conflict, CAST(sum(CASE WHEN type <> 'UNREADABLE' THEN n END) AS BIGINT) AS n
    FROM p GROUP BY path""")
def json_conflict_report(t: Tables):
    """The common type of every path, and where there is none but text."""
    found = json_conflicts(json_paths(mixed_json(t), "value"))
    return found.select("path", F.array_join("types", "+").alias("types"), "merged", "conflict", "n")


@query("json_inferred_read", """
    SELECT count(*) FILTER (WHERE l_linenumber <> 7) AS n, CAST(sum(CASE WHEN l_linenumber <> 7 THEN floor(l_quantity) END) AS BIGINT) AS amounts,
        count(DISTINCT CASE WHEN l_linenumber <= 5 THEN CASE WHEN l_linenumber = 5 THEN 'K' ELSE '' END || l_orderkey END) AS keys FROM lineitem""")
def json_inferred_read(t: Tables):
    """The texts read with the schema inferred from all of them; what is no JSON is null."""
    texts = mixed_json(t)
    schema = json_schema(json_conflicts(json_paths(texts, "value")))
    read = texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("whole"))
    return read.where("whole").agg(
        F.count("r").alias("n"), F.sum(F.floor("r.amount")).cast("long").alias("amounts"), F.count_distinct("r.key").alias("keys"))


@query("write_progress", """
    SELECT unnest(['read', 'read', 'resolved', 'dear']) AS stage, unnest(['rows', 'bad', 'rows', 'rows']) AS metric,
        unnest([count(*), count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag IN ('R', 'A')),
            count(*) FILTER (WHERE l_returnflag IN ('R', 'A') AND l_extendedprice > 45000)]) AS value FROM lineitem""")
def write_progress(t: Tables):
    """Rows of each stage of a write, counted by the write itself."""
    progress = Progress(t.spark)
    read = progress.watch(Tables(progress.session, t.sf_dir).lineitem, "read", F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    resolved = progress.watch(read.where(F.col("l_returnflag").isin("R", "A")), "resolved")
    progress.watch(resolved.where(F.col("l_extendedprice") > 45000), "dear").write.parquet(scratch_path(t.spark, "dear"))
    return progress.table().select("stage", "metric", "value")
