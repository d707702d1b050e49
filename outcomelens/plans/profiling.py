"""Profiling and distribution queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcome_group
from ..operators import profiling
from ..operators.ordering import exact_quantiles
from ..session import scratch_path
from ..sources import read_csv, write_csv
from .registry import query
from .tables import NEGATIVE, POSITIVE, RECORDS_SQL, STATUS, TARGET, Tables

PROFILED = ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "tax_known", "tax_sparse", "is_final"]
PRIORITY_ORDER = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]  # 4-NOT SPECIFIED is left out on purpose: it comes last


def _missing_sql(columns_types, table) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", '{kind}' AS data_type, count(*) - count({c}) AS missing_count, "
        f"count({c}) AS present_count, "
        f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 2) AS missing_percent FROM {table}"
        for c, kind in columns_types
    ]
    return " UNION ALL ".join(parts)


PROFILED_TYPES = list(zip(PROFILED, ["bigint", "double", "double", "string", "double", "double", "boolean"]))


@query("profile_shape", """
    SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, count(*) > 100000 AS enough_rows,
        true AS enough_columns, count(*) > 100000 AS accepted FROM lineitem""")
def profile_shape(t: Tables):
    return profiling.shape(t.lineitem)


@query("missing_summary", _missing_sql(PROFILED_TYPES, RECORDS_SQL))
def missing_summary(t: Tables):
    return profiling.missing_summary(t.records().select(*PROFILED))


@query("missing_top", f"""
    SELECT * FROM ({_missing_sql(PROFILED_TYPES, RECORDS_SQL)}) AS m
    ORDER BY missing_count DESC, "column" LIMIT 3""")
def missing_top(t: Tables):
    return profiling.missing_top(t.records().select(*PROFILED), 3)


@query("required_columns", f"""
    SELECT 'l_returnflag' AS "column", count(*) AS row_count, count(*) - count(l_returnflag) AS null_count,
        CAST(0 AS BIGINT) AS nan_count, count(*) = count(l_returnflag) AS complete FROM {RECORDS_SQL}
    UNION ALL SELECT 'tax_known', count(*), count(*) - count(tax_known),
        count(*) FILTER (WHERE isnan(tax_known)), count(*) = count(tax_known) FROM {RECORDS_SQL}""")
def required_columns(t: Tables):
    return profiling.required_column_report(t.records(), ["l_returnflag", "tax_known"])


@query("target_summary", """
    SELECT count(l_extendedprice) AS row_count, CAST(11 AS BIGINT) AS column_count, 'l_extendedprice' AS target,
        round(avg(l_extendedprice), 6) AS target_mean, round(min(l_extendedprice), 6) AS target_min,
        round(max(l_extendedprice), 6) AS target_max, round(stddev_samp(l_extendedprice), 6) AS target_stddev
    FROM lineitem""")
def target_summary(t: Tables):
    return profiling.target_summary(t.lineitem, TARGET)


@query("histogram", """
    WITH span AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 40 AS w FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - lo) / w) + 1, 40) AS BIGINT) AS bin,
        round(lo + w * (least(floor((l_extendedprice - lo) / w) + 1, 40) - 1), 6) AS bin_start,
        round(lo + w * least(floor((l_extendedprice - lo) / w) + 1, 40), 6) AS bin_end, count(*) AS n
    FROM lineitem, span GROUP BY 1, 2, 3""")
def histogram(t: Tables):
    return profiling.histogram(t.lineitem, TARGET, 40)


@query("medians", f"""
    SELECT 'l_extendedprice' AS "column", quantile_disc(l_extendedprice, 0.5) AS value FROM {RECORDS_SQL}
    UNION ALL SELECT 'l_quantity', quantile_disc(l_quantity, 0.5) FROM {RECORDS_SQL}
    UNION ALL SELECT 'tax_known', quantile_disc(tax_known, 0.5) FROM {RECORDS_SQL}
    UNION ALL SELECT 'tax_sparse', quantile_disc(tax_sparse, 0.5) FROM {RECORDS_SQL}""")
def medians(t: Tables):
    return exact_quantiles(t.records(), ["l_extendedprice", "l_quantity", "tax_known", "tax_sparse"])


@query("csv_roundtrip_profile", """
    SELECT count(*) AS row_count, count(l_shipdate) AS dated, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
        CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS BIGINT) AS price_total,
        CAST(min(year(l_shipdate)) AS BIGINT) AS first_year, count(DISTINCT l_returnflag) AS flags
    FROM lineitem""")
def csv_roundtrip_profile(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.lineitem, path)
    back = read_csv(t.spark, path, t.lineitem.schema)
    return back.agg(
        F.count("*").alias("row_count"),
        F.count("l_shipdate").alias("dated"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("price_total"),
        F.min(F.year("l_shipdate")).cast("long").alias("first_year"),
        F.count_distinct("l_returnflag").alias("flags"),
    )


@query("status_distribution", "SELECT l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC")
def status_distribution(t: Tables):
    return profiling.distribution(t.lineitem, STATUS, "status").orderBy(F.desc("n"), "status")


@query("outcome_distribution", """
    SELECT CASE WHEN l_returnflag = 'A' THEN 'Good' WHEN l_returnflag = 'R' THEN 'Bad' ELSE 'Other' END AS outcome_group,
        count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100, 2) AS percent
    FROM lineitem GROUP BY 1 ORDER BY n DESC""")
def outcome_distribution(t: Tables):
    group = outcome_group(STATUS, NEGATIVE, POSITIVE)
    return profiling.distribution(t.lineitem, group, "outcome_group", with_percent=True).orderBy(F.desc("n"))


@query("ordinal_distribution", """
    SELECT o_orderpriority, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
        WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 5 END AS BIGINT) AS position
    FROM orders GROUP BY 1, 3 ORDER BY position, o_orderpriority""")
def ordinal_distribution(t: Tables):
    return profiling.ordinal_distribution(t.orders, "o_orderpriority", PRIORITY_ORDER)


@query("nulls_last_distribution", f"""
    SELECT coalesce(CAST(nullif(discount_n, 0) AS VARCHAR), 'Missing') AS score, count(*) AS n
    FROM {RECORDS_SQL} GROUP BY 1""")
def nulls_last_distribution(t: Tables):
    scored = t.records().select(F.nullif(F.col("discount_n"), F.lit(0)).alias("score"))
    return profiling.nulls_last_distribution(scored, "score")


@query("label_distribution", """
    SELECT CAST(quality AS BIGINT) AS label, count(*) AS n,
        round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100, 2) AS percent
    FROM labels GROUP BY 1 ORDER BY 1""")
def label_distribution(t: Tables):
    label = F.col("quality").cast("long")
    return profiling.distribution(t.read("labels"), label, "label", with_percent=True).orderBy("label")
