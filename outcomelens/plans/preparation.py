"""Preparation and splitting queries over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ColumnGroups, feature_types
from ..operators import preparation as prep
from ..operators import splitting
from ..operators.ordering import exact_quantiles
from ..operators.temporal import date_features as add_date_features
from .registry import query
from .tables import (
    BUCKET_SQL, NEGATIVE, POSITIVE, RECORDS_SQL, ROW_KEY, STATUS, TARGET, Tables,
)

KEYS = ", ".join(ROW_KEY)


@query("date_features", f"""
    SELECT {KEYS}, CAST(year(l_shipdate) AS BIGINT) AS ship_year, CAST(month(l_shipdate) AS BIGINT) AS ship_month,
        CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(month(o_orderdate) AS BIGINT) AS order_month,
        date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_to_ship
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_features(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    made = add_date_features(
        joined.select(*ROW_KEY, "l_shipdate", "o_orderdate"),
        {"ship": "l_shipdate", "order": "o_orderdate"}, {"days_to_ship": ("l_shipdate", "o_orderdate")},
        drop=["l_shipdate", "o_orderdate"])
    return made.select(*ROW_KEY, *[
        F.col(c).cast("long").alias(c) for c in ("ship_year", "ship_month", "order_year", "order_month", "days_to_ship")
    ])


NARROW = ["l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query("dedup_rows", f"SELECT DISTINCT {', '.join(NARROW)} FROM lineitem")
def dedup_rows(t: Tables):
    return prep.dedup_rows(t.lineitem.select(*NARROW))


@query("dedup_counts", f"""
    WITH d AS (SELECT DISTINCT {', '.join(NARROW)} FROM lineitem)
    SELECT (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM d) AS rows_after,
        (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM d) AS rows_removed""")
def dedup_counts(t: Tables):
    return prep.dedup_counts(t.lineitem.select(*NARROW))


GROUPS = ColumnGroups(
    status=STATUS, target=TARGET, numeric=("discount_n", "tax_known"), categorical=("l_linestatus",),
    boolean=("is_known_final",))
# the flag is unknown where no tax is known
FLAG_SQL = "CASE WHEN tax_known IS NOT NULL THEN is_final END"


def typed_input(t: Tables):
    return t.records().select(
        *ROW_KEY, TARGET, "discount_n", "tax_known",
        F.when(F.col("discount_n") != 3, F.col("l_linestatus")).alias("l_linestatus"),
        F.when(F.col("tax_known").isNotNull(), F.col("is_final")).alias("is_known_final"))


@query("standardize_types", f"""
    SELECT {KEYS}, l_extendedprice, CAST(discount_n AS DOUBLE) AS discount_n, tax_known,
        CASE WHEN discount_n <> 3 THEN l_linestatus END AS l_linestatus,
        coalesce(CAST({FLAG_SQL} AS VARCHAR), 'Unknown') AS is_known_final FROM {RECORDS_SQL}""")
def standardize_types(t: Tables):
    return prep.standardize_types(typed_input(t), GROUPS)


@query("fill_unknown", f"""
    SELECT {KEYS}, coalesce(CASE WHEN discount_n <> 3 THEN l_linestatus END, 'Unknown') AS l_linestatus
    FROM {RECORDS_SQL}""")
def fill_unknown(t: Tables):
    return prep.fill_unknown(typed_input(t).select(*ROW_KEY, "l_linestatus"), ["l_linestatus"])


@query("impute_median", f"""
    WITH m AS (SELECT quantile_disc(tax_known, 0.5) AS tax_m, quantile_disc(tax_sparse, 0.5) AS sparse_m
        FROM {RECORDS_SQL})
    SELECT {KEYS}, coalesce(tax_known, tax_m) AS tax_known, coalesce(tax_sparse, sparse_m) + 0 AS tax_sparse
    FROM {RECORDS_SQL}, m""")
def impute_median(t: Tables):
    columns = ["tax_known", "tax_sparse"]
    records = t.records().select(*ROW_KEY, *columns)
    found = {r["column"]: r["value"] for r in exact_quantiles(records, columns).collect()}  # one row per column
    filled = prep.fill_values(records, {c: found.get(c, 0.0) for c in columns})
    return filled.withColumn("tax_sparse", F.col("tax_sparse") + 0)


@query("label_build", f"""
    SELECT {KEYS}, l_quantity, l_discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
    FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def label_build(t: Tables):
    records = t.lineitem.select(*ROW_KEY, "l_quantity", "l_discount", TARGET, STATUS)
    return prep.label_set(records, STATUS, NEGATIVE, POSITIVE, exclude=[TARGET])


@query("regression_set", f"""
    SELECT {KEYS}, tax_known, l_quantity FROM {RECORDS_SQL} WHERE tax_known IS NOT NULL AND NOT isnan(tax_known)""")
def regression_set(t: Tables):
    records = t.records().select(*ROW_KEY, "tax_known", "l_quantity", STATUS)
    return prep.target_set(records, "tax_known", STATUS)


SPLIT_SQL = f"""CASE WHEN {BUCKET_SQL} % 10 < 7 THEN 'train' WHEN {BUCKET_SQL} % 10 < 9 THEN 'test' ELSE 'stream' END"""


def labelled(t: Tables):
    return prep.label_set(t.lineitem, STATUS, NEGATIVE, POSITIVE)


KIND_COLUMNS = {"l_orderkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric", "tax_known": "numeric", "l_returnflag": "categorical",
                "is_final": "categorical", "l_shipdate": "other"}


@query("feature_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{kind}' AS kind, count({c}) AS present FROM {RECORDS_SQL}" for c, kind in KIND_COLUMNS.items()))
def feature_kinds(t: Tables):
    """Kind of each column by its type, with its present values; dates are no features."""
    records = t.records().select(*KIND_COLUMNS)
    types = feature_types(records)
    kinds = {c: "numeric" if c in types.numeric else "categorical" if c in types.categorical else "other" for c in records.columns}
    counts = records.agg(*[F.count(c).alias(c) for c in records.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).alias("present")) for c, kind in kinds.items()])))


@query("split_counts", f"""
    SELECT {SPLIT_SQL} AS part, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS label, count(*) AS n
    FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def split_counts(t: Tables):
    part = splitting.split_name(ROW_KEY, {"train": 7, "test": 2, "stream": 1})
    return labelled(t).groupBy(part.alias("part"), F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"))


@query("split_exact", f"""
    WITH d AS (
        SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws('-', 'exact', l_orderkey, l_partkey, l_suppkey, l_linenumber))) - 1 AS place
        FROM lineitem),
    shares AS (SELECT * FROM (VALUES (1, 'train', 7), (2, 'test', 2), (3, 'stream', 1)) AS v(i, part, share)),
    labels AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
    even AS (SELECT *, n * share // 10 AS base, n * share % 10 AS rest FROM labels, shares),
    quota AS (
        SELECT *, base + CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY rest DESC, i)
            <= n - sum(base) OVER (PARTITION BY l_returnflag) AS INTEGER) AS quota FROM even),
    ends AS (SELECT *, sum(quota) OVER (PARTITION BY l_returnflag ORDER BY i) AS upto FROM quota)
    SELECT l_returnflag, part, count(*) AS n, max(quota) = count(*) AS meets_quota, CAST(sum(l_orderkey) AS BIGINT) AS order_keys,
        CAST(sum(l_partkey) AS BIGINT) AS part_keys
    FROM d JOIN ends USING (l_returnflag) WHERE place < upto AND place >= upto - quota GROUP BY 1, 2""")
def split_exact(t: Tables):
    """Rows of each status in each part of an exact 7:2:1 split, whether that is the quota, and sums that tell which rows they are."""
    shares = {"train": 7, "test": 2, "stream": 1}
    split = splitting.exact_split(t.lineitem, ROW_KEY, STATUS, shares, salt="exact")
    counted = split.groupBy(STATUS, "part").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("order_keys"), F.sum("l_partkey").alias("part_keys"))
    upto = splitting.quota_bounds(F.sum("n").over(Window.partitionBy(STATUS)), shares)  # three rows per status
    quota, before = F.lit(0), F.lit(0)
    for name, bound in upto.items():
        quota, before = F.when(F.col("part") == name, bound - before).otherwise(quota), bound
    return counted.withColumn("meets_quota", F.col("n") == quota)


@query("split_two_way", f"""
    SELECT CASE WHEN {BUCKET_SQL} % 10 < 8 THEN 'train' ELSE 'test' END AS part, count(*) AS n,
        CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS BIGINT) AS price_total
    FROM lineitem GROUP BY 1""")
def split_two_way(t: Tables):
    total = F.round(F.sum(F.col(TARGET).cast("decimal(18,2)"))).cast("long").alias("price_total")
    part = splitting.split_name(ROW_KEY, {"train": 8, "test": 2})
    return t.lineitem.groupBy(part.alias("part")).agg(F.count("*").alias("n"), total)


@query("class_weights", f"""
    SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS good_rows, count(*) FILTER (WHERE l_returnflag = 'R') AS bad_rows,
        CAST(count(*) AS DOUBLE) / (2 * count(*) FILTER (WHERE l_returnflag = 'A')) AS good_weight,
        CAST(count(*) AS DOUBLE) / (2 * count(*) FILTER (WHERE l_returnflag = 'R')) AS bad_weight
    FROM lineitem WHERE l_returnflag IN ('R', 'A') AND {BUCKET_SQL} % 10 < 7""")
def class_weights(t: Tables):
    train = splitting.hash_split(labelled(t), ROW_KEY, {"train": 7, "test": 2, "stream": 1})["train"]
    return splitting.class_weight_table(train)


SKETCHED = ["l_extendedprice", "l_quantity", "tax_known", "tax_sparse"]


@query("medians_approx", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, TRUE AS near_the_middle FROM {RECORDS_SQL}" for c in SKETCHED))
def medians_approx(t: Tables):
    """Per column its present values, and whether the sketch's median lies within 0.1 % of ranks from the middle."""
    records = t.records().select(*SKETCHED)
    found = prep.medians(records, SKETCHED).first()  # one row
    ranks = records.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("present"), F.count_if(F.col(c) < found[c]).alias("below"),
                 F.count_if(F.col(c) <= found[c]).alias("reached")).alias(c) for c in SKETCHED])
    return ranks.select(F.inline(F.array(*SKETCHED))).select(
        "column", "present",
        ((F.col("below") <= 0.501 * F.col("present")) & (F.col("reached") >= 0.499 * F.col("present"))).alias("near_the_middle"))


PREPARED_SQL = f"""
    WITH base AS (SELECT *, {FLAG_SQL} AS flag, CASE WHEN discount_n <> 3 THEN l_linestatus END AS line_status,
            date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS wait,
            {BUCKET_SQL} % 10 < 7 AS in_train
        FROM {RECORDS_SQL} JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT quantile_disc(tax_known, 0.5) FILTER (WHERE in_train) AS tax_m,
        quantile_disc(tax_sparse, 0.5) FILTER (WHERE in_train) AS sparse_m FROM base)
    SELECT {KEYS}, l_extendedprice, coalesce(tax_known, tax_m) AS tax_known,
        coalesce(tax_sparse, sparse_m) + 0 AS tax_sparse, coalesce(line_status, 'Unknown') AS l_linestatus,
        coalesce(CAST(flag AS VARCHAR), 'Unknown') AS is_known_final, CAST(year(l_shipdate) AS DOUBLE) AS ship_year,
        CAST(month(l_shipdate) AS DOUBLE) AS ship_month, CAST(wait AS DOUBLE) AS days_to_ship FROM base, m"""


@query("prepare_fit_transform", PREPARED_SQL)
def prepare_fit_transform(t: Tables):
    """Medians learnt on the train part, everything else a projection over all rows."""
    records = t.records().join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *ROW_KEY, TARGET, "tax_known", "tax_sparse", "l_shipdate", "o_orderdate",
        F.when(F.col("discount_n") != 3, F.col("l_linestatus")).alias("l_linestatus"),
        F.when(F.col("tax_known").isNotNull(), F.col("is_final")).alias("is_known_final"))
    groups = ColumnGroups(
        status=STATUS, target=TARGET, numeric=("tax_known", "tax_sparse"), categorical=("l_linestatus",),
        boolean=("is_known_final",), dates=("l_shipdate", "o_orderdate"))
    preparer = prep.Preparer(
        groups, {"ship": "l_shipdate"}, {"days_to_ship": ("l_shipdate", "o_orderdate")}, exact=True)
    train = splitting.hash_split(records, ROW_KEY, {"train": 7, "test": 2, "stream": 1})["train"]
    return preparer.fit(train).transform(records).withColumn("tax_sparse", F.col("tax_sparse") + 0)
