"""Correlation and column-reduction queries over the test tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..config import DropGroup
from ..operators import correlation
from ..operators.reduction import reduction_ledger, removal_ledger, sparse_columns
from .registry import query
from .tables import RECORDS_SQL, TARGET, Tables

NUMERIC = ["l_extendedprice", "l_quantity", "net_price", "discount_n", "l_discount", "tax_known", "tax_sparse"]

# net_price follows the price closely, discount_n is a copy of l_discount: two redundant pairs, one with the target
CORR_SQL = f"(SELECT *, l_extendedprice * (1 - l_discount) AS net_price, l_quantity * 2 + l_tax AS quantity_like FROM {RECORDS_SQL})"
FEATURES = [*NUMERIC, "quantity_like"]


def featured(t: Tables):
    return t.records().withColumns({
        "net_price": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "quantity_like": F.col("l_quantity") * 2 + F.col("l_tax"),
    })


def _pairs_sql() -> str:
    """(feature_1, feature_2, r, target_r_1, target_r_2) of every pair, one aggregate per pair."""
    def target_r(f):
        return "NULL" if f == TARGET else f"corr({f}, {TARGET})"

    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, "
        f"CAST({target_r(a)} AS DOUBLE) AS target_r_1, CAST({target_r(b)} AS DOUBLE) AS target_r_2 FROM {CORR_SQL}"
        for a, b in combinations(FEATURES, 2)
    )


REDUNDANT_SQL = f"""
    SELECT DISTINCT CASE WHEN abs(target_r_1) >= abs(target_r_2) THEN feature_2 ELSE feature_1 END AS feature
    FROM ({_pairs_sql()}) AS p
    WHERE abs(r) >= 0.85 AND feature_1 <> '{TARGET}' AND feature_2 <> '{TARGET}'"""


@query("corr_scalars", f"""
    SELECT round(corr(l_quantity, l_extendedprice), 4) AS corr_quantity_price,
        round(corr(l_discount, tax_known), 4) AS corr_discount_tax,
        round(corr(tax_sparse, l_extendedprice), 4) AS corr_sparse_price FROM {RECORDS_SQL}""")
def corr_scalars(t: Tables):
    return correlation.corr_scalars(t.records(), {
        "corr_quantity_price": ("l_quantity", TARGET),
        "corr_discount_tax": ("l_discount", "tax_known"),
        "corr_sparse_price": ("tax_sparse", TARGET),
    })


@query("corr_filtered", f"""
    SELECT round(corr(l_discount, l_quantity), 4) AS corr_discount_quantity FROM {RECORDS_SQL}
    WHERE l_discount IS NOT NULL AND tax_known IS NOT NULL""")
def corr_filtered(t: Tables):
    both = t.records().filter(F.col("l_discount").isNotNull() & F.col("tax_known").isNotNull())
    return correlation.corr_scalars(both, {"corr_discount_quantity": ("l_discount", "l_quantity")})


@query("corr_pairs", f"""
    SELECT feature_1, feature_2, round(r, 6) AS r, round(target_r_1, 6) AS target_r_1,
        round(target_r_2, 6) AS target_r_2 FROM ({_pairs_sql()}) AS p""")
def corr_pairs(t: Tables):
    pairs = correlation.corr_pairs(featured(t), FEATURES, TARGET)
    return pairs.withColumns({c: F.round(c, 6) for c in ("r", "target_r_1", "target_r_2")})


@query("corr_with_target", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(corr({f}, {TARGET}), 6) AS r, round(abs(corr({f}, {TARGET})), 6) AS abs_r "
    f"FROM {CORR_SQL}" for f in FEATURES if f != TARGET))
def corr_with_target(t: Tables):
    found = correlation.corr_with_target(featured(t), FEATURES, TARGET)
    return found.withColumns({c: F.round(c, 6) for c in ("r", "abs_r")})


@query("corr_high_pairs", f"""
    SELECT feature_1, feature_2, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM ({_pairs_sql()}) AS p
    WHERE abs(r) >= 0.85""")
def corr_high_pairs(t: Tables):
    found = correlation.high_pairs(correlation.corr_pairs(featured(t), FEATURES))
    return found.select(
        "feature_1", "feature_2", F.round("r", 6).alias("r"), F.round("abs_r", 6).alias("abs_r")
    ).orderBy(F.desc("abs_r"))


@query("redundant_features", REDUNDANT_SQL)
def redundant_features(t: Tables):
    pairs = correlation.corr_pairs(featured(t), FEATURES, TARGET)
    return correlation.redundant_features(pairs, TARGET).orderBy("feature")


def _sparse_sql(columns) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 2) AS missing_percent FROM {RECORDS_SQL}"
        for c in columns) + ") AS m WHERE missing_percent >= 80"


@query("sparse_columns", _sparse_sql(["l_quantity", "tax_known", "tax_sparse", "l_returnflag"]))
def sparse(t: Tables):
    return sparse_columns(t.records(), 80.0, protect=[TARGET])


MANUAL = {"net_price": "follows from the price", "tax_sparse": "named by hand, but sparse comes first"}
LEDGER_COLUMNS = [*FEATURES, "l_linestatus"]


@query("removal_ledger", f"""
    WITH base AS (SELECT * FROM {CORR_SQL}), unioned AS (
        SELECT 'tax_sparse' AS feature, 0 AS stage_order, 'sparse' AS stage, 'missing percentage reaches 80' AS reason
        FROM base HAVING round(CAST(count(*) - count(tax_sparse) AS DOUBLE) / count(*) * 100, 2) >= 80
        UNION ALL SELECT 'net_price', 1, 'manual', 'follows from the price'
        UNION ALL SELECT 'tax_sparse', 1, 'manual', 'named by hand, but sparse comes first'
        UNION ALL SELECT feature, 2, 'redundant',
            'correlation with a kept column reaches 0.85, weaker relation to the target'
        FROM ({REDUNDANT_SQL} AND feature_1 NOT IN ('net_price', 'tax_sparse')
            AND feature_2 NOT IN ('net_price', 'tax_sparse')) AS r),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY stage_order) AS n FROM unioned),
    facts AS (""" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(CAST(count(*) - count({f}) AS DOUBLE) / count(*) * 100, 2) AS missing_percent, "
        + (f"CAST(NULL AS DOUBLE)" if f in MANUAL else f"round(abs(corr({f}, {TARGET})), 4)")
        + " AS target_abs_r FROM base" for f in FEATURES if f != TARGET) + """)
    SELECT feature, stage, reason, missing_percent, target_abs_r FROM firsts JOIN facts USING (feature) WHERE n = 1""")
def removal(t: Tables):
    return removal_ledger(featured(t).select(*LEDGER_COLUMNS), FEATURES, TARGET, MANUAL)


DROP_GROUPS = [
    DropGroup("identifiers", ("l_orderkey", "l_partkey", "l_suppkey", "l_loankey"), "identify the record"),
    DropGroup("pricing output", ("l_tax", "tax_known"), "set together with the price"),
    DropGroup("overlap", ("discount_n", "l_tax", "tax_sparse"), "repeat a kept column"),
]


@query("reduction_ledger", f"""
    WITH facts AS (SELECT count(*) AS row_count, count(*) - count(tax_known) AS known_missing,
        count(*) - count(tax_sparse) AS sparse_missing FROM {RECORDS_SQL})
    SELECT row_count, CAST(stage_no AS BIGINT) AS stage_no, stage, v."column", dropped, reason, CAST(CASE
        WHEN v."column" = 'l_loankey' THEN NULL WHEN v."column" = 'tax_known' THEN known_missing
        WHEN v."column" = 'tax_sparse' THEN sparse_missing ELSE 0 END AS BIGINT) AS missing_count,
        CAST(16 - sum(CASE WHEN dropped THEN 1 ELSE 0 END) OVER (ORDER BY stage_no) AS BIGINT) AS columns_left
    FROM facts, (VALUES
        (0, 'identifiers', 'l_orderkey', true, 'identify the record'),
        (0, 'identifiers', 'l_partkey', true, 'identify the record'),
        (0, 'identifiers', 'l_suppkey', true, 'identify the record'),
        (0, 'identifiers', 'l_loankey', false, 'identify the record'),
        (1, 'pricing output', 'l_tax', true, 'set together with the price'),
        (1, 'pricing output', 'tax_known', true, 'set together with the price'),
        (2, 'overlap', 'discount_n', true, 'repeat a kept column'),
        (2, 'overlap', 'l_tax', false, 'repeat a kept column'),
        (2, 'overlap', 'tax_sparse', true, 'repeat a kept column')
    ) AS v(stage_no, stage, "column", dropped, reason)""")
def reduction(t: Tables):
    return reduction_ledger(t.records(), DROP_GROUPS)
