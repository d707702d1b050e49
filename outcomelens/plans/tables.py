"""The test tables in the roles of a record table.

``lineitem`` rows are the records: ``l_returnflag`` is the status (R bad, A good, N unresolved), ``l_extendedprice`` the
price and regression target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outcome

STATUS, NEGATIVE, POSITIVE = "l_returnflag", ["R"], ["A"]
TARGET = "l_extendedprice"
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

BAD_SQL = (
    "CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) WHEN l_returnflag = 'A' THEN CAST(0 AS DOUBLE) END"
)
BUCKET_SQL = (
    "CAST(('0x' || substr(md5(concat_ws('-', '', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8)) AS BIGINT)"
)
WIDE_SQL = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def bad() -> Column:
    return outcome(STATUS, NEGATIVE, POSITIVE)


class Tables:
    """Parquet tables of one scale-factor directory, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @property
    def customer(self) -> DataFrame:
        return self.read("customer")

    def records(self) -> DataFrame:
        """lineitem with derived measures: counts, a sparse tax, a nullable tax and a home-made boolean."""
        return self.lineitem.withColumns({
            "discount_n": F.round(F.col("l_discount") * 100).cast("int"),
            "tax_n": F.round(F.col("l_tax") * 100).cast("int"),
            "tax_known": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "tax_sparse": F.when(F.col("l_discount") > 0.08, F.col("l_tax")),
            "is_final": F.col("l_linestatus") == "F",
        })

    def wide(self) -> DataFrame:
        """Records with their order and customer. The planner picks the join from the table sizes: broadcast under
        its threshold, else sort-merge with skewed partitions split at run time."""
        return (
            self.records()
            .join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        )


RECORDS_SQL = """(SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS discount_n,
    CAST(round(l_tax * 100) AS INTEGER) AS tax_n, nullif(l_tax, CAST(0 AS DOUBLE)) AS tax_known,
    CASE WHEN l_discount > CAST(0.08 AS DOUBLE) THEN l_tax END AS tax_sparse, l_linestatus = 'F' AS is_final
    FROM lineitem)"""
