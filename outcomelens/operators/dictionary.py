"""Categories as numbers by a dictionary that is a table: a column may have any number of values, none of them passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import quoted
from .ordering import running_before


def fit_dictionary(df: DataFrame, columns: Sequence[str], most: int | None = None, min_rows: int = 1) -> DataFrame:
    """(column, value, slot, n): the values of each column, most frequent first, ties by value; slots begin at 0.

    All columns are counted in one pass and ordered together by ``running_before``. Values that come in fewer than ``min_rows`` rows,
    and those after the first ``most``, are not in it; nulls never are.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("cell")).select("cell.*").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = running_before(
        counts.where(F.col("n") >= min_rows).withColumn("_one", F.lit(1)), [F.col("n").desc(), F.col("value")], {"slot": "_one"}, by=["column"])
    found = placed.select("column", "value", F.col("slot").cast("long").alias("slot"), "n")
    return found if most is None else found.where(F.col("slot") < most)


def dictionary_sizes(dictionary: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of slots of each column: one row per column."""
    sizes = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c: sizes.get(c, 0) for c in columns}


def index_columns(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], overflow: Column | str | None = None, suffix: str = "_slot") -> DataFrame:
    """``df`` with ``<column>_slot`` for each column.

    A value that the dictionary lacks, too rare, beyond the first ``most`` or never seen, and a null get the slot after the last one (the overflow slot), or
    ``overflow`` if given. The planner broadcasts a small dictionary; a large one is joined by sort-merge, where the partition of a value that a third of the
    rows have is split at run time.
    """
    sizes = dictionary_sizes(dictionary, columns) if overflow is None else {}
    for c in columns:
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("slot").alias("_slot"))
        beyond = F.lit(sizes[c]).cast("long") if overflow is None else overflow
        df = df.join(own, F.col(quoted(c)).cast("string") == F.col("_value"), "left").withColumn(
            f"{c}{suffix}", F.coalesce("_slot", beyond)).drop("_value", "_slot")
    return df
