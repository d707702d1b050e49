"""Bit fields of fixed size that sort out, where rows lie, those that a join could concern: only these are shuffled.

A field of a column of hashes is built by Spark, merged per 64 bits, and sent to the tasks. Its size does not grow with the data. A
row whose bit is set by another hash only takes the way of the join in vain; a row that belongs to the join is never missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import ship
from .collocations import Field

BITS = 1 << 25


def hashed_field(df: DataFrame, name: Column, bits: int = BITS) -> Field:
    """Field of the 64-bit hashes ``name``; at most ``bits`` / 64 rows reach the driver."""
    at = F.shiftrightunsigned(name, 64 - (bits.bit_length() - 1))
    merged = df.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("bit")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[merged["word"].to_numpy()] = merged["bit"].to_numpy().view(np.uint64)
    return Field(words)


def held(df: DataFrame, field: Field, name: Column) -> Column:
    """Whether the field may hold the hash; only the hash goes to the Python side, the row stays."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def test(names: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(names.to_numpy().view(np.uint64)))

    return test(name)
