"""Shape, missing values, distributions and summaries of a table, one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import quoted


def shape(df: DataFrame, min_rows: int = 100_000, min_columns: int = 10) -> DataFrame:
    """Row and column count, each against its threshold, and the joint verdict."""
    columns = len(df.columns)
    rows = F.col("row_count")
    return df.agg(F.count("*").alias("row_count")).select(
        rows,
        F.lit(columns).cast("long").alias("column_count"),
        (rows > min_rows).alias("enough_rows"),
        F.lit(columns > min_columns).alias("enough_columns"),
        ((rows > min_rows) & F.lit(columns > min_columns)).alias("accepted"),
    )


def _per_column(df: DataFrame, columns: Sequence[str], cells) -> DataFrame:
    """Turn one wide aggregate row into one row per column."""
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def missing_summary(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, data_type, missing_count, present_count, missing_percent) for every column in one scan."""
    types = {c: t for c, t in df.dtypes if c not in set(exclude)}
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count(F.col(quoted(c))).alias(f"_p{i}") for i, c in enumerate(types)],
    )
    rows = F.col("_rows")
    return _per_column(counts, list(types), [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("data_type"),
            (rows - F.col(f"_p{i}")).alias("missing_count"),
            F.col(f"_p{i}").alias("present_count"),
            F.coalesce(
                F.round(F.try_divide(rows - F.col(f"_p{i}"), rows) * 100, 2), F.lit(0.0)
            ).alias("missing_percent"),
        )
        for i, (c, t) in enumerate(types.items())
    ])


def missing_top(df: DataFrame, n: int, exclude: Sequence[str] = ()) -> DataFrame:
    """The ``n`` columns with most nulls; equal counts by name."""
    return missing_summary(df, exclude).orderBy(F.desc("missing_count"), "column").limit(n)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")


def required_column_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN violations per required column; an absent column raises."""
    require_columns(df, columns)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    counts = df.agg(F.count("*").alias("_rows"), *[
        x for i, c in enumerate(columns) for x in (
            F.count(F.col(quoted(c))).alias(f"_p{i}"),
            (F.count_if(F.isnan(F.col(quoted(c)))) if c in floating else F.lit(0).cast("long")).alias(f"_n{i}"),
        )
    ])
    return _per_column(counts, columns, [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col(f"_p{i}")).alias("null_count"),
            F.col(f"_n{i}").alias("nan_count"),
            ((F.col("_rows") == F.col(f"_p{i}")) & (F.col(f"_n{i}") == 0)).alias("complete"),
        )
        for i, c in enumerate(columns)
    ])


def target_summary(df: DataFrame, target: str, digits: int = 6) -> DataFrame:
    """Count, mean, min, max and sample deviation of the target."""
    x = F.col(target).cast("double")
    return df.agg(
        F.count(x).alias("row_count"),
        F.round(F.avg(x), digits).alias("target_mean"),
        F.round(F.min(x), digits).alias("target_min"),
        F.round(F.max(x), digits).alias("target_max"),
        F.round(F.stddev_samp(x), digits).alias("target_stddev"),
    ).select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(target).alias("target"),
        "target_mean", "target_min", "target_max", "target_stddev",
    )


def histogram(df: DataFrame, column: Column | str, bins: int) -> DataFrame:
    """(bin, bin_start, bin_end, n) over all rows, equal widths from the minimum to the maximum.

    The maximum belongs to the last bin. Empty bins give no row; a constant column has bin 1 only.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    span = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    lo, hi = F.col("_s")["lo"], F.col("_s")["hi"]
    width = (hi - lo) / bins
    slot = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - lo, width)) + 1, F.lit(1)), F.lit(bins))
    binned = values.withColumn("_s", span).groupBy(slot.cast("long").alias("bin"), lo.alias("lo"), width.alias("w"))
    return binned.agg(F.count("*").alias("n")).select(
        "bin",
        F.round(F.col("lo") + F.col("w") * (F.col("bin") - 1), 6).alias("bin_start"),
        F.round(F.col("lo") + F.col("w") * F.col("bin"), 6).alias("bin_end"),
        "n",
    )


# --- distributions -------------------------------------------------------------------------------------------------

def distribution(df: DataFrame, value: Column | str, name: str, with_percent: bool = False) -> DataFrame:
    """(name, n[, percent]) per distinct value.

    The percentage divides by a scalar subquery over the grouped rows, so no window gathers all values in one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    counts = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    if not with_percent:
        return counts
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") / total * 100, 2))


def ordinal_distribution(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts with the position of each value in ``order``; values outside it (and null) come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    known = F.when(position > 0, position).otherwise(F.lit(len(order) + 1))
    return distribution(df, column, column).withColumn("position", known.cast("long")).orderBy("position", column)


def nulls_last_distribution(df: DataFrame, column: str, label: str = "Missing") -> DataFrame:
    """Counts in value order, the null group last and named ``label``."""
    return (
        distribution(df, column, "_v")
        .orderBy(F.col("_v").asc_nulls_last())
        .select(F.coalesce(F.col("_v").cast("string"), F.lit(label)).alias(column), "n")
    )
