"""Order-dependent results (ranks, running totals, quantiles) without a single-task window.

The ordered rows are split into contiguous ranges with Spark's range partitioner, the window runs inside each
range, and what the ranges before it amount to is added. The range of each row is written out before it is
used twice, so both uses see the same split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def in_ranges(df: DataFrame, order_by: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """The rows dealt out in contiguous ranges of the order, numbered in ``_range``. They are written out, so every use sees the same split."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(ranges, *order_by).withColumn("_range", F.spark_partition_id()))


def running_before(
    df: DataFrame,
    order_by: Sequence[Column],
    sums: dict[str, str],
    by: Sequence[str] = (),
    ranges: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add, for each ``new: column`` in ``sums``, the sum of ``column`` over the rows ordered before this one, and for each in
    ``totals`` the sum over all rows of the group.

    ``df`` holds one row per (``by``, order value), i.e. it is already grouped, which also makes the ranges
    even whatever the skew of the raw rows. ``by`` columns are not null.
    """
    by = list(by)
    ranged = in_ranges(df, [*[F.col(c) for c in by], *order_by], ranges)
    # at most one row per range and group crossing it
    totals = totals or {}
    wanted = sorted({*sums.values(), *totals.values()})
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in wanted])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{new}") for new, c in sums.items()],
        *[F.sum(f"_t_{c}").over(group).alias(new) for new, c in totals.items()],
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(offsets, [*by, "_range"])
        .withColumns({
            new: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{new}") for new, c in sums.items()
        })
        .drop("_range", *[f"_o_{new}" for new in sums])
    )


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, values): for each of ``shares`` the smallest present value whose cumulative share reaches it, nulls and NaN left out.

    All columns are counted in one pass and all shares read from one ordering; a column without values gives no row.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    counts = (
        df.select(cells.alias("cell")).select("cell.*")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    placed = running_before(counts, [F.col("value")], {"before": "n"}, by=["column"], totals={"total": "n"})
    here = F.col("before") + F.col("n")
    reached = [F.min(F.when(here >= F.ceil(F.col("total") * F.lit(q)), F.col("value"))) for q in shares]
    return placed.groupBy("column").agg(F.array(*reached).alias("values"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5) -> DataFrame:
    """(column, value): the smallest present value whose cumulative share reaches ``q``; see ``quantile_table``."""
    return quantile_table(df, columns, [q]).select("column", F.col("values")[0].alias("value"))


def previous_row(df: DataFrame, by: Sequence[str], order_by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, for each ``new: value``, the value of the row before this one in its group ``by``; null for the first.

    The rows are ordered by group and ``order_by`` together, so the row before is found inside the range or is the last row of the
    range before it: one row per range is carried over the borders, of ranges and of groups, and no group has a task to itself. Rows that
    tie in ``order_by`` stand in any order.
    """
    position = F.struct(*by, *order_by)
    held = in_ranges(df.withColumn("_own", F.struct(F.struct(*by).alias("group"), *[v.alias(n) for n, v in values.items()])),
                     [F.col(c) for c in (*by, *order_by)])
    last = held.groupBy("_range").agg(F.max_by("_own", position).alias("_carried"))
    last = last.select(F.lead("_range").over(Window.partitionBy().orderBy("_range")).alias("_range"), "_carried")
    inside = Window.partitionBy("_range").orderBy(position)
    before = F.coalesce(F.lag("_own").over(inside), F.col("_carried"))
    found = held.join(last, "_range", "left").withColumn("_before", before)
    same = F.col("_before.group").eqNullSafe(F.col("_own.group"))
    return found.select(*df.columns, *[F.when(same, F.col("_before")[name]).alias(name) for name in values])


def dense_ranks(df: DataFrame, ranks: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """Add ``dense_rank`` columns, highest value first, null last.

    ``ranks`` maps the new column to the ranked expression; with ``within`` the rank restarts per group. Each row is placed once per rank, all
    ranks in one ordering, and ranked inside its range; the numbers of distinct values of the ranges before are added. Ties are ordered
    by a hash of the row, so a value that a third of the rows share is spread over ranges too; where a value crosses
    a border it is counted once.
    """
    kept = [c for c in df.columns if c not in ranks]
    types = [f.dataType for f in df.select(*[v.alias(n) for n, v in ranks.items()]).schema]
    slots = {t.simpleString(): (f"_v{i}", t) for i, t in enumerate(types)}  # one value column per type
    cells = F.array(*[F.struct(F.lit(i).alias("_rank"), *[
        (value if t == own else F.lit(None).cast(t)).alias(slot) for slot, t in slots.values()
    ]) for i, (value, own) in enumerate(zip(ranks.values(), types))])
    group = F.to_json(F.struct(*within)) if within else F.lit("")
    placed = df.withColumns({"_group": group, "_cells": cells}).select(*kept, "_group", F.inline("_cells"))
    values = [slot for slot, _ in slots.values()]
    highest = [F.col(v).desc() for v in values]
    placed = in_ranges(placed.withColumn("_tie", F.xxhash64(*kept)), ["_rank", "_group", *highest, "_tie"])

    value, series = F.struct(*values), Window.partitionBy("_rank", "_group").orderBy("_range")
    found = placed.groupBy("_range", "_rank", "_group").agg(
        F.count_distinct(value).alias("_n"), F.max(value).alias("_first"), F.min(value).alias("_last"))
    crossed = F.coalesce((F.col("_first") == F.lag("_last").over(series)).cast("long"), F.lit(0))
    earlier = F.sum(F.col("_n") - F.col("_crossed")).over(series.rowsBetween(Window.unboundedPreceding, -1))
    offsets = found.withColumn("_crossed", crossed).select(
        "_range", "_rank", "_group", (F.coalesce(earlier, F.lit(0)) - F.col("_crossed")).alias("_offset"))
    inside = Window.partitionBy("_range", "_rank", "_group").orderBy(*highest)
    ranked = placed.join(offsets, ["_range", "_rank", "_group"]).withColumn("_dense", (F.dense_rank().over(inside) + F.col("_offset")).cast("long"))
    if len(ranks) == 1:
        return ranked.select(*kept, F.col("_dense").alias(next(iter(ranks))))
    together = ranked.groupBy(*kept).agg(
        *[F.max(F.when(F.col("_rank") == i, F.col("_dense"))).alias(name) for i, name in enumerate(ranks)],
        F.count_if(F.col("_rank") == 0).alias("_copies"))
    return together.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")
