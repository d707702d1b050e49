"""Column reduction with a ledger that says which column left, at which stage and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DropGroup, quoted
from .correlation import cell, name_at, pair_cells
from .profiling import missing_summary

SPARSE, MANUAL, REDUNDANT = "sparse", "manual", "redundant"


def drop_present(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Drop the listed columns that exist; returns the frame, what was dropped and what was not there."""
    dropped = [c for c in columns if c in df.columns]
    skipped = [c for c in columns if c not in df.columns]
    return df.drop(*dropped), dropped, skipped


def sparse_columns(
    df: DataFrame, threshold: float = 80.0, protect: Sequence[str] = (), candidates: Sequence[str] | None = None
) -> DataFrame:
    """(column, missing_percent) of columns whose missing percentage reaches the threshold."""
    summary = missing_summary(df, exclude=protect).filter(F.col("missing_percent") >= threshold)
    if candidates is not None:
        summary = summary.filter(F.col("column").isin(*candidates))
    return summary.select("column", "missing_count", "missing_percent")


def reduction_ledger(df: DataFrame, groups: Sequence[DropGroup]) -> DataFrame:
    """One row per column named by the domain groups: dropped or skipped, null share and columns left.

    ``columns_left`` is the number of columns after the stage; a column is dropped by the first stage naming it.
    The missing counts of all named columns come from one aggregate over the data.
    """
    present = set(df.columns)
    cells, seen = [], set()
    named = list(dict.fromkeys(c for g in groups for c in g.columns if c in present))
    place = {c: f"_m{i}" for i, c in enumerate(named)}
    for number, group in enumerate(groups):
        for column in group.columns:
            dropped = column in present and column not in seen
            seen.add(column)
            cells.append(F.struct(
                F.lit(number).cast("long").alias("stage_no"), F.lit(group.stage).alias("stage"),
                F.lit(column).alias("column"), F.lit(dropped).alias("dropped"), F.lit(group.reason).alias("reason"),
                (F.col(place[column]) if column in place else F.lit(None).cast("long")).alias("missing_count"),
            ))
    facts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(quoted(c)).isNull()).alias(p) for c, p in place.items()]
    )
    rows = facts.select("_rows", F.explode(F.array(*cells)).alias("c")).select(F.col("_rows").alias("row_count"), "c.*")
    until = Window.partitionBy().orderBy("stage_no").rangeBetween(Window.unboundedPreceding, 0)  # named columns only
    removed = F.sum(F.col("dropped").cast("int")).over(until)
    return rows.withColumn("columns_left", F.lit(len(df.columns)) - removed)


def removal_ledger(
    df: DataFrame,
    numeric: Sequence[str],
    target: str,
    manual: dict[str, str],
    protect: Sequence[str] = (),
    sparse_threshold: float = 80.0,
    corr_threshold: float = 0.85,
) -> DataFrame:
    """(feature, stage, reason, missing_percent, target_abs_r): sparse, then manual, then redundant columns.

    A column keeps its first reason. Redundancy is judged among the numeric columns that are neither sparse nor
    removed by hand, pair by pair as in ``weaker_of_pair``. The whole ledger is read off one scan of the data.
    """
    candidates = [c for c in df.columns if c not in {target, *protect}]
    numeric = [c for c in numeric if c in candidates and c not in manual]
    names = [*numeric, target]
    k = len(names)
    names += [c for c in candidates if c not in numeric]
    by_hand = [c for c in candidates if c in manual]
    a, b, at_target = F.col("a"), F.col("b"), F.lit(k - 1)

    def missing_percent(position):
        own = cell(position, position, k)
        return F.round(F.try_divide(own["row_count"] - own["n"], own["row_count"]) * 100, 2)

    def target_r(position):
        return F.when(position < k - 1, F.coalesce(F.abs(cell(position, at_target, k)["r"]), F.lit(0.0)))

    cells = pair_cells(df, names[:k], names[k:]).select("cells", F.inline("cells")).filter(
        (a != k - 1) & (b != k - 1)
    ).withColumns({"missing_1": missing_percent(a), "missing_2": missing_percent(b),
                   "target_1": target_r(a), "target_2": target_r(b)})
    own, name = a == b, name_at(names, a)
    drop_second = F.col("target_1") >= F.col("target_2")
    dense = (F.col("missing_1") < sparse_threshold) & (F.col("missing_2") < sparse_threshold)
    high = ~own & dense & (F.abs("r") >= corr_threshold)

    def removal(stage_order, stage, reason, second=F.lit(False)):
        return F.struct(
            F.lit(stage_order).alias("stage_order"), F.lit(stage).alias("stage"),
            F.when(second, name_at(names, b)).otherwise(name).alias("feature"), reason.alias("reason"),
            F.when(second, F.col("missing_2")).otherwise(F.col("missing_1")).alias("missing_percent"),
            F.round(F.when(second, F.col("target_2")).otherwise(F.col("target_1")), 4).alias("target_abs_r"),
        )

    found = cells.select(F.inline(F.array_compact(F.array(
        F.when(own & (F.col("missing_1") >= sparse_threshold), removal(
            0, SPARSE, F.lit(f"missing percentage reaches {sparse_threshold:g}"))),
        F.when(own & name.isin(*by_hand), removal(
            1, MANUAL, F.get(F.array(*[F.lit(manual[c]) for c in by_hand]), F.array_position(
                F.array(*[F.lit(c) for c in by_hand]), name).cast("int") - 1))) if by_hand else F.lit(None),
        F.when(high, removal(2, REDUNDANT, F.lit(
            f"correlation with a kept column reaches {corr_threshold:g}, weaker relation to the target"), drop_second)),
    ))))
    first = Window.partitionBy("feature").orderBy("stage_order")  # at most one row per stage and partner column
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "stage_order")


@dataclass(frozen=True)
class Reduction:
    """A ledger turned into a drop list, applicable to any frame with these columns."""

    removed: tuple[str, ...]

    @classmethod
    def fit(cls, ledger: DataFrame) -> Reduction:
        return cls(tuple(r["feature"] for r in ledger.select("feature").collect()))  # names of columns only

    def transform(self, df: DataFrame) -> DataFrame:
        return drop_present(df, self.removed)[0]
