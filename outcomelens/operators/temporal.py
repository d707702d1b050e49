"""Date features and quarter-over-quarter change of segment reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import previous_row


def as_date(column: str, dtype: str | None = None) -> Column:
    """Date of a date, timestamp or text column; unreadable text becomes null."""
    return F.try_to_date(F.col(column)) if dtype == "string" else F.to_date(F.col(column))


def date_features(
    df: DataFrame,
    parts: dict[str, str],
    day_spans: dict[str, tuple[str, str]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Numeric features from dates, then drop the raw dates.

    ``parts`` maps a prefix to a date column and gives ``<prefix>_year`` and ``<prefix>_month``; ``day_spans`` maps a
    name to (later, earlier) and gives the days between. Features of absent columns are skipped.
    """
    types = dict(df.dtypes)
    new: dict[str, Column] = {}
    for prefix, column in parts.items():
        if column in types:
            day = as_date(column, types[column])
            new[f"{prefix}_year"] = F.year(day)
            new[f"{prefix}_month"] = F.month(day)
    for name, (later, earlier) in day_spans.items():
        if later in types and earlier in types:
            new[name] = F.datediff(as_date(later, types[later]), as_date(earlier, types[earlier]))
    return df.withColumns(new).drop(*[c for c in drop if c in types]) if new else df.drop(*drop)


def quarter_keys(column: str) -> dict[str, Column]:
    return {"year": F.year(column).cast("long"), "quarter": F.quarter(column).cast("long")}


def quarter_change(
    report: DataFrame,
    measure: str,
    by: Sequence[str],
    year: str = "year",
    quarter: str = "quarter",
    digits: int = 4,
    calendar: bool = False,
) -> DataFrame:
    """Add the measure of the previous quarter in the same group, and the difference.

    "Previous" is the previous quarter *present* in the report. With ``calendar`` it is the quarter right before,
    and null where that one is absent. See ``previous_row``: a group may have any number of quarters.
    """
    index = F.col(year) * 4 + F.col(quarter)
    found = previous_row(report, by, [year, quarter], {"_measure": F.col(measure), "_index": index})
    previous = F.when(F.col("_index") == index - 1, F.col("_measure")) if calendar else F.col("_measure")
    return found.withColumn(f"prev_{measure}", previous).withColumn(
        f"{measure}_change", F.round(F.col(measure) - F.col(f"prev_{measure}"), digits)
    ).drop("_measure", "_index")
