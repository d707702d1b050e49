"""Aggregate and scalar expressions shared by the reports (all return a Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def mean(column: Column | str, digits: int | None = 2, null_as: float | None = None) -> Column:
    """Rounded average; ``null_as`` counts null rows with that value instead of leaving them out."""
    value = _col(column).cast("double")
    if null_as is not None:
        value = F.coalesce(value, F.lit(float(null_as)))
    return round_to(F.avg(value), digits)


def share_pct(flag: Column, digits: int | None = 2) -> Column:
    """Percent of all rows where ``flag`` is true; null counts as false."""
    return round_to(F.avg(F.when(flag, 1.0).otherwise(0.0)) * 100, digits)


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are present; null if either is constant there.

    ``corr`` itself raises a division error on a constant column in ANSI mode. ``regr_r2`` does not: it is null for a
    constant ``b`` and 1 for a constant ``a``, which the zero covariance tells apart from a perfect fit.
    """
    a, b = _col(a).cast("double"), _col(b).cast("double")
    squared, together = F.regr_r2(a, b), F.covar_pop(a, b)
    return F.when(~((squared == 1) & (together == 0)), F.signum(together) * F.sqrt(squared))


def missing(column: Column | str, dtype=None) -> Column:
    """True for null, and for NaN where the column is floating point."""
    column = _col(column)
    return column.isNull() | F.isnan(column.cast("double"))


def pct_error(actual: Column, predicted: Column) -> Column:
    """|error| / |actual|, null for a zero actual so that an average leaves the row out."""
    return F.try_divide(F.abs(actual - predicted), F.abs(actual))
