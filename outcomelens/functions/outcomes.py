"""Outcome of a record from its status text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(status: Column | str, negative: Sequence[str], positive: Sequence[str]) -> Column:
    """1.0 for a negative status, 0.0 for a positive one, null while unresolved.

    A double on purpose: averaging a decimal literal would round the rate to five places first.
    """
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status.isin(*negative), F.lit(1.0)).when(status.isin(*positive), F.lit(0.0))


def outcome_group(
    status: Column | str,
    negative: Sequence[str],
    positive: Sequence[str],
    names: tuple[str, str, str] = ("Good", "Bad", "Other"),
) -> Column:
    """Three-way label: positive, negative, or everything else (null included)."""
    status = F.col(status) if isinstance(status, str) else status
    good, bad, other = names
    return F.when(status.isin(*positive), good).when(status.isin(*negative), bad).otherwise(other)
