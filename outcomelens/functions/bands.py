"""Ordered first-match banding of a numeric column."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cut:
    compare: object
    bound: float
    label: str


def lt(bound, label):
    return Cut(operator.lt, bound, label)


def le(bound, label):
    return Cut(operator.le, bound, label)


def eq(bound, label):
    return Cut(operator.eq, bound, label)


def ge(bound, label):
    return Cut(operator.ge, bound, label)


@dataclass(frozen=True)
class Band:
    """Cuts are tried in order, the first that holds names the band, ``otherwise`` takes the rest.

    A null value falls into ``otherwise``; filter it before, or give ``null_as`` to read it as a number.
    """

    cuts: tuple[Cut, ...]
    otherwise: str
    null_as: float | None = None

    @property
    def labels(self) -> list[str]:
        return [*dict.fromkeys([*(c.label for c in self.cuts), self.otherwise])]

    def of(self, column: Column | str) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        if self.null_as is not None:
            value = F.coalesce(value, F.lit(self.null_as))
        first, *rest = self.cuts
        chain = F.when(first.compare(value, F.lit(first.bound)), first.label)
        for cut in rest:
            chain = chain.when(cut.compare(value, F.lit(cut.bound)), cut.label)
        return chain.otherwise(self.otherwise)
