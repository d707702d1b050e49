"""Deduplication, types, imputation and the two modelling sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnGroups, FeatureTypes
from ..functions.outcomes import outcome
from ..functions.stats import missing
from .ordering import exact_quantiles
from .profiling import require_columns
from .temporal import date_features

UNKNOWN = "Unknown"


def dedup_rows(df: DataFrame) -> DataFrame:
    """One copy of each row. Copies are merged map-side, so a much repeated row does not load one task."""
    return df.dropDuplicates()


def dedup_counts(df: DataFrame) -> DataFrame:
    """(rows_before, rows_after, rows_removed) from a single grouping."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def medians(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """One row with the approximate median of every column, nulls and NaN left out, in one aggregate."""
    return df.agg(*[
        F.percentile_approx(F.when(~missing(c), F.col(c).cast("double")), 0.5, accuracy).alias(c) for c in columns
    ])


def _text(column: str, boolean: bool) -> Column:
    """Category text; a boolean reads "true" / "false" whatever its type, "Unknown" for null."""
    text = F.col(column).cast("string")
    if not boolean:
        return text
    flag = text.try_cast("boolean")
    return F.when(text.isNull(), UNKNOWN).otherwise(F.coalesce(flag.cast("string"), text))


def standardize_types(df: DataFrame, groups: ColumnGroups) -> DataFrame:
    """Numbers to double, categories to string, booleans to "true" / "false" / "Unknown"."""
    present = set(df.columns)
    return df.withColumns({
        **{c: F.col(c).try_cast("double") for c in (*groups.numeric, groups.target) if c in present},
        **{c: _text(c, boolean=False) for c in groups.categorical if c in present},
        **{c: _text(c, boolean=True) for c in groups.boolean if c in present},
    })


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns if c in df.columns
    })


def fill_values(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace null and NaN by the given value of each column."""
    return df.withColumns({
        c: F.when(missing(c), F.lit(float(v))).otherwise(F.col(c).cast("double"))
        for c, v in values.items() if c in df.columns
    })


@dataclass
class Preparer:
    """Date features, type standardisation and imputation, learnt on one frame and applied to others.

    Medians are learnt by ``fit`` (train rows only, if that is what it is given); ``transform`` is a projection and
    works on a stream. The target is not imputed unless ``impute_target`` asks for it.
    """

    groups: ColumnGroups
    date_parts: dict[str, str] = field(default_factory=dict)
    day_spans: dict[str, tuple[str, str]] = field(default_factory=dict)
    exact: bool = True
    impute_target: bool = False
    fill: dict[str, float] = field(default_factory=dict)

    def _typed(self, df: DataFrame) -> DataFrame:
        df = date_features(df, self.date_parts, self.day_spans, drop=self.groups.dates)
        return standardize_types(df, self.groups)

    def _numeric(self, df: DataFrame) -> list[str]:
        derived = [f"{p}_{part}" for p in self.date_parts for part in ("year", "month")] + list(self.day_spans)
        wanted = [*self.groups.numeric, *derived, *([self.groups.target] if self.impute_target else [])]
        return [c for c in dict.fromkeys(wanted) if c in df.columns and (self.impute_target or c != self.groups.target)]

    def features(self, df: DataFrame, more: Sequence[str] = ()) -> FeatureTypes:
        """The columns of a prepared frame that the groups name as features, and ``more`` numeric ones; a column that no group names, such as an identifier,
        is none."""
        return FeatureTypes(
            numeric=[*self._numeric(df), *[c for c in more if c in df.columns]],
            categorical=[c for c in (*self.groups.categorical, *self.groups.boolean) if c in df.columns])

    def fit(self, df: DataFrame) -> Preparer:
        typed = self._typed(df)
        columns = self._numeric(typed)
        if not columns:
            self.fill = {}
            return self
        if self.exact:
            found = {r["column"]: r["value"] for r in exact_quantiles(typed, columns).collect()}  # one per column
        else:
            found = medians(typed, columns).first().asDict()
        self.fill = {c: 0.0 if found.get(c) is None else found[c] for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        typed = self._typed(df)
        filled = fill_values(typed, {c: self.fill[c] for c in self._numeric(typed)})
        return fill_unknown(filled, [*self.groups.categorical, *self.groups.boolean])


def label_set(
    df: DataFrame, status: str, negative: Sequence[str], positive: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Resolved rows with an integer ``label`` (1 bad, 0 good), without status and ``exclude`` columns."""
    require_columns(df, [status])
    return (
        df.filter(F.col(status).isin(*negative, *positive))
        .withColumn("label", outcome(status, negative, positive).cast("int"))
        .drop(status, *exclude)
    )


def target_set(df: DataFrame, target: str, status: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose target is present and not NaN, without status and ``exclude`` columns."""
    require_columns(df, [target])
    return df.filter(~missing(target)).drop(*([status] if status else []), *exclude)
