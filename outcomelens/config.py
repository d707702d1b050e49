"""Which columns of a record table play which role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnGroups:
    """Column roles of one dataset; names absent from a frame are skipped and can be listed."""

    status: str
    target: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()

    def missing_from(self, df: DataFrame) -> list[str]:
        named = (self.status, self.target, *self.numeric, *self.categorical, *self.boolean, *self.dates)
        return [name for name in named if name not in df.columns]


@dataclass(frozen=True)
class DropGroup:
    """One domain-reduction stage: columns that leave together, and why."""

    stage: str
    columns: tuple[str, ...]
    reason: str = ""


@dataclass(frozen=True)
class FeatureTypes:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def feature_types(df: DataFrame, exclude: tuple[str, ...] | set[str] = ()) -> FeatureTypes:
    """Numeric and categorical (string or boolean) columns by type, in schema order."""
    skipped = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in skipped]
    return FeatureTypes(
        numeric=[f.name for f in fields if isinstance(f.dataType, T.NumericType)],
        categorical=[f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))],
    )


def quoted(name: str) -> str:
    """Column reference for names with spaces, dots or parentheses."""
    return "`" + name.replace("`", "``") + "`"
