"""Segment reports: how many records, at what mean price and bad rate, per combination of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import quoted
from ..functions.bands import Band
from ..functions.stats import round_to
from ..session import settle

Key = "Column | str | tuple[Band, str]"


def key_column(key) -> Column:
    if isinstance(key, tuple):
        band, source = key
        return band.of(source)
    return F.col(key) if isinstance(key, str) else key


def bad_rate_pct(outcome: Column, digits: int = 2) -> Column:
    """Bad share of the resolved rows in percent; null when none is resolved."""
    return round_to(F.avg(outcome) * 100, digits)


def bad_rate_all(status: str, negative: Sequence[str], digits: int = 4) -> Column:
    """Bad share of all rows: unresolved rows count as not bad."""
    return round_to(F.avg(F.when(F.col(status).isin(*negative), 1.0).otherwise(0.0)), digits)


def _present(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(quoted(c)).isNotNull()
    return test


def segment_report(
    df: DataFrame,
    keys: dict,
    measures: dict[str, Column],
    require: Sequence[str] = (),
    min_rows: int = 0,
    count_as: str = "total_rows",
    correlations: dict[str, tuple[str, str]] | None = None,
    digits: int = 4,
) -> DataFrame:
    """One row per key combination with its row count and measures.

    ``keys`` maps output names to a column, or to ``(Band, source column)``. Rows with a null in ``require`` are
    left out; segments below ``min_rows`` too. ``correlations`` (name -> pair) attaches correlations over the *whole*
    table to each row. They come from the same scan: each segment has its moments, which are merged over all segments and the rows left out;
    only the grouped rows are written out and read twice.
    """
    columns = {name: key_column(key) for name, key in keys.items()}
    total = F.count("*").alias(count_as)
    inside = _present(require)
    if not correlations:
        rows = df.filter(inside) if require else df
        report = rows.groupBy(*[c.alias(name) for name, c in columns.items()]).agg(
            total, *[m.alias(name) for name, m in measures.items()])
        return report.filter(F.col(count_as) >= min_rows) if min_rows else report
    # rows outside the filter are one more group: they count for the correlations only
    grouped = settle(df.groupBy(
        inside.alias("_inside"), *[F.when(inside, c).alias(name) for name, c in columns.items()]
    ).agg(total, *[m.alias(name) for name, m in measures.items()], *[
        moments(a, b).alias(f"_m{i}") for i, (a, b) in enumerate(correlations.values())]))
    names = [*columns, count_as, *measures]
    middle = grouped.agg(F.struct(*[merged_means(f"_m{i}").alias(f"_m{i}") for i in range(len(correlations))]).alias("c"))
    whole = grouped.withColumn("_middle", middle.scalar()).agg(F.struct(*[
        round_to(merged_corr(f"_m{i}", F.col("_middle")[f"_m{i}"]), digits).alias(name) for i, name in enumerate(correlations)]).alias("c"))
    report = grouped.filter(F.col("_inside") & (F.col(count_as) >= min_rows)).select(*names)
    return report.withColumn("_whole", whole.scalar()).select(*names, *[F.col("_whole")[name].alias(name) for name in correlations])


def moments(a: str, b: str) -> Column:
    """Rows where both are present, their means and squared and joint deviations: what ``merged_corr`` needs of a group."""
    x, y = F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")
    return F.struct(
        F.regr_count(x, y).alias("n"), F.regr_avgx(y, x).alias("x"), F.regr_avgy(y, x).alias("y"), F.regr_sxx(y, x).alias("xx"),
        F.regr_syy(y, x).alias("yy"), F.regr_sxy(y, x).alias("xy"))


def merged_means(group: str) -> Column:
    n = F.sum(F.col(group)["n"])
    return F.struct(*[F.try_divide(F.sum(F.col(group)["n"] * F.col(group)[c]), n).alias(c) for c in "xy"])


def merged_corr(group: str, middle: Column) -> Column:
    """Correlation over all groups from their ``moments``: deviations inside the groups and of their means from ``middle``, the mean of all. Null if
    either column is constant."""
    of = {name: F.col(group)[name] for name in ("n", "x", "y", "xx", "yy", "xy")}

    def spread(inside: str, left: str, right: str) -> Column:
        return F.sum(of[inside] + of["n"] * (of[left] - middle[left]) * (of[right] - middle[right]))

    xx, yy, xy = spread("xx", "x", "x"), spread("yy", "y", "y"), spread("xy", "x", "y")
    # less than this share of the squares is what rounding leaves of a constant
    varies = (xx > 1e-24 * F.sum(of["n"] * of["x"] * of["x"])) & (yy > 1e-24 * F.sum(of["n"] * of["y"] * of["y"])) & (xx > 0) & (yy > 0)
    r = xy / F.sqrt(F.when(varies, xx)) / F.sqrt(F.when(varies, yy))
    return F.when(varies, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
