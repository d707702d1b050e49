"""Pairwise correlations of many columns and the pick of redundant ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import quoted
from ..functions.stats import safe_corr


def corr_scalars(df: DataFrame, pairs: dict[str, tuple[str, str]], digits: int = 4) -> DataFrame:
    """Several correlations in one row, each over the rows where its two columns are present."""
    return df.agg(*[
        F.round(safe_corr(quoted(a), quoted(b)), digits).alias(name) for name, (a, b) in pairs.items()
    ])


#: Columns of a block, bytes of sums that a task holds before it hands them on, and rows from whose middle values the sums are taken.
BLOCK, HELD_BYTES, SHIFT_ROWS = 128, 256 << 20, 1000
MOMENTS = ["n", "odd", "sx", "sy", "sxx", "syy", "sxy"]


def pair_moments(
    df: DataFrame, numeric: Sequence[str], counted: Sequence[str] = (), block: int = BLOCK, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """(a, b, n, odd, sx, sy, sxx, syy, sxy) for a <= b, positions in ``numeric``: over the rows where both are present their number, how many hold a value that
    is not finite, and the sums of the other values, squares and products. The columns in ``counted`` follow with their present values as n of (a, a), and
    (-1, -1) has the number of all rows.

    A task multiplies blocks of columns as matrices, values and presence, batch by batch, and hands on one row per pair; Spark sums the
    pairs. If all pairs of a table with very many columns exceed ``held_bytes``, a task hands on the sums of every batch. Values are taken
    relative to the middle one of some rows of the column, which only spares digits.
    """
    k = len(numeric)
    names = [f"c{i}" for i in range(k)]
    numbers = [F.col(quoted(c)).cast("double").alias(n) for c, n in zip(numeric, names)]
    flags = [F.when(F.col(quoted(c)).isNotNull(), True).alias(f"f{i}") for i, c in enumerate(counted)]
    values = df.select(*numbers, *flags, F.lit(True).alias("row"))
    middle = values.limit(SHIFT_ROWS).agg(*[
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN isnan({n}) OR abs({n}) = double('Infinity') THEN NULL ELSE {n} END)").alias(n)
        for n in names]).first() if names else ()
    shifts = [float(x) if x is not None else 0.0 for x in middle]
    whole = k * k * 8 * len(MOMENTS) <= held_bytes
    starts, flagged = range(0, k, block), len(flags)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = {}

        def rows(i, j, sums):
            left, right = np.meshgrid(np.arange(i, min(i + block, k)), np.arange(j, min(j + block, k)), indexing="ij")
            upper = left <= right
            cells = [pa.array(c[upper].astype(np.int32)) for c in (left, right)] + [pa.array(c[upper]) for c in sums]
            return pa.RecordBatch.from_arrays(cells, ["a", "b", *MOMENTS])

        present = np.zeros(flagged + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            present += [batch.num_rows - c.null_count for c in batch.columns[k:]]
            if not k:
                continue
            batch = batch.select(names)
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            finite = np.isfinite(x)
            x = np.where(there & finite, x - shifts, 0.0)
            m, odd, squares = there.astype(float), (there & ~finite).astype(float), x * x
            for i in starts:
                for j in starts:
                    if j < i:
                        continue
                    p, q = slice(i, i + block), slice(j, j + block)
                    # a row counts for sums if both values are there and finite; the others are zero already
                    mp, mq = m[:, p] - odd[:, p], m[:, q] - odd[:, q]
                    n = m[:, p].T @ m[:, q]
                    sums = [n, n - mp.T @ mq, x[:, p].T @ mq, mp.T @ x[:, q], squares[:, p].T @ mq, mp.T @ squares[:, q], x[:, p].T @ x[:, q]]
                    if not whole:
                        yield rows(i, j, sums)
                    elif (i, j) in held:
                        for total, add in zip(held[i, j], sums):
                            total += add
                    else:
                        held[i, j] = sums
        for (i, j), sums in held.items():
            yield rows(i, j, sums)
        alone = pa.array(np.append(np.arange(k, k + flagged), -1).astype(np.int32))
        empty = pa.array(np.zeros(flagged + 1))
        yield pa.RecordBatch.from_arrays([alone, alone, pa.array(present), *[empty] * (len(MOMENTS) - 1)], ["a", "b", *MOMENTS])

    fields = ", ".join(["a int", "b int", *[f"{m} double" for m in MOMENTS]])
    return values.mapInArrow(run, fields).groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def moment_corr() -> Column:
    """Correlation from ``pair_moments``: null where either column is constant or nothing is shared, NaN where a value is not finite."""
    n = F.col("n")

    def varies(square: str, total: str) -> Column:
        spread = F.col(square) - F.col(total) * F.col(total) / n
        return F.when(spread > F.col(square) * 1e-13, spread)  # less is what rounding leaves of a constant

    together = F.col("sxy") - F.col("sx") * F.col("sy") / n
    r = together / F.sqrt(varies("sxx", "sx") * varies("syy", "sy"))
    return F.when(F.col("odd") > 0, F.lit(float("nan"))).when(
        (n > 0) & r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def pair_cells(df: DataFrame, numeric: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """One row with ``cells``, an array of (a, b, row_count, n, r) ordered by (a, b).

    a <= b are positions in ``numeric``; n counts the rows where both are present and r correlates them, so the cell
    (a, a) counts the present values of a column. The columns in ``counted`` follow with that last kind of cell only.

    One scan serves any number of pairs (see ``pair_moments``), the generated code does not grow with them and only
    (pair, moments) rows are shuffled.
    """
    pairs = pair_moments(df, numeric, counted)
    own = F.struct("a", "b", F.col("n").cast("long").alias("n"), moment_corr().alias("r"))
    # one element per pair of columns
    found = pairs.agg(
        F.sort_array(F.collect_list(F.when(F.col("a") >= 0, own))).alias("held"), F.max(F.when(F.col("a") < 0, F.col("n"))).alias("rows"))
    rows = F.col("rows").cast("long").alias("row_count")
    whole = F.transform("held", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), rows, c["n"].alias("n"), c["r"].alias("r")))
    return found.select(F.when(F.col("rows") > 0, whole).otherwise(F.slice(whole, 1, 0)).alias("cells"))


def cell(a: Column, b: Column, k: int) -> Column:
    """The element of ``cells`` for two positions in either order (row by row upper triangle of k columns)."""
    low, high = F.least(a, b), F.greatest(a, b)
    triangle = low * k - F.shiftright(low * (low - 1), 1) + high - low
    return F.get("cells", F.when(low < k, triangle).otherwise(k * (k + 1) // 2 + low - k).cast("int"))


def name_at(names: Sequence[str], position: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), position)


def corr_pairs(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """(feature_1, feature_2, r, target_r_1, target_r_2) for every unordered pair, in one scan.

    The two last columns are each feature's correlation with ``target`` (null without one).
    """
    columns = list(columns)
    names = columns if target is None or target in columns else [*columns, target]
    a, b, k = F.col("a"), F.col("b"), len(names)

    def target_r(position):
        if target is None:
            return F.lit(None).cast("double")
        at = F.lit(names.index(target))
        return F.when(position != at, cell(position, at, k)["r"])

    pairs = pair_cells(df, names).select("cells", F.inline("cells")).filter((a < b) & (b < len(columns)))
    return pairs.select(
        name_at(names, a).alias("feature_1"), name_at(names, b).alias("feature_2"), "r",
        target_r(a).alias("target_r_1"), target_r(b).alias("target_r_2"),
    )


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(feature, r, abs_r) strongest first; features without a defined correlation are left out."""
    features = [c for c in columns if c != target]
    values = F.array(*[F.col(quoted(f)).cast("double") for f in features])
    spread = df.select(values.alias("v"), F.col(quoted(target)).cast("double").alias("y")).select(
        "y", F.posexplode("v").alias("a", "x"))
    return (
        spread.groupBy("a").agg(safe_corr("x", "y").alias("r")).filter(F.col("r").isNotNull())
        .select(name_at(features, F.col("a")).alias("feature"), "r", F.abs("r").alias("abs_r"))
        .orderBy(F.desc("abs_r"), "feature")
    )


def high_pairs(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs whose absolute correlation reaches the threshold."""
    return pairs.withColumn("abs_r", F.abs("r")).filter(F.col("abs_r") >= threshold)


def weaker_of_pair(target: str) -> tuple[Column, Column]:
    """(is the pair eligible, the feature to drop) for rows of ``corr_pairs``.

    The feature less correlated with the target goes, the second one on a tie; no correlation counts as zero. Pairs
    are judged one by one: a feature already marked can still knock out another.
    """
    first = F.coalesce(F.abs("target_r_1"), F.lit(0.0))
    second = F.coalesce(F.abs("target_r_2"), F.lit(0.0))
    eligible = (F.col("feature_1") != target) & (F.col("feature_2") != target)
    return eligible, F.when(first >= second, F.col("feature_2")).otherwise(F.col("feature_1"))


def redundant_features(pairs: DataFrame, target: str, threshold: float = 0.85) -> DataFrame:
    """(feature): what ``weaker_of_pair`` marks among the high pairs. ``pairs`` comes from ``corr_pairs(target=...)``."""
    eligible, drop = weaker_of_pair(target)
    return high_pairs(pairs, threshold).filter(eligible).select(drop.alias("feature")).distinct()
