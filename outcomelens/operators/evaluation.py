"""Classification and regression metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import Band
from ..functions.stats import pct_error
from .ordering import running_before


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one row (per ``by``), zero where a cell is empty."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(cells: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, f1, weighted precision / recall and bad-class precision / recall from confusion cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def f1(precision, recall):
        return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    bad_p, bad_r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    good_p, good_r = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    bad_w, good_w = _ratio(tp + fn, n), _ratio(tn + fp, n)
    metrics = {
        "accuracy": _ratio(tp + tn, n),
        "f1": bad_w * f1(bad_p, bad_r) + good_w * f1(good_p, good_r),
        "weighted_precision": bad_w * bad_p + good_w * good_p,
        "weighted_recall": bad_w * bad_r + good_w * good_r,
        "bad_precision": bad_p,
        "bad_recall": bad_r,
    }
    return cells.select(
        *[c for c in cells.columns], *[F.round(m, digits).alias(name) for name, m in metrics.items()]
    )


def exact_auc(df: DataFrame, label: str, score: Column | str, digits: int = 6) -> DataFrame:
    """Exact ROC-AUC (ties count half) and PR-AUC (trapezoids between distinct thresholds) in one row.

    Rows are first merged per distinct score; the running totals over the scores are distributed.
    """
    score = F.col(score) if isinstance(score, str) else score
    per_score = df.groupBy(score.cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    placed = running_before(per_score, [F.col("score").desc()], {"tp0": "pos", "fp0": "neg"})
    pos, neg, tp0, fp0 = (F.col(c).cast("double") for c in ("pos", "neg", "tp0", "fp0"))
    here = F.try_divide(tp0 + pos, tp0 + pos + fp0 + neg)
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), here)
    sums = placed.agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        F.sum(pos * (fp0 + neg / 2)).alias("lost"), F.sum(pos * (here + before) / 2).alias("area"),
    )
    return sums.select(
        F.round(1 - F.try_divide(F.col("lost"), F.col("p") * F.col("n")), digits).alias("roc_auc"),
        F.round(F.try_divide(F.col("area"), F.col("p")), digits).alias("pr_auc"),
    )


def regression_metrics(
    df: DataFrame, target: str, prediction: Column | str = "prediction", digits: int = 6, by: Sequence[str] = ()
) -> DataFrame:
    """rmse, mae, r2, mape in one row (per ``by``).

    Rows with a zero target have no percentage error: they are left out of ``mape`` and counted apart.
    """
    y = F.col(target).cast("double")
    p = (F.col(prediction) if isinstance(prediction, str) else prediction).cast("double")
    error = y - p
    scored = y.isNotNull() & p.isNotNull()
    sse = F.sum(error * error)
    sst = F.var_pop(F.when(scored, y)) * F.count(error)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.round(F.sqrt(F.avg(error * error)), digits).alias("rmse"),
        F.round(F.avg(F.abs(error)), digits).alias("mae"),
        F.round(1 - F.try_divide(sse, sst), digits).alias("r2"),
        F.round(F.avg(pct_error(y, p)), digits).alias("mape"),
        F.count_if(scored & (y == 0)).alias("zero_targets"),
    )


def with_mean_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Test rows with the train mean of the target as ``prediction`` (a one-value subquery, no join)."""
    return test.withColumn("prediction", train.agg(F.avg(F.col(target).cast("double")).alias("m")).scalar())


def error_by_band(df: DataFrame, target: str, band: Band, prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """(band, n, mae, mape) over bands of the actual value."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(band.of(target).alias("band")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(y - p)), digits).alias("mae"),
        F.round(F.avg(pct_error(y, p)), digits).alias("mape"),
    )


def residuals(df: DataFrame, target: str, prediction: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.select(
        *keep, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"), F.abs(y - p).alias("absolute_error")
    )


def best_model(metrics: DataFrame, order: Sequence[Column], exclude: Sequence[str] = ()) -> DataFrame:
    """The first model in the given order, named baselines left out; equal models by name."""
    candidates = metrics.filter(~F.col("model").isin(*exclude)) if exclude else metrics
    return candidates.orderBy(*order, "model").limit(1)
