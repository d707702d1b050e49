"""Metric queries over the test tables, on deterministic predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import Band, lt
from ..operators import evaluation as ev
from ..operators import modeling
from ..operators.preparation import label_set
from ..operators.profiling import histogram
from ..operators.splitting import hash_split, stable_sample
from .registry import query
from .tables import BUCKET_SQL, NEGATIVE, POSITIVE, ROW_KEY, STATUS, TARGET, Tables

KEYS = ", ".join(ROW_KEY)
PREDICTED_SQL = """(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""
# a price rule: what the quantity alone would cost
PRICED_SQL = "(SELECT *, l_quantity * CAST(1500 AS DOUBLE) AS prediction FROM lineitem)"
CELLS_SQL = f"""SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM {PREDICTED_SQL}"""
ERROR_BANDS = Band((lt(10000, "1) [0, 10000)"), lt(40000, "2) [10000, 40000)"), lt(70000, "3) [40000, 70000)")),
                   "4) [70000, +inf)")


def predicted(t: Tables):
    rows = label_set(t.lineitem, STATUS, NEGATIVE, POSITIVE)
    return rows.withColumn("prediction", (F.col("l_quantity") > 25).cast("double"))


def priced(t: Tables):
    return t.lineitem.withColumn("prediction", F.col("l_quantity") * 1500.0)


@query("confusion_matrix", CELLS_SQL)
def confusion_matrix(t: Tables):
    return ev.confusion(predicted(t))


@query("classification_metrics", f"""
    WITH c AS ({CELLS_SQL}), d AS (SELECT *, CAST(tn + fp + fn + tp AS DOUBLE) AS n,
        CAST(tp AS DOUBLE) / (tp + fp) AS bp, CAST(tp AS DOUBLE) / (tp + fn) AS br,
        CAST(tn AS DOUBLE) / (tn + fn) AS gp, CAST(tn AS DOUBLE) / (tn + fp) AS gr FROM c)
    SELECT tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy,
        round((tp + fn) / n * (2 * bp * br / (bp + br)) + (tn + fp) / n * (2 * gp * gr / (gp + gr)), 6) AS f1,
        round((tp + fn) / n * bp + (tn + fp) / n * gp, 6) AS weighted_precision,
        round((tp + fn) / n * br + (tn + fp) / n * gr, 6) AS weighted_recall,
        round(bp, 6) AS bad_precision, round(br, 6) AS bad_recall FROM d""")
def classification_metrics(t: Tables):
    return ev.threshold_metrics(ev.confusion(predicted(t)))


@query("auc_exact", f"""
    WITH s AS (SELECT l_extendedprice AS score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
        CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM {PREDICTED_SQL} GROUP BY 1),
    r AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS tp0, coalesce(sum(neg) OVER w, 0) AS fp0 FROM s
        WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, (tp0 + pos) / (tp0 + pos + fp0 + neg) AS here FROM r)
    SELECT round(1 - sum(pos * (fp0 + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
        round(sum(pos * (here + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE here END) / 2) / sum(pos), 6)
            AS pr_auc FROM q""")
def auc_exact(t: Tables):
    return ev.exact_auc(predicted(t), "label", TARGET)


@query("regression_metrics", f"""
    SELECT count(*) AS n, round(sqrt(avg((l_extendedprice - prediction) * (l_extendedprice - prediction))), 6) AS rmse,
        round(avg(abs(l_extendedprice - prediction)), 6) AS mae,
        round(1 - sum((l_extendedprice - prediction) * (l_extendedprice - prediction))
            / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
        round(avg(abs(l_extendedprice - prediction) / abs(l_extendedprice)), 6) AS mape,
        count(*) FILTER (WHERE l_extendedprice = 0) AS zero_targets FROM {PRICED_SQL}""")
def regression_metrics(t: Tables):
    return ev.regression_metrics(priced(t), TARGET)


BASE_SQL = f"""(SELECT l_extendedprice, (SELECT avg(l_extendedprice) FROM lineitem WHERE {BUCKET_SQL} % 10 < 8)
    AS prediction FROM lineitem WHERE {BUCKET_SQL} % 10 >= 8)"""


@query("baseline_mean", f"""
    SELECT count(*) AS n, round(sqrt(avg((l_extendedprice - prediction) * (l_extendedprice - prediction))), 4) AS rmse,
        round(avg(abs(l_extendedprice - prediction)), 4) AS mae,
        round(1 - sum((l_extendedprice - prediction) * (l_extendedprice - prediction))
            / (var_pop(l_extendedprice) * count(*)), 4) AS r2,
        round(avg(abs(l_extendedprice - prediction) / abs(l_extendedprice)), 4) AS mape,
        count(*) FILTER (WHERE l_extendedprice = 0) AS zero_targets,
        round(max(prediction), 4) AS baseline_mean FROM {BASE_SQL}""")
def baseline_mean(t: Tables):
    parts = hash_split(t.lineitem.select(*ROW_KEY, TARGET), ROW_KEY, {"train": 8, "test": 2})
    scored = ev.with_mean_baseline(parts["train"], parts["test"], TARGET)
    metrics = ev.regression_metrics(scored, TARGET, digits=4)
    mean = parts["train"].agg(F.round(F.avg(TARGET), 4).alias("m")).scalar()
    return metrics.withColumn("baseline_mean", mean)


@query("error_by_band", f"""
    SELECT CASE WHEN l_extendedprice < 10000 THEN '1) [0, 10000)' WHEN l_extendedprice < 40000 THEN '2) [10000, 40000)'
        WHEN l_extendedprice < 70000 THEN '3) [40000, 70000)' ELSE '4) [70000, +inf)' END AS band, count(*) AS n,
        round(avg(abs(l_extendedprice - prediction)), 6) AS mae,
        round(avg(abs(l_extendedprice - prediction) / abs(l_extendedprice)), 6) AS mape
    FROM {PRICED_SQL} GROUP BY 1 ORDER BY 1""")
def error_by_band(t: Tables):
    return ev.error_by_band(priced(t), TARGET, ERROR_BANDS).orderBy("band")


@query("residuals", f"""
    SELECT {KEYS}, l_extendedprice AS actual, prediction AS predicted, l_extendedprice - prediction AS residual,
        abs(l_extendedprice - prediction) AS absolute_error FROM {PRICED_SQL}""")
def residuals(t: Tables):
    return ev.residuals(priced(t), TARGET, keep=ROW_KEY)


@query("residual_histogram", f"""
    WITH r AS (SELECT l_extendedprice - prediction AS x FROM {PRICED_SQL}),
    span AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM r)
    SELECT CAST(least(floor((x - lo) / w) + 1, 50) AS BIGINT) AS bin,
        round(lo + w * (least(floor((x - lo) / w) + 1, 50) - 1), 6) AS bin_start,
        round(lo + w * least(floor((x - lo) / w) + 1, 50), 6) AS bin_end, count(*) AS n
    FROM r, span GROUP BY 1, 2, 3""")
def residual_histogram(t: Tables):
    return histogram(ev.residuals(priced(t), TARGET), "residual", 50)


@query("prediction_sample", f"""
    SELECT {KEYS}, round(l_extendedprice, 6) AS actual, round(prediction, 6) AS predicted,
        round(abs(l_extendedprice - prediction), 6) AS absolute_error FROM {PRICED_SQL}
    ORDER BY md5(concat_ws('-', '', l_orderkey, l_partkey, l_suppkey, l_linenumber)), {KEYS} LIMIT 200""")
def prediction_sample(t: Tables):
    rows = ev.residuals(priced(t), TARGET, keep=ROW_KEY).drop("residual")
    return stable_sample(rows, ROW_KEY, 200).withColumns({
        c: F.round(c, 6) for c in ("actual", "predicted", "absolute_error")})


MODELS_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS model, round(sqrt(avg((l_extendedprice - p) * (l_extendedprice - p))), 4) AS rmse,
        round(avg(abs(l_extendedprice - p)), 4) AS mae,
        round(1 - sum((l_extendedprice - p) * (l_extendedprice - p)) / (var_pop(l_extendedprice) * count(*)), 4) AS r2,
        round(avg(abs(l_extendedprice - p) / abs(l_extendedprice)), 4) AS mape
        FROM (SELECT l_extendedprice, {rule} AS p FROM lineitem) AS x"""
    for name, rule in [
        (modeling.BASELINE, "(SELECT avg(l_extendedprice) FROM lineitem)"),
        ("per unit 1500", "l_quantity * CAST(1500 AS DOUBLE)"),
        ("per unit 1300", "l_quantity * CAST(1300 AS DOUBLE)"),
    ])


@query("best_model_pick", f"""
    SELECT * FROM ({MODELS_SQL}) AS m WHERE model <> '{modeling.BASELINE}' ORDER BY rmse, mae, r2 DESC, model LIMIT 1""")
def best_model_pick(t: Tables):
    rows = t.lineitem
    rules = {
        "per unit 1500": F.col("l_quantity") * 1500.0,
        "per unit 1300": F.col("l_quantity") * 1300.0,
    }
    frames = [ev.regression_metrics(ev.with_mean_baseline(rows, rows, TARGET), TARGET, digits=4).withColumn(
        "model", F.lit(modeling.BASELINE))]
    frames += [
        ev.regression_metrics(rows, TARGET, rule, digits=4).withColumn("model", F.lit(name))
        for name, rule in rules.items()
    ]
    metrics = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return modeling.pick_regressor(metrics).select("model", "rmse", "mae", "r2", "mape")
