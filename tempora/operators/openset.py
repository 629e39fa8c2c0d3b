"""Open-set evaluation: reject low-confidence predictions as ``unknown`` and
measure how well a held-out class is kept out while known classes stay in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import metrics

UNKNOWN = "unknown"
ROLLUP = ("open_set_macro_f1", "unknown_rejection_rate", "known_acceptance_rate", "unknown_detection_auroc")


def thresholds(val: DataFrame, score: str = "score", by: Sequence[str] = ("heldout", "method"),
               retention: float = config.KNOWN_RETENTION) -> DataFrame:
    """Per group: the ``1 − retention`` quantile of validation scores (clamped to
    [0, 1], linear interpolation) plus the score mean / min / max."""
    q = max(0.0, min(1.0, 1.0 - retention))
    thr = metrics.exact_quantile(val, score, q, by=list(by), out="threshold")
    stats = val.groupBy(*by).agg(F.avg(score).alias("val_mean_score"),
                                 F.min(score).alias("val_min_score"),
                                 F.max(score).alias("val_max_score"))
    return thr.join(stats, list(by)).withColumn("target_known_retention", F.lit(float(retention)))


def reject(scored: DataFrame, thr: DataFrame, by: Sequence[str] = ("heldout", "method"),
           score: str = "score", pred: str = "y_pred", out: str = "open_pred") -> DataFrame:
    """``score < threshold`` -> ``unknown``, else the closed-set prediction.
    Thresholds are one row per group (small), joined on the group keys."""
    j = scored.join(thr.select(*by, "threshold"), list(by))
    return j.withColumn(out, F.when(F.col(score) < F.col("threshold"), F.lit(UNKNOWN))
                        .otherwise(F.col(pred)))


def evaluate(test: DataFrame, thr: DataFrame, n_labels: DataFrame,
             by: Sequence[str] = ("heldout", "method"), role: str = "role",
             y_true: str = "y_true", pred: str = "y_pred", score: str = "score") -> DataFrame:
    """Open-set metrics per group from test rows tagged ``role`` in
    {known, unknown}.  ``n_labels``: per group the size of the fixed label list
    (known classes + ``unknown``) for the open-set macro-F1."""
    g = list(by)
    r = reject(test, thr, g, score, pred)
    r = r.withColumn("__true", F.when(F.col(role) == "unknown", F.lit(UNKNOWN)).otherwise(F.col(y_true)))
    known = r.where(F.col(role) == "known")
    closed = metrics.summary(known, g, y_true, pred).select(
        *g, F.col("accuracy").alias("closed_known_accuracy"),
        F.col("macro_f1").alias("closed_known_macro_f1"))
    pc = metrics.per_class(r, g, "__true", "open_pred").join(n_labels, g)
    open_ = pc.groupBy(*g).agg((F.sum("tp") / F.sum("support")).alias("open_set_accuracy"),
                               (F.sum("f1") / F.first("n_labels")).alias("open_set_macro_f1"))
    rates = r.groupBy(*g).agg(
        F.avg(F.when(F.col(role) == "known", (F.col("open_pred") != UNKNOWN).cast("double")))
        .alias("known_acceptance_rate"),
        F.avg(F.when(F.col(role) == "unknown", (F.col("open_pred") == UNKNOWN).cast("double")))
        .alias("unknown_rejection_rate"),
        F.count_if(F.col(role) == "known").alias("n_known_test"),
        F.count_if(F.col(role) == "unknown").alias("n_unknown_test"))
    lab = r.select(*g, (F.col(role) == "unknown").cast("int").alias("__u"), (-F.col(score)).alias("__s"))
    ranked = metrics.ranking_summary(lab, "__u", "__s", g).withColumnsRenamed(
        {"auroc": "unknown_detection_auroc", "average_precision": "unknown_detection_auprc"})
    return closed.join(open_, g).join(rates, g).join(ranked, g)


def rollup(summary: DataFrame, by: Sequence[str] = ("view_request", "score_method"),
           cols: Sequence[str] = ROLLUP,
           places: int = 4) -> DataFrame:
    """Mean of each metric per group, rounded."""
    return summary.groupBy(*by).agg(*[F.round(F.avg(c), places).alias(f"mean_{c}") for c in cols]).orderBy(*by)
