"""Classification metrics as aggregations.

Every metric is grouped by optional ``by`` columns (run, window, threshold …) and
reduces to per-(group, class) counts first — a partial aggregation, so a class
holding a third of all rows costs no more than any other.  Label policy for
averages: ``observed`` (classes present in truth ∪ prediction of the group) or
``fixed`` (a given class list, absent classes scoring 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..session import cut_lineage
from .ranking import join_null_safe, running_total
from .selection import Rank, rows_at


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("long") if weight else F.lit(1).cast("long")


def class_counts(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
                 y_pred: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Per (by, class): ``support`` (true), ``n_pred`` (predicted), ``tp``."""
    w = _w(weight)
    roles = F.explode(F.array(
        F.struct(F.col(y_true).alias("cls"), w.alias("t"),
                 F.when(F.col(y_true) == F.col(y_pred), w).otherwise(F.lit(0).cast("long")).alias("tp"),
                 F.lit(0).cast("long").alias("p")),
        F.struct(F.col(y_pred).alias("cls"), F.lit(0).cast("long").alias("t"),
                 F.lit(0).cast("long").alias("tp"), w.alias("p"))))
    return (pred.select(*by, roles.alias("__r"))
            .groupBy(*by, F.col("__r.cls").alias("class"))
            .agg(F.sum("__r.t").alias("support"), F.sum("__r.tp").alias("tp"),
                 F.sum("__r.p").alias("n_pred")))


def prf(counts: DataFrame) -> DataFrame:
    """precision / recall / f1 from ``class_counts``; 0 where undefined."""
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def per_class(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
              y_pred: str = "y_pred", weight: str | None = None) -> DataFrame:
    return prf(class_counts(pred, by, y_true, y_pred, weight))


def summary(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
            y_pred: str = "y_pred", classes: Sequence[str] | None = None,
            weight: str | None = None) -> DataFrame:
    """accuracy, macro_f1 (observed labels, or the fixed ``classes``),
    weighted_f1 (by true support), n, n_classes (labels averaged over)."""
    pc = per_class(pred, by, y_true, y_pred, weight)
    if classes is not None:
        k = len(classes)
        fixed = F.col("class").isin(list(classes))
        macro = (F.sum(F.when(fixed, F.col("f1")).otherwise(0.0)) / F.lit(float(k))).alias("macro_f1")
        n_cls = F.lit(k).cast("long").alias("n_classes")
        sup = F.when(fixed, F.col("support")).otherwise(0)
    else:
        macro = F.avg("f1").alias("macro_f1")
        n_cls = F.count(F.lit(1)).alias("n_classes")
        sup = F.col("support")
    agg = pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), macro,
        F.coalesce(F.try_divide(F.sum(F.col("f1") * sup), F.sum(sup)), F.lit(0.0)).alias("weighted_f1"),
        F.sum("support").alias("n"), n_cls)
    return agg


def confusion(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true",
              y_pred: str = "y_pred", classes: Sequence[str] | None = None) -> DataFrame:
    """Long confusion counts ``(by, y_true, y_pred, n)``; with ``classes`` every cell
    of each run's K×K grid is present, zeros included."""
    cells = pred.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return cells
    runs = pred.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    names = F.array(*[F.lit(c) for c in classes])
    grid = runs.withColumn("y_true", F.explode(names)).withColumn("y_pred", F.explode(names))
    return join_null_safe(grid, cells, [*by, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("long"))


def _row(name: str, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("n").alias("support"))


def report(pred: DataFrame, classes: Sequence[str], y_true: str = "y_true",
           y_pred: str = "y_pred") -> DataFrame:
    """Classification report over the fixed class list: one row per class, then
    ``accuracy`` (its value in the three score columns, support = n),
    ``macro avg`` and ``weighted avg``."""
    pc = per_class(pred, (), y_true, y_pred).where(F.col("class").isin(list(classes)))
    spark = pred.sparkSession
    cls = spark.createDataFrame([(c,) for c in classes], "class string")
    pc = cls.join(pc, "class", "left").select(
        "class", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("support", F.lit(0)).cast("long").alias("support"),
        F.coalesce("tp", F.lit(0)).cast("long").alias("tp"))
    k = float(len(classes))
    tot = pc.agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("acc"),
        (F.sum("precision") / k).alias("mp"), (F.sum("recall") / k).alias("mr"),
        (F.sum("f1") / k).alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("acc").alias("precision"),
                 F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
        _row("macro avg", "mp", "mr", "mf"), _row("weighted avg", "wp", "wr", "wf"))).alias("r")
    ).select("r.*")
    return pc.drop("tp").unionByName(rows)


# ------------------------------------------------------------------ probabilities

def top_scores(probs: str | Column) -> list[Column]:
    """Argmax (first maximum, 0-based), max probability, margin (top1 − top2;
    top1 alone for one class)."""
    p = F.col(probs) if isinstance(probs, str) else probs
    mx = F.array_max(p)
    srt = F.sort_array(p, asc=False)
    return [(F.array_position(p, mx) - 1).cast("int").alias("pred_idx"), mx.alias("max_prob"),
            F.when(F.size(p) > 1, srt[0] - srt[1]).otherwise(srt[0]).alias("margin")]


def ece_bin(p: str | Column, n_bins: int = 10) -> Column:
    """Bin index of ``p`` for edges ``i/n_bins`` computed as ``i*(1/n_bins)`` in
    doubles (``(lo, hi]``); NULL for p <= 0 or p > 1."""
    x = F.col(p) if isinstance(p, str) else p
    step = 1.0 / n_bins
    edges = [i * step for i in range(n_bins)] + [1.0]
    expr = None
    for i in range(n_bins):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def ece(df: DataFrame, conf: str = "max_prob", correct: str = "correct",
        by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Expected calibration error per group: Σ_b n_b/n · |acc_b − conf_b|; rows
    outside every bin (p <= 0) count in n only.  Also returns n and accuracy.
    Two aggregations (rows -> bins -> group), no join."""
    b = df.withColumn("__bin", ece_bin(conf, n_bins))
    per_bin = b.groupBy(*by, "__bin").agg(
        F.count(F.lit(1)).alias("nb"), F.sum(F.col(correct).cast("double")).alias("sc"),
        F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(conf).alias("cf"))
    return per_bin.groupBy(*by).agg(
        (F.sum(F.when(F.col("__bin").isNotNull(), F.col("nb") * F.abs(F.col("acc") - F.col("cf"))))
         / F.sum("nb")).alias("ece"),
        F.sum("nb").alias("n"), (F.sum("sc") / F.sum("nb")).alias("accuracy"))


def per_class_ece(df: DataFrame, pred: str = "y_pred", conf: str = "max_prob",
                  correct: str = "correct", n_bins: int = 10) -> DataFrame:
    """Per predicted class: n_predictions, ece (bins inside the class),
    mean_confidence, empirical_accuracy.  Classes never predicted are absent."""
    e = ece(df, conf, correct, by=[pred], n_bins=n_bins).select(pred, "ece")
    s = df.groupBy(pred).agg(F.count(F.lit(1)).alias("n_predictions"),
                             F.avg(conf).alias("mean_confidence"),
                             F.avg(F.col(correct).cast("double")).alias("empirical_accuracy"))
    return s.join(e, pred, "left").withColumn("ece", F.coalesce("ece", F.lit(0.0)))


def reliability(df: DataFrame, conf: str = "max_prob", correct: str = "correct",
                n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty bins: bin centre, accuracy, mean confidence, count."""
    step = 1.0 / n_bins
    b = df.withColumn("bin", ece_bin(conf, n_bins)).where(F.col("bin").isNotNull())
    return b.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.avg(conf).alias("confidence")).withColumn(
        "bin_center", F.col("bin") * F.lit(step) + F.lit(step / 2))


def selective_sweep(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                    scores: Sequence[str] = ("max_prob", "margin"),
                    thresholds: Sequence[float] = config.SELECTIVE_THRESHOLDS,
                    by: Sequence[str] = ()) -> DataFrame:
    """Coverage, selective accuracy and macro-F1 (observed labels) for
    ``score >= tau``, per score method and threshold; empty coverage skipped.

    Rows reduce to (method, threshold level, y_true, y_pred) counts first, so the
    sweep costs one partial aggregation whatever the number of rows."""
    taus = sorted(float(t) for t in thresholds)
    long = df.select(*by, y_true, y_pred, F.explode(F.array(*[
        F.struct(F.lit(s).alias("method"), F.col(s).cast("double").alias("score")) for s in scores
    ])).alias("__m")).select(*by, y_true, y_pred, "__m.method", "__m.score")
    level = sum((F.col("score") >= F.lit(t)).cast("int") for t in taus)
    cells = long.withColumn("__lvl", level).groupBy(*by, "method", "__lvl", y_true, y_pred) \
        .agg(F.count(F.lit(1)).alias("__n"))
    total = cells.groupBy(*by, "method").agg(F.sum("__n").alias("__total"))
    tau_arr = F.array(*[F.struct(F.lit(i + 1).alias("lvl"), F.lit(t).alias("threshold"))
                        for i, t in enumerate(taus)])
    per_tau = cells.select(*cells.columns, F.explode(tau_arr).alias("__t")) \
        .where(F.col("__lvl") >= F.col("__t.lvl")) \
        .select(*by, "method", F.col("__t.threshold").alias("threshold"), y_true, y_pred, "__n")
    s = summary(per_tau, [*by, "method", "threshold"], y_true, y_pred, weight="__n")
    out = s.join(total, [*by, "method"])
    return out.select(*by, "method", "threshold",
                      (F.col("n") / F.col("__total")).alias("coverage"),
                      F.col("accuracy").alias("selective_accuracy"),
                      F.col("macro_f1").alias("selective_macro_f1"),
                      F.col("n").alias("n_covered"), "n_classes")


# ------------------------------------------------------------------ ranking metrics

def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(
        F.sum(F.col(label).cast("long")).alias("__pos"),
        F.sum(1 - F.col(label).cast("long")).alias("__neg"))


def auroc(df: DataFrame, label: str = "label", score: str = "score",
          by: Sequence[str] = ()) -> DataFrame:
    """Area under ROC with tie handling (mid-ranks); NULL with a single class.
    Per distinct score counts, then one scalable running total."""
    sc = _score_counts(df, label, score, by)
    cum = running_total(sc, list(by), ["__s"], ["__neg"])
    part = cum.withColumn("__below", F.col("__neg_cum") - F.col("__neg"))
    agg = part.groupBy(*by).agg(
        F.sum(F.col("__pos") * (F.col("__below") + 0.5 * F.col("__neg"))).alias("__u"),
        F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    return agg.select(*by, F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                                  F.col("__u") / (F.col("__P") * F.col("__N"))).alias("auroc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      by: Sequence[str] = ()) -> DataFrame:
    """Σ over distinct scores (descending) of ΔRecall · Precision; NULL with a
    single class."""
    sc = _score_counts(df, label, score, by)
    cum = running_total(sc, list(by), [F.desc("__s")], ["__pos", "__neg"])
    tot = cum.groupBy(*by).agg(
        F.sum(F.col("__pos") * F.col("__pos_cum") / (F.col("__pos_cum") + F.col("__neg_cum")))
        .alias("__ap"), F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    return tot.select(*by, F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                                  F.col("__ap") / F.col("__P")).alias("average_precision"))


def ranking_summary(df: DataFrame, label: str = "label", score: str = "score",
                    by: Sequence[str] = ()) -> DataFrame:
    """``auroc`` and ``average_precision`` from one running total over distinct scores,
    highest first: with N negatives and n of them scored at least as high, N - n score
    lower.  NULL with a single class."""
    sc = _score_counts(df, label, score, by)
    cum = running_total(sc, list(by), [F.desc("__s")], ["__pos", "__neg"])
    pos, neg = F.col("__pos").cast("double"), F.col("__neg").cast("double")
    tot = cum.groupBy(*by).agg(
        F.sum(pos * (F.col("__neg_cum") - 0.5 * neg)).alias("__over"),
        F.sum(pos * F.col("__pos_cum") / (F.col("__pos_cum") + F.col("__neg_cum"))).alias("__ap"),
        F.sum(pos).alias("__P"), F.sum(neg).alias("__N"))
    both = (F.col("__P") > 0) & (F.col("__N") > 0)
    return tot.select(*by, F.when(both, 1 - F.col("__over") / (F.col("__P") * F.col("__N"))).alias("auroc"),
                      F.when(both, F.col("__ap") / F.col("__P")).alias("average_precision"))


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (),
                   out: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile (NumPy's default) per group, between the two rows at
    the exact ranks, which histograms select (no sort).  Nulls are ignored; the driver
    holds one row a group.  A single group without values gives null."""
    g = list(by)
    own = cut_lineage(df.select(*g, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull()))
    sizes = own.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).collect()
    asked, at = [], {}
    for r in sizes:
        group, h = tuple(r[: len(g)]), (r["n"] - 1) * float(q)
        at[group] = h
        asked += [Rank((group, k), min(math.floor(h) + 1 + k, r["n"]), group) for k in (0, 1)]
    rows = rows_at(own, ["__v"], asked, g, written=True)

    def quantile(group, h):
        if (group, 0) not in rows:
            return None
        a, b = rows[(group, 0)][0], rows[(group, 1)][0]
        return a + (b - a) * (h - math.floor(h))

    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in g], T.StructField(out, T.DoubleType())])
    return df.sparkSession.createDataFrame([(*group, quantile(group, h)) for group, h in at.items()], schema)
