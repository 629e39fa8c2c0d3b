"""Metrics on the driver tables.

Predictions: two deterministic "runs" over ``orders`` (truth ``o_orderpriority``,
errors placed by integer arithmetic on keys, identical in both engines).
Probabilities: a nearest-centroid softmax over ``embeddings`` (class = label).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import metrics, resample, scoring, splits
from .catalog import register, table

# stand-in class list of the driver table (o_orderpriority values), sorted
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ARR_SQL = "[" + ", ".join(f"'{c}'" for c in PRIORITIES) + "]"


def _cls_at(idx):
    return F.element_at(F.array(*[F.lit(c) for c in PRIORITIES]), (idx % 5 + 1).cast("int"))


def predictions(spark, d):
    """``sample_id, y_true, pred_a, pred_b``."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("y_true"),
        F.when(F.col("o_orderkey") % 10 < 3, _cls_at(F.col("o_custkey")))
        .otherwise(F.col("o_orderpriority")).alias("pred_a"),
        F.when((F.col("o_orderkey") * 7) % 10 < 2, _cls_at(F.col("o_custkey") + 2))
        .otherwise(F.col("o_orderpriority")).alias("pred_b"))


PRED_SQL = f"""
SELECT o_orderkey AS sample_id, o_orderpriority AS y_true,
       CASE WHEN o_orderkey % 10 < 3 THEN {_ARR_SQL}[o_custkey % 5 + 1] ELSE o_orderpriority END AS pred_a,
       CASE WHEN (o_orderkey * 7) % 10 < 2 THEN {_ARR_SQL}[(o_custkey + 2) % 5 + 1]
            ELSE o_orderpriority END AS pred_b
FROM orders"""

RUNS_SQL = f"""
WITH p AS ({PRED_SQL}),
runs AS (SELECT 'a' AS run, y_true, pred_a AS y_pred FROM p
         UNION ALL SELECT 'b', y_true, pred_b FROM p),
roles AS (SELECT run, y_true AS class, 1 AS t, (y_true = y_pred)::INT AS tp, 0 AS p FROM runs
          UNION ALL SELECT run, y_pred, 0, 0, 1 FROM runs),
cc AS (SELECT run, class, sum(t)::BIGINT AS support, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS n_pred
         FROM roles GROUP BY ALL),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cc),
prf AS (SELECT *, CASE WHEN precision + recall > 0
                       THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
"""


def runs(spark, d):
    p = predictions(spark, d)
    return (p.select(F.lit("a").alias("run"), "y_true", F.col("pred_a").alias("y_pred"))
            .unionByName(p.select(F.lit("b").alias("run"), "y_true", F.col("pred_b").alias("y_pred"))))


def r6(df):
    """Round doubles to 6 places (both engines agree to that precision)."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


@register("metrics_summary", RUNS_SQL + """
SELECT run, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
       round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), 6) AS weighted_f1,
       sum(support)::BIGINT AS n, count(*) AS n_classes
FROM prf GROUP BY run
""")
def metrics_summary(spark, d):
    """AG7, AG9 (observed), AG10: accuracy, macro- and weighted-F1 per run."""
    return r6(metrics.summary(runs(spark, d), ["run"]))


@register("metrics_per_class", RUNS_SQL + """
SELECT run, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support, tp, n_pred FROM prf
""")
def metrics_per_class(spark, d):
    """AG8: per-class precision / recall / F1, 0 when undefined."""
    return r6(metrics.per_class(runs(spark, d), ["run"]))


@register("macro_f1_fixed", RUNS_SQL + f"""
SELECT run, round(sum(CASE WHEN class IN {tuple(PRIORITIES + ['0-UNUSED'])} THEN f1 ELSE 0 END) / 6.0, 6)
       AS macro_f1, round(sum(tp) / sum(support), 6) AS accuracy,
       round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), 6) AS weighted_f1,
       sum(support)::BIGINT AS n, CAST(6 AS BIGINT) AS n_classes
FROM prf GROUP BY run
""")
def macro_f1_fixed(spark, d):
    """AG9 (fixed label list of six, one never occurring: it scores 0)."""
    return r6(metrics.summary(runs(spark, d), ["run"], classes=PRIORITIES + ["0-UNUSED"]))


@register("confusion_matrix", f"""
WITH p AS ({PRED_SQL}),
grid AS (SELECT a.c AS y_true, b.c AS y_pred FROM (SELECT unnest({_ARR_SQL}) AS c) a,
         (SELECT unnest({_ARR_SQL}) AS c) b)
SELECT g.y_true, g.y_pred, coalesce(n, 0) AS n FROM grid g
LEFT JOIN (SELECT y_true, pred_a AS y_pred, count(*) AS n FROM p GROUP BY ALL) c USING (y_true, y_pred)
""")
def confusion_matrix(spark, d):
    """AG6: K×K confusion counts over the fixed class list, zeros kept."""
    p = predictions(spark, d).select("y_true", F.col("pred_a").alias("y_pred"))
    return metrics.confusion(p, classes=PRIORITIES)


@register("classification_report", RUNS_SQL + f"""
, one AS (SELECT * FROM prf WHERE run = 'a'),
tot AS (SELECT sum(support)::BIGINT AS n, sum(tp) / sum(support) AS acc,
               sum(precision) / 5 AS mp, sum(recall) / 5 AS mr, sum(f1) / 5 AS mf,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM one)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM one
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM tot
""")
def classification_report(spark, d):
    """AG11: per-class rows + accuracy / macro avg / weighted avg."""
    p = predictions(spark, d).select("y_true", F.col("pred_a").alias("y_pred"))
    return r6(metrics.report(p, PRIORITIES))


@register("mcnemar", f"""
WITH p AS ({PRED_SQL}),
bc AS (SELECT count_if(pred_a = y_true AND pred_b <> y_true) AS b,
              count_if(pred_a <> y_true AND pred_b = y_true) AS c FROM p),
terms AS (SELECT b, c, b + c AS n, i FROM bc, range(0, CAST(least(b, c) + 1 AS BIGINT)) t(i)),
pv AS (SELECT any_value(b) AS b, any_value(c) AS c, any_value(n) AS n,
              sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS s FROM terms)
SELECT b::BIGINT AS b, c::BIGINT AS c, n::BIGINT AS n_discordant,
       round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 6) AS p_value FROM pv
""")
def mcnemar(spark, d):
    """AG28, U4, J6: exact two-sided McNemar on per-sample correctness."""
    p = predictions(spark, d)
    return r6(resample.mcnemar(p, "y_true", "pred_a", "pred_b"))


# ------------------------------------------------------------------ probabilities

EMB_SQL = """
WITH x AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, unnest(embedding)::DOUBLE AS v,
                  generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label AS cl, pos, avg(v) AS c FROM x GROUP BY ALL),
cn AS (SELECT cl, sqrt(sum(c * c)) AS nc FROM cent GROUP BY cl),
en AS (SELECT vec_id, sqrt(sum(v * v)) AS ne FROM x GROUP BY vec_id),
dots AS (SELECT x.vec_id, any_value(x.label) AS label, cent.cl, sum(x.v * cent.c) AS d
         FROM x JOIN cent USING (pos) GROUP BY x.vec_id, cent.cl),
lg AS (SELECT d.vec_id, d.label, d.cl, 10.0 * d.d / (en.ne * cn.nc) AS z
       FROM dots d JOIN en USING (vec_id) JOIN cn USING (cl)),
pr AS (SELECT vec_id, label, cl, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM lg),
sc AS (SELECT vec_id, any_value(label) AS y_true, arg_max(cl, p) AS y_pred, max(p) AS max_prob,
              max(p) - list_sort(list(p), 'DESC')[2] AS margin
       FROM pr GROUP BY vec_id),
scored AS (SELECT *, (y_true = y_pred) AS correct FROM sc)
"""


def scored(spark, d):
    """``vec_id, y_true, y_pred, max_prob, margin, correct`` from centroid softmax."""
    emb = table(spark, d, "embeddings")
    model = scoring.fit_centroids(emb, "embedding", "label")
    out = scoring.score(emb.select("vec_id", "label", "embedding"), model, "embedding")
    out = out.select("vec_id", F.col("label").cast("string").alias("y_true"), "classes",
                     *metrics.top_scores("p"))
    pred = F.element_at("classes", F.col("pred_idx") + 1)
    return out.select("vec_id", "y_true", pred.alias("y_pred"), "max_prob", "margin",
                      (F.col("y_true") == pred).alias("correct"))


@register("scores_top", EMB_SQL + """
SELECT vec_id, y_true, y_pred, round(max_prob, 6) AS max_prob, round(margin, 6) AS margin, correct
FROM scored
""")
def scores_top(spark, d):
    """Argmax class, max probability and margin per sample."""
    return r6(scored(spark, d))


def _bin_sql(p: str) -> str:
    edges = [i * 0.1 for i in range(10)] + [1.0]
    arms = " ".join(f"WHEN {p} > {edges[i]!r} AND {p} <= {edges[i + 1]!r} THEN {i}" for i in range(10))
    return f"CASE {arms} END"


@register("calibration_ece", EMB_SQL + f"""
, b AS (SELECT *, {_bin_sql('max_prob')} AS bin FROM scored),
pb AS (SELECT bin, count(*) AS nb, avg(correct::DOUBLE) AS acc, avg(max_prob) AS cf
       FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT round(sum(nb / (SELECT count(*) FROM scored) * abs(acc - cf)), 6) AS ece,
       round((SELECT avg(correct::DOUBLE) FROM scored), 6) AS accuracy,
       (SELECT count(*) FROM scored) AS n FROM pb
""")
def calibration_ece(spark, d):
    """AG12: expected calibration error (10 bins on max probability)."""
    return r6(metrics.ece(scored(spark, d)))


@register("calibration_per_class", EMB_SQL + f"""
, b AS (SELECT *, {_bin_sql('max_prob')} AS bin FROM scored),
pb AS (SELECT y_pred, bin, count(*) AS nb, avg(correct::DOUBLE) AS acc, avg(max_prob) AS cf
       FROM b WHERE bin IS NOT NULL GROUP BY ALL),
pc AS (SELECT y_pred, count(*) AS n_predictions, avg(max_prob) AS mean_confidence,
              avg(correct::DOUBLE) AS empirical_accuracy FROM scored GROUP BY y_pred)
SELECT pc.y_pred, n_predictions, round(mean_confidence, 6) AS mean_confidence,
       round(empirical_accuracy, 6) AS empirical_accuracy,
       round(coalesce(sum(nb / n_predictions * abs(acc - cf)), 0), 6) AS ece
FROM pc LEFT JOIN pb USING (y_pred) GROUP BY ALL
""")
def calibration_per_class(spark, d):
    """AG13: per predicted class ECE, confidence and accuracy."""
    return r6(metrics.per_class_ece(scored(spark, d)))


@register("reliability_table", EMB_SQL + f"""
SELECT bin, count(*) AS count, round(avg(correct::DOUBLE), 6) AS accuracy,
       round(avg(max_prob), 6) AS confidence, round(bin * 0.1 + 0.05, 6) AS bin_center
FROM (SELECT *, {_bin_sql('max_prob')} AS bin FROM scored) WHERE bin IS NOT NULL GROUP BY bin
""")
def reliability_table(spark, d):
    """AG14: reliability diagram table (non-empty bins)."""
    return r6(metrics.reliability(scored(spark, d)))


def _sweep_sql() -> str:
    taus = ", ".join(f"({t!r})" for t in config.SELECTIVE_THRESHOLDS)
    return EMB_SQL + f"""
, lng AS (SELECT 'max_prob' AS method, max_prob AS score, y_true, y_pred FROM scored
          UNION ALL SELECT 'margin', margin, y_true, y_pred FROM scored),
taus(threshold) AS (VALUES {taus}),
cov AS (SELECT method, threshold, y_true, y_pred FROM lng JOIN taus ON score >= threshold),
roles AS (SELECT method, threshold, y_true AS class, 1 AS t, (y_true = y_pred)::INT AS tp, 0 AS p FROM cov
          UNION ALL SELECT method, threshold, y_pred, 0, 0, 1 FROM cov),
cc AS (SELECT method, threshold, class, sum(t) AS support, sum(tp) AS tp, sum(p) AS n_pred
       FROM roles GROUP BY ALL),
pq AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM cc),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pq)
SELECT method, threshold, round(sum(support) / (SELECT count(*) FROM scored), 6) AS coverage,
       round(sum(tp) / sum(support), 6) AS selective_accuracy, round(avg(f1), 6) AS selective_macro_f1,
       sum(support)::BIGINT AS n_covered, count(*) AS n_classes
FROM f GROUP BY method, threshold
"""


@register("selective_sweep", _sweep_sql())
def selective_sweep(spark, d):
    """AG15, PF9, X18: coverage / accuracy / macro-F1 per threshold and method."""
    return r6(metrics.selective_sweep(scored(spark, d)))
