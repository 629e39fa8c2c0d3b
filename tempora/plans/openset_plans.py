"""Open-set evaluation by view: each class in turn is held out, the others are split
chronologically, a model is fitted on the train rows, validation scores set the rejection
threshold.  Views: ``embedding`` (labels of ``embeddings``, ``vec_id`` as time, nearest
centroid) and ``counts`` (priorities of ``orders`` by date, multinomial naive Bayes on the
count features of their lines; scores to nine places, so that equal orders tie)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import functions as F

from .. import config
from ..operators import openset, openset_models, splits
from ..session import cut_lineage
from .catalog import register, table
from .feature_plans import COUNT_COLS
from .split_plans import SAMPLES_SQL, samples

MIN_UNKNOWN = 5  # the driver tables hold ~50 rows per label at sf0.01
Q = 1.0 - config.KNOWN_RETENTION
PLACES = 9


def _embedding(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"),
        F.col("vec_id").alias("date"), F.col("embedding").alias("vec"))


def _counts(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("n_returned"),
        F.max("l_discount").alias("max_discount"))
    rows = samples(spark, d).join(lines, "sample_id", "left")
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in COUNT_COLS])
    return cut_lineage(rows.select("sample_id", "label", "date", vec.alias("vec")))


VIEWS: dict[str, tuple[Callable, str, int | None]] = {
    "embedding": (_embedding, "centroid", None), "counts": (_counts, "naive_bayes", PLACES)}


def openset_scored(spark, d, view: str = "embedding"):
    """Scored validation and test rows of a view, and its number of classes."""
    rows, kind, places = VIEWS[view]
    s = rows(spark, d)
    cuts = splits.heldout_cuts(s.drop("vec"), "sample_id", "label", "date", min_unknown=MIN_UNKNOWN)
    return openset_models.score(s, cuts, "vec", kind, places=places), len(splits.class_list(s, "label"))


def _parts_sql(smp: str) -> str:
    return f"""
WITH {smp},
cls AS (SELECT DISTINCT label AS heldout FROM smp),
known AS (SELECT h.heldout, s.sample_id, s.label, s.date FROM cls h JOIN smp s ON s.label <> h.heldout),
ranked AS (SELECT *, row_number() OVER (PARTITION BY heldout ORDER BY date, sample_id) AS rk,
                  count(*) OVER (PARTITION BY heldout) AS n FROM known),
cut AS (SELECT *, CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) AS sp FROM ranked),
cut2 AS (SELECT *, greatest(sp - CAST(greatest(floor(CAST(sp AS DOUBLE) * 0.1), 1) AS BIGINT), 0) AS tr
         FROM cut),
kparts AS (SELECT heldout, sample_id, label, date, rk, sp,
                  CASE WHEN rk <= tr THEN 'train' WHEN rk <= sp THEN 'val' ELSE 'known_test' END AS part
           FROM cut2),
bounds AS (SELECT heldout, min(CASE WHEN rk = sp + 1 THEN date END) AS boundary FROM kparts GROUP BY heldout),
unk AS (SELECT b.heldout, s.sample_id, s.label, s.date, 'unknown_test' AS part
        FROM bounds b JOIN smp s ON s.label = b.heldout AND s.date >= b.boundary),
kept AS (SELECT heldout FROM unk GROUP BY heldout HAVING count(*) >= {MIN_UNKNOWN}),
parts AS (SELECT heldout, sample_id, label, part FROM kparts WHERE heldout IN (SELECT heldout FROM kept)
          UNION ALL SELECT heldout, sample_id, label, part FROM unk WHERE heldout IN (SELECT heldout FROM kept)),
x AS (SELECT p.heldout, p.sample_id, p.label, p.part, unnest(s.vec)::DOUBLE AS v,
             generate_subscripts(s.vec, 1) AS pos
      FROM parts p JOIN smp s USING (sample_id)),
"""


# log weights lg(heldout, sample_id, label, part, cl, z) of the two models
CENTROID_SQL = """
cent AS (SELECT heldout, label AS cl, pos, avg(v) AS c FROM x WHERE part = 'train' GROUP BY ALL),
cn AS (SELECT heldout, cl, sqrt(sum(c * c)) AS nc FROM cent GROUP BY ALL),
ev AS (SELECT * FROM x WHERE part <> 'train'),
en AS (SELECT heldout, sample_id, sqrt(sum(v * v)) AS ne FROM ev GROUP BY ALL),
dots AS (SELECT ev.heldout, ev.sample_id, any_value(ev.label) AS label, any_value(ev.part) AS part, cent.cl,
                sum(ev.v * cent.c) AS d
         FROM ev JOIN cent ON ev.heldout = cent.heldout AND ev.pos = cent.pos GROUP BY ALL),
lg AS (SELECT d.*, 10.0 * d.d / (en.ne * cn.nc) AS z FROM dots d
       JOIN en USING (heldout, sample_id) JOIN cn USING (heldout, cl)),
"""
BAYES_SQL = """
ps AS (SELECT heldout, label AS cl, pos, sum(v) AS s FROM x WHERE part = 'train' GROUP BY ALL),
lw AS (SELECT heldout, cl, pos, ln((s + 1) / (sum(s) OVER w + count(*) OVER w)) AS w FROM ps
       WINDOW w AS (PARTITION BY heldout, cl)),
lg AS (SELECT x.heldout, x.sample_id, any_value(x.label) AS label, any_value(x.part) AS part, lw.cl,
              sum(x.v * lw.w) AS z
       FROM x JOIN lw ON x.heldout = lw.heldout AND x.pos = lw.pos WHERE x.part <> 'train' GROUP BY ALL),
"""


def _scored_sql(smp: str, model: str, places: int | None) -> str:
    score = "score" if places is None else f"round(score, {places})"
    return _parts_sql(smp) + model + f"""
ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY heldout, sample_id)) AS e FROM lg),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY heldout, sample_id) AS p FROM ex),
sc AS (SELECT heldout, sample_id, any_value(label) AS y_true, any_value(part) AS part,
              list(cl ORDER BY p DESC, cl)[1] AS y_pred, max(p) AS max_prob,
              max(p) - list_sort(list(p), 'DESC')[2] AS margin FROM pr GROUP BY ALL),
lng0 AS (SELECT heldout, sample_id, y_true, part, y_pred, 'max_prob' AS method, max_prob AS score FROM sc
         UNION ALL SELECT heldout, sample_id, y_true, part, y_pred, 'margin', margin FROM sc),
lng AS (SELECT heldout, sample_id, y_true, part, y_pred, method, {score} AS score FROM lng0),
thr AS (SELECT heldout, method, quantile_cont(score, {Q!r}) AS threshold, avg(score) AS val_mean_score,
               min(score) AS val_min_score, max(score) AS val_max_score
        FROM lng WHERE part = 'val' GROUP BY ALL)
"""


OPENSET_SQL = _scored_sql("""smp AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label, vec_id AS date,
              embedding AS vec FROM embeddings)""", CENTROID_SQL, None)
COUNTS_SQL = _scored_sql(f"""per AS (SELECT l_orderkey AS sample_id, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS sum_qty,
               count_if(l_returnflag = 'R')::DOUBLE AS n_returned, max(l_discount) AS max_discount
        FROM lineitem GROUP BY l_orderkey),
smp AS (SELECT o.sample_id, label, date, [{", ".join(f"coalesce({c}::DOUBLE, 0.0)" for c in COUNT_COLS)}] AS vec
        FROM ({SAMPLES_SQL}) o LEFT JOIN per USING (sample_id))""", BAYES_SQL, PLACES)


@register("openset_thresholds", OPENSET_SQL + f"""
SELECT heldout, method, round(threshold, 6) AS threshold, round(val_mean_score, 6) AS val_mean_score,
       round(val_min_score, 6) AS val_min_score, round(val_max_score, 6) AS val_max_score,
       {config.KNOWN_RETENTION!r} AS target_known_retention
FROM thr
""")
def openset_thresholds(spark, d):
    """AG22, AG23: validation quantile threshold and score statistics."""
    long, _ = openset_scored(spark, d)
    from .metric_plans import r6
    return r6(openset.thresholds(long.where(F.col("part") == "val")))


METRICS_SQL = """
, te AS (SELECT l.*, CASE WHEN l.part = 'unknown_test' THEN 'unknown' ELSE 'known' END AS role,
                CASE WHEN score < t.threshold THEN 'unknown' ELSE y_pred END AS open_pred,
                CASE WHEN l.part = 'unknown_test' THEN 'unknown' ELSE y_true END AS open_true
         FROM lng l JOIN thr t USING (heldout, method) WHERE l.part IN ('known_test', 'unknown_test')),
nl AS (SELECT count(*) AS n_labels FROM (SELECT DISTINCT label FROM smp)),
roles AS (SELECT heldout, method, open_true AS class, 1 AS t, (open_true = open_pred)::INT AS tp, 0 AS p FROM te
          UNION ALL SELECT heldout, method, open_pred, 0, 0, 1 FROM te),
cc AS (SELECT heldout, method, class, sum(t) AS support, sum(tp) AS tp, sum(p) AS n_pred FROM roles GROUP BY ALL),
pq AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM cc),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM pq),
openm AS (SELECT heldout, method, sum(tp) / sum(support) AS open_set_accuracy,
                 sum(f1) / any_value((SELECT n_labels FROM nl)) AS open_set_macro_f1 FROM f GROUP BY ALL),
kr AS (SELECT heldout, method, y_true AS class, 1 AS t, (y_true = y_pred)::INT AS tp, 0 AS p FROM te
       WHERE role = 'known' UNION ALL
       SELECT heldout, method, y_pred, 0, 0, 1 FROM te WHERE role = 'known'),
kc AS (SELECT heldout, method, class, sum(t) AS support, sum(tp) AS tp, sum(p) AS n_pred FROM kr GROUP BY ALL),
kq AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM kc),
kf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM kq),
closed AS (SELECT heldout, method, sum(tp) / sum(support) AS closed_known_accuracy,
                  avg(f1) AS closed_known_macro_f1 FROM kf GROUP BY ALL),
rates AS (SELECT heldout, method,
                 avg(CASE WHEN role = 'known' THEN (open_pred <> 'unknown')::DOUBLE END) AS known_acceptance_rate,
                 avg(CASE WHEN role = 'unknown' THEN (open_pred = 'unknown')::DOUBLE END) AS unknown_rejection_rate,
                 count_if(role = 'known') AS n_known_test, count_if(role = 'unknown') AS n_unknown_test
          FROM te GROUP BY ALL),
lab AS (SELECT heldout, method, (role = 'unknown')::INT AS u, -score AS s FROM te),
sc2 AS (SELECT heldout, method, s, sum(u) AS pos, sum(1 - u) AS neg FROM lab GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY heldout, method ORDER BY s) - neg AS below,
               sum(pos) OVER (PARTITION BY heldout, method ORDER BY s DESC) AS tp_ge,
               sum(neg) OVER (PARTITION BY heldout, method ORDER BY s DESC) AS fp_ge FROM sc2),
auc AS (SELECT heldout, method,
               CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS unknown_detection_auroc,
               CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(pos * tp_ge / (tp_ge + fp_ge)) / sum(pos) END AS unknown_detection_auprc
        FROM cum GROUP BY ALL),
ev2 AS (SELECT * FROM closed JOIN openm USING (heldout, method) JOIN rates USING (heldout, method)
        JOIN auc USING (heldout, method))
"""


EVAL_SQL = OPENSET_SQL + METRICS_SQL
EVAL_COLUMNS = """heldout, method, round(closed_known_accuracy, 6) AS closed_known_accuracy,
       round(closed_known_macro_f1, 6) AS closed_known_macro_f1,
       round(open_set_accuracy, 6) AS open_set_accuracy, round(open_set_macro_f1, 6) AS open_set_macro_f1,
       round(known_acceptance_rate, 6) AS known_acceptance_rate,
       round(unknown_rejection_rate, 6) AS unknown_rejection_rate, n_known_test::BIGINT AS n_known_test,
       n_unknown_test::BIGINT AS n_unknown_test,
       round(unknown_detection_auroc, 6) AS unknown_detection_auroc,
       round(unknown_detection_auprc, 6) AS unknown_detection_auprc"""


def openset_eval_df(spark, d, view: str = "embedding"):
    long, k = openset_scored(spark, d, view)
    thr = openset.thresholds(long.where(F.col("part") == "val"))
    test = long.where(F.col("part").isin("known_test", "unknown_test")).withColumn(
        "role", F.when(F.col("part") == "unknown_test", "unknown").otherwise("known"))
    # fixed open-set label list: the known classes plus "unknown" = all classes
    n_lab = thr.select("heldout", "method", F.lit(k).alias("n_labels"))
    return openset.evaluate(test, thr, n_lab)


@register("openset_eval", EVAL_SQL + f"SELECT {EVAL_COLUMNS} FROM ev2")
def openset_eval(spark, d):
    """M18, PF10, S5, J12, AG24–AG26: open-set metrics per held-out class and score."""
    from .metric_plans import r6
    return r6(openset_eval_df(spark, d))


@register("openset_rollup", EVAL_SQL + """
SELECT method, round(avg(open_set_macro_f1), 4) AS mean_open_set_macro_f1,
       round(avg(unknown_rejection_rate), 4) AS mean_unknown_rejection_rate,
       round(avg(known_acceptance_rate), 4) AS mean_known_acceptance_rate,
       round(avg(unknown_detection_auroc), 4) AS mean_unknown_detection_auroc
FROM ev2 GROUP BY method
""")
def openset_rollup(spark, d):
    """AG27, T8: mean open-set metrics per score method."""
    return openset.rollup(openset_eval_df(spark, d), by=["method"])


@register("openset_counts_eval", COUNTS_SQL + METRICS_SQL + f"SELECT {EVAL_COLUMNS} FROM ev2")
def openset_counts_eval(spark, d):
    """M18 on the count view: open-set metrics per held-out priority and score."""
    from .metric_plans import r6
    return r6(openset_eval_df(spark, d, "counts"))


def _view_rollup(view: str, sql: str) -> str:
    cols = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in openset.ROLLUP)
    return f"SELECT '{view}' AS view_request, method AS score_method, {cols} FROM ({sql} SELECT * FROM ev2) GROUP BY method"


@register("openset_view_rollup", " UNION ALL ".join(
    [_view_rollup("embedding", EVAL_SQL), _view_rollup("counts", COUNTS_SQL + METRICS_SQL)]))
def openset_view_rollup(spark, d):
    """Mean open-set metrics per view request and score method."""
    views = [openset_eval_df(spark, d, v).withColumn("view_request", F.lit(v)) for v in VIEWS]
    both = reduce(lambda a, b: a.unionByName(b), views).withColumnRenamed("method", "score_method")
    return openset.rollup(both)
