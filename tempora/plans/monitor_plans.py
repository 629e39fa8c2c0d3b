"""Walk-forward monitoring on ``orders``: 30-day expanding windows from
1995-03-01; the per-window metric comes from a deterministic prediction whose
error rate cycles with the month (so triggers fire), identical in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, monitor
from .catalog import register, table
from .metric_plans import PRIORITIES, _ARR_SQL, r6

START = "1995-03-01"
DAYS = 30
MIN_TRAIN, MIN_TEST = 500, 50


def drifting_predictions(spark, d):
    o = table(spark, d, "orders")
    date = F.to_date("o_orderdate")
    wrong = (F.col("o_orderkey") % 10) < (1 + ((F.year(date) * 12 + F.month(date)) % 5))
    other = F.element_at(F.array(*[F.lit(c) for c in PRIORITIES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("sample_id"), date.alias("date"),
                    F.col("o_orderpriority").alias("label"),
                    F.when(wrong, other).otherwise(F.col("o_orderpriority")).alias("y_pred"))


def walk_forward(spark, d):
    p = drifting_predictions(spark, d)
    win = monitor.windows(p, "date", "label", START, DAYS, MIN_TRAIN, MIN_TEST)
    tagged = monitor.assign_test_window(p, "date", START, DAYS)
    f1 = metrics.summary(tagged, ["window"], "label", "y_pred").select(
        "window", F.col("macro_f1").alias("api_macro_f1"))
    return win.join(f1, "window")


WF_SQL = f"""
WITH p AS (SELECT o_orderkey AS sample_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS label,
                  CASE WHEN o_orderkey % 10 < 1 + ((year(o_orderdate) * 12 + month(o_orderdate)) % 5)
                       THEN {_ARR_SQL}[o_custkey % 5 + 1] ELSE o_orderpriority END AS y_pred
           FROM orders),
t AS (SELECT *, CASE WHEN date < DATE '{START}' THEN -1
                     ELSE CAST(floor(datediff('day', DATE '{START}', date) / {DAYS}) AS BIGINT) END AS wi
      FROM p),
st AS (SELECT wi, count(*) AS n_test, count(DISTINCT label) AS families_present FROM t GROUP BY wi),
st2 AS (SELECT *, coalesce(sum(n_test) OVER (ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           0) AS n_train,
               DATE '{START}' + CAST(wi * {DAYS} AS INTEGER) AS boundary FROM st),
win AS (SELECT * FROM st2 WHERE wi >= 0 AND boundary + {DAYS} <= (SELECT max(date) FROM p)
        AND n_train >= {MIN_TRAIN} AND n_test >= {MIN_TEST}),
roles AS (SELECT wi, label AS class, 1 AS t, (label = y_pred)::INT AS tp, 0 AS p FROM t WHERE wi >= 0
          UNION ALL SELECT wi, y_pred, 0, 0, 1 FROM t WHERE wi >= 0),
cc AS (SELECT wi, class, sum(t) AS support, sum(tp) AS tp, sum(p) AS n_pred FROM roles GROUP BY ALL),
pq AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM cc),
f AS (SELECT wi, avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) AS api_macro_f1
      FROM pq GROUP BY wi),
wf AS (SELECT win.wi, boundary, boundary AS test_start, boundary + {DAYS} AS test_end, n_train, n_test,
              families_present, api_macro_f1 FROM win JOIN f USING (wi)),
tr AS (SELECT *, count(api_macro_f1) OVER w3 AS cnt, avg(api_macro_f1) OVER w3 AS am FROM wf
       WINDOW w3 AS (ORDER BY boundary ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
tr2 AS (SELECT *, CASE WHEN cnt = 3 THEN am END AS trailing_mean_macro_f1 FROM tr),
tr3 AS (SELECT *, api_macro_f1 < 0.75 AS floor_trigger,
               coalesce(api_macro_f1 < trailing_mean_macro_f1 - 0.1, false) AS drop_trigger FROM tr2),
tr4 AS (SELECT *, floor_trigger OR drop_trigger AS trigger,
               concat_ws('+', CASE WHEN floor_trigger THEN 'floor' END,
                         CASE WHEN drop_trigger THEN 'trailing_mean_drop' END) AS trigger_reason FROM tr3),
trig AS (SELECT *, trigger AND NOT coalesce(lag(trigger) OVER (ORDER BY boundary), false) AS retrain_recommended
         FROM tr4)
"""


@register("walk_forward_windows", WF_SQL + """
SELECT strftime(boundary, '%Y-%m-%d') AS boundary, strftime(test_start, '%Y-%m-%d') AS test_start,
       strftime(test_end, '%Y-%m-%d') AS test_end, n_train, n_test, families_present,
       round(api_macro_f1, 6) AS api_macro_f1 FROM wf
""")
def walk_forward_windows(spark, d):
    """M14 (windows), J7, PF6, PF7, AG5, F17: expanding windows and their metric."""
    wf = walk_forward(spark, d).drop("window")
    for c in ("boundary", "test_start", "test_end"):
        wf = wf.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return r6(wf)


def _trig(spark, d):
    return monitor.triggers(walk_forward(spark, d).drop("window"))


@register("retrain_triggers", WF_SQL + """
SELECT strftime(boundary, '%Y-%m-%d') AS boundary, round(api_macro_f1, 6) AS api_macro_f1,
       round(trailing_mean_macro_f1, 6) AS trailing_mean_macro_f1,
       round(api_macro_f1 - trailing_mean_macro_f1, 6) AS drop_from_trailing_mean,
       floor_trigger, drop_trigger, trigger, trigger_reason, retrain_recommended FROM trig
""")
def retrain_triggers(spark, d):
    """Trailing mean, floor / drop triggers, retrain flags."""
    t = _trig(spark, d).select(F.date_format("boundary", "yyyy-MM-dd").alias("boundary"), "api_macro_f1",
                               "trailing_mean_macro_f1", "drop_from_trailing_mean", "floor_trigger",
                               "drop_trigger", "trigger", "trigger_reason", "retrain_recommended")
    return r6(t)


@register("retrain_episodes", WF_SQL + """
, ep AS (SELECT *, sum(retrain_recommended::INT) OVER (ORDER BY boundary ROWS UNBOUNDED PRECEDING) AS episode
         FROM trig)
SELECT episode::BIGINT AS episode, strftime(min(boundary), '%Y-%m-%d') AS start_boundary,
       strftime(max(boundary), '%Y-%m-%d') AS end_boundary,
       strftime(min(test_start), '%Y-%m-%d') AS start_test_start,
       strftime(max(test_end), '%Y-%m-%d') AS end_test_end,
       arg_min(trigger_reason, boundary) AS trigger_reason, round(min(api_macro_f1), 6) AS min_macro_f1,
       count(*) AS n_windows
FROM ep WHERE trigger GROUP BY episode
""")
def retrain_episodes(spark, d):
    """W6, AG36: trigger episodes (gaps and islands)."""
    e = monitor.episodes(_trig(spark, d))
    for c in ("start_boundary", "end_boundary", "start_test_start", "end_test_end"):
        e = e.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return r6(e)


@register("trigger_summary", WF_SQL + """
SELECT count(*) AS n_windows, coalesce(count_if(trigger), 0)::BIGINT AS n_trigger_windows,
       coalesce(count_if(retrain_recommended), 0)::BIGINT AS n_trigger_episodes,
       round(min(api_macro_f1), 4) AS min_macro_f1, round(max(api_macro_f1), 4) AS max_macro_f1,
       round(avg(api_macro_f1), 4) AS mean_macro_f1,
       coalesce(string_agg(CASE WHEN retrain_recommended THEN strftime(boundary, '%Y-%m-%d') END, ','
                           ORDER BY boundary), '') AS recommended_retrain_boundaries
FROM trig
""")
def trigger_summary(spark, d):
    """AG30: trigger summary."""
    return monitor.trigger_summary(_trig(spark, d))
