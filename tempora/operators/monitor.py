"""Walk-forward windows and retraining triggers.

Window membership is arithmetic on the date (no join): a row's test window is
``floor(days_since_start / days)``; training sizes are running sums over the
small per-window table.  Trigger logic runs on the window table (one row per
window, bounded by the time span).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def window_index(date: str | Column, start: str, days: int = config.WINDOW_DAYS) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.floor(F.datediff(d, F.to_date(F.lit(start))) / F.lit(days)).cast("long")


def windows(df: DataFrame, date: str = "date", label: str = "label", start: str = "2018-06-01",
            days: int = config.WINDOW_DAYS, min_train: int = config.MIN_TRAIN,
            min_test: int = config.MIN_TEST) -> DataFrame:
    """Expanding-window plan: boundaries every ``days`` from ``start`` while
    ``boundary + days <= max(date)``; train = date < boundary, test =
    [boundary, boundary + days).  Undated rows are in no window and train none.  Windows below the support guards are dropped.
    Returns ``window, boundary, test_start, test_end, n_train, n_test,
    families_present``."""
    idx = window_index(date, start, days)
    per = df.select(F.when(F.col(date) < F.to_date(F.lit(start)), F.lit(-1)).otherwise(idx).alias("window"),
                    F.col(label).alias("__lab"), F.col(date).alias("__d")).where(F.col(date).isNotNull())
    stats = per.groupBy("window").agg(F.count(F.lit(1)).alias("n_test"),
                                      F.count_distinct("__lab").alias("families_present"),
                                      F.max("__d").alias("__maxw"))
    # the per-window table is small (one row per window): plain windows over it
    w = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("n_train", F.coalesce(F.sum("n_test").over(w), F.lit(0)).cast("long"))
    stats = stats.withColumn("__max", F.max("__maxw").over(Window.partitionBy()))
    stats = stats.where(F.col("window") >= 0)
    stats = stats.withColumn("boundary", F.date_add(F.to_date(F.lit(start)), (F.col("window") * days).cast("int")))
    stats = stats.withColumn("test_end", F.date_add("boundary", days))
    out = stats.where(F.col("test_end") <= F.col("__max"))
    out = out.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    return out.select("window", "boundary", F.col("boundary").alias("test_start"), "test_end",
                      "n_train", "n_test", "families_present")


def assign_test_window(df: DataFrame, date: str, start: str, days: int = config.WINDOW_DAYS) -> DataFrame:
    """Tag each row with the window whose test period contains it."""
    return df.withColumn("window", window_index(date, start, days))


def triggers(df: DataFrame, metric: str = "api_macro_f1", order: str = "boundary",
             by: Sequence[str] = (), k: int = config.TRAILING, floor: float = config.FLOOR,
             margin: float = config.DROP_MARGIN) -> DataFrame:
    """Trailing mean of the previous ``k`` windows (NULL unless exactly k exist),
    floor and drop triggers, ``+``-joined reason, and ``retrain_recommended`` on
    the first window of each run of triggers."""
    w = Window.partitionBy(*by).orderBy(order)
    trail = w.rowsBetween(-k, -1)
    m = F.col(metric)
    out = df.withColumn("__cnt", F.count(m).over(trail)).withColumn(
        "trailing_mean_macro_f1", F.when(F.col("__cnt") == k, F.avg(m).over(trail)))
    out = out.withColumn("drop_from_trailing_mean", m - F.col("trailing_mean_macro_f1"))
    out = out.withColumn("floor_trigger", m < F.lit(floor))
    out = out.withColumn("drop_trigger", F.coalesce(
        m < F.col("trailing_mean_macro_f1") - F.lit(margin), F.lit(False)))
    out = out.withColumn("trigger", F.col("floor_trigger") | F.col("drop_trigger"))
    out = out.withColumn("trigger_reason", F.array_join(F.array_compact(F.array(
        F.when(F.col("floor_trigger"), F.lit("floor")),
        F.when(F.col("drop_trigger"), F.lit("trailing_mean_drop")))), "+"))
    prev = F.coalesce(F.lag("trigger").over(w), F.lit(False))
    out = out.withColumn("retrain_recommended", F.col("trigger") & ~prev)
    return out.drop("__cnt")


def episodes(trig: DataFrame, metric: str = "api_macro_f1", order: str = "boundary",
             by: Sequence[str] = ()) -> DataFrame:
    """Consecutive trigger windows collapse into episodes (gaps and islands):
    first/last boundary, first test start, last test end, the first window's
    reason, minimum metric, window count."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = trig.withColumn("episode", F.sum(F.col("retrain_recommended").cast("int")).over(w))
    t = t.where(F.col("trigger"))
    return t.groupBy(*by, "episode").agg(
        F.min(order).alias("start_boundary"), F.max(order).alias("end_boundary"),
        F.min("test_start").alias("start_test_start"), F.max("test_end").alias("end_test_end"),
        F.min_by("trigger_reason", F.col(order)).alias("trigger_reason"),
        F.min(metric).alias("min_macro_f1"), F.count(F.lit(1)).alias("n_windows"))


def trigger_summary(trig: DataFrame, metric: str = "api_macro_f1", order: str = "boundary",
                    by: Sequence[str] = ()) -> DataFrame:
    """Window / trigger / episode counts, min / max / mean metric (4 places) and
    the recommended retrain boundaries in order."""
    return trig.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("trigger").alias("n_trigger_windows"),
        F.count_if("retrain_recommended").alias("n_trigger_episodes"),
        F.round(F.min(metric), 4).alias("min_macro_f1"), F.round(F.max(metric), 4).alias("max_macro_f1"),
        F.round(F.avg(metric), 4).alias("mean_macro_f1"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("retrain_recommended"),
                                                        F.date_format(order, "yyyy-MM-dd")))), ",")
        .alias("recommended_retrain_boundaries"))
