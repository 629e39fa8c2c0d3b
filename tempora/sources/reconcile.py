"""Label <-> report reconciliation (set algebra over distinct ids as shuffles)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_counts(labels: DataFrame, reports: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row: label rows, distinct label ids, distinct report ids, matched,
    missing reports, extra reports.  A single ``groupBy(id)`` over the tagged union
    replaces two joins; partial aggregation collapses repeated ids map-side."""
    tagged = (labels.select(F.col(id_col).alias("__id"), F.lit(1).alias("__l"), F.lit(0).alias("__r"))
              .unionByName(reports.select(F.col(id_col).alias("__id"), F.lit(0).alias("__l"),
                                          F.lit(1).alias("__r"))))
    per_id = tagged.groupBy("__id").agg(F.sum("__l").alias("nl"), F.max("__r").alias("hr"))
    return per_id.agg(
        F.sum("nl").cast("long").alias("n_labels"),
        F.count_if(F.col("nl") > 0).alias("n_label_ids"),
        F.count_if(F.col("hr") == 1).alias("n_reports"),
        F.count_if((F.col("nl") > 0) & (F.col("hr") == 1)).alias("n_matched"),
        F.count_if((F.col("nl") > 0) & (F.col("hr") == 0)).alias("n_missing_reports"),
        F.count_if((F.col("nl") == 0) & (F.col("hr") == 1)).alias("n_extra_reports"))


def flag_reports(labels: DataFrame, reports: DataFrame, id_col: str = "sample_id",
                 flag: str = "has_report") -> DataFrame:
    """Every label row plus a boolean: does a report with this id exist?"""
    ids = reports.select(id_col).distinct().withColumn("__has", F.lit(True))
    return labels.join(ids, id_col, "left").withColumn(
        flag, F.coalesce(F.col("__has"), F.lit(False))).drop("__has")


def first_missing(have: DataFrame, want: DataFrame, id_col: str = "sample_id",
                  n: int = 10) -> DataFrame:
    """The ``n`` smallest ids of ``have`` that ``want`` lacks (top-k, not a full sort):
    labelled ids without a report, or reports without a label."""
    ids = have.select(id_col).distinct()
    return ids.join(want.select(id_col), id_col, "left_anti").orderBy(id_col).limit(n)


def dedupe_by_source(df: DataFrame, key: str, rank_cols: Sequence[str],
                     keep: Sequence[str]) -> DataFrame:
    """First writer wins per ``key``: the row with the smallest ``rank_cols``.
    ``min(struct)`` is a partial aggregate, so a key with a third of all rows is
    reduced on every map task before the shuffle."""
    packed = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rank_cols)],
                      *[F.col(c).alias(f"k_{c}") for c in keep])
    agg = df.groupBy(key).agg(F.min(packed).alias("__w"), F.count(F.lit(1)).alias("n_copies"))
    return agg.select(key, *[F.col(f"__w.k_{c}").alias(c) for c in keep], "n_copies")


def source_rank(order: Sequence[str], source_col: str = "source_name") -> F.Column:
    """Fixed source precedence: the position in ``order``; unknown sources after."""
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source_col))
    return F.when(pos == 0, F.lit(len(order) + 1)).otherwise(pos)


def ingest_log(labels: DataFrame, label: str = "label", date: str = "date") -> DataFrame:
    """One row: label rows, first / last date, the sorted distinct classes (joined
    with ``,``) — distinct classes are a partial aggregation, never a row list."""
    classes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("__n"),
                                        F.min(date).alias("__dmin"), F.max(date).alias("__dmax"))
    return classes.agg(F.sum("__n").cast("long").alias("n_labels"),
                       F.min("__dmin").alias("date_min"), F.max("__dmax").alias("date_max"),
                       F.count(F.lit(1)).alias("n_classes"),
                       F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), ",")
                       .alias("families"))


def class_counts(labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class."""
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def align(features: DataFrame, labels: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Inner join of a feature view with its labels; raises when any sample is
    missing on either side (the row-count check of a feature/label alignment)."""
    j = features.join(labels, id_col, "full")
    lc = [c for c in labels.columns if c != id_col][0]
    fc = [c for c in features.columns if c != id_col][0]
    bad = j.where(F.col(lc).isNull() | F.col(fc).isNull()).limit(1).count()
    if bad:
        raise ValueError("feature rows do not match label rows")
    return features.join(labels, id_col)
