"""Exact per-group positions without funnelling a group into one task.

``row_number() over (partition by g order by k)`` sends every row of a group to a
single task; with one class holding a third of all rows that task holds a third of
the data.  The helpers here rank through a *global range sort* instead, at every
size: Spark samples the sort key, splits even a single hot group over many
partitions, and the per-partition row counts (one row per partition) turn local
positions into global ones.  Only the small per-partition table is windowed as a whole.

Nulls are ordinary values: a null group is a group of its own, and a null order key
sorts last, so no row is lost and part sizes add up.

The sorted, position-tagged frame is written to the shared checkpoint folder, so both
passes see identical partitions, and a lost executor cannot reshuffle it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID = "__rt_pid"
_MID = "__rt_mid"


def _last(cols: Sequence[str | Column]) -> list[Column]:
    """Names sort ascending with nulls last; columns bring their own order."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left side's keys."""
    own = right.select(*[F.col(k).alias(f"__ns_{k}") for k in keys],
                       *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__ns_{k}")) for k in keys])
    return left.join(own, on, how).drop(*[f"__ns_{k}" for k in keys])


def _tag_sorted(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    return cut_lineage(tagged)


def running_total(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  value_cols: Sequence[str], out_suffix: str = "_cum",
                  partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` within ``group_cols`` in the
    order ``order_cols`` (a total order inside a group; nulls last).

    Equivalent to ``sum(v) over (partition by g order by k nulls last rows between
    unbounded preceding and current row)``, with every task bounded by the range
    sort.  Adds ``<v><out_suffix>`` columns.
    """
    tagged = _tag_sorted(df, _last(group_cols) + _last(order_cols), partitions)
    # position inside the partition, then a running sum inside the partition
    # (partitions are balanced by the range sort, so this window is bounded)
    w_local = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged
    for v in value_cols:
        local = local.withColumn(f"__rt_loc_{v}", F.sum(v).over(w_local))
    # totals per partition -> exclusive prefix over partitions (one row each)
    totals = tagged.groupBy(_PID).agg(*[F.sum(v).alias(f"__rt_tot_{v}") for v in value_cols])
    w_parts = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PID, *[F.coalesce(F.sum(f"__rt_tot_{v}").over(w_parts), F.lit(0)).alias(f"__rt_off_{v}")
                for v in value_cols])
    glob = local.join(F.broadcast(offsets), _PID)  # one row per partition: bounded
    for v in value_cols:
        glob = glob.withColumn(f"__rt_g_{v}", F.col(f"__rt_off_{v}") + F.col(f"__rt_loc_{v}"))
    if group_cols:
        first = F.struct(F.col(_PID), F.col(_MID))
        base = glob.groupBy(*group_cols).agg(
            *[F.min_by(F.col(f"__rt_g_{v}") - F.col(v), first).alias(f"__rt_base_{v}")
              for v in value_cols])
        glob = join_null_safe(glob, base, list(group_cols))
        for v in value_cols:
            glob = glob.withColumn(v + out_suffix, F.col(f"__rt_g_{v}") - F.col(f"__rt_base_{v}"))
    else:
        for v in value_cols:
            glob = glob.withColumn(v + out_suffix, F.col(f"__rt_g_{v}"))
    return glob.select(*df.columns, *[v + out_suffix for v in value_cols])


def row_number_within(df: DataFrame, group_cols: Sequence[str],
                      order_cols: Sequence[str | Column], out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` within groups, scalable for hot groups."""
    one = "__rn_one"
    ranked = running_total(df.withColumn(one, F.lit(1).cast("long")), group_cols,
                           order_cols, [one], partitions=partitions)
    return ranked.withColumnRenamed(one + "_cum", out).drop(one)
