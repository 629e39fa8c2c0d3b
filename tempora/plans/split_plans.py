"""Splits on the driver tables: ``orders`` stand in for labelled samples
(id ``o_orderkey``, class ``o_orderpriority``, date ``o_orderdate``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from .catalog import register, table


def samples(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("label"),
        F.to_date("o_orderdate").alias("date"))


# DuckDB side: the same definitions written as plain SQL
SAMPLES_SQL = ("SELECT o_orderkey AS sample_id, o_orderpriority AS label, "
               "CAST(o_orderdate AS DATE) AS date FROM orders")


def apportion_sql(src: str, weight: str, total: str, out: str) -> str:
    return f"""
  SELECT *, f + CASE WHEN rr <= extra THEN 1 ELSE 0 END AS {out} FROM (
    SELECT *, tot - sum(f) OVER () AS extra,
           row_number() OVER (ORDER BY r DESC, label) AS rr FROM (
      SELECT s.*, tot,
             CASE WHEN sw > 0 THEN (tot::HUGEINT * {weight}) // sw ELSE 0 END::BIGINT AS f,
             CASE WHEN sw > 0 THEN (tot::HUGEINT * {weight}) % sw ELSE 0 END AS r
      FROM (SELECT *, sum({weight}) OVER () AS sw, {total} AS tot FROM {src}) s))"""


def random_sql(samples_sql: str) -> str:
    """Exact-quota stratified random split over ``samples_sql`` (sample_id, label)."""
    return f"""
WITH smp AS ({samples_sql}),
c AS (SELECT label, count(*) AS n_c FROM smp GROUP BY label),
c1 AS (SELECT label, n_c, q_test FROM ({apportion_sql(
    "c", "n_c", "CAST(ceil(CAST(sum(n_c) OVER () AS DOUBLE) * 0.19999999999999996) AS BIGINT)",
    "q_test")})),
c2 AS (SELECT label, n_c, q_test, n_c - q_test AS n_trainall FROM c1),
c3 AS (SELECT label, n_c, q_test, q_val FROM ({apportion_sql(
    "c2", "n_trainall", "CAST(ceil(CAST(sum(n_trainall) OVER () AS DOUBLE) * 0.1) AS BIGINT)",
    "q_val")})),
ranked AS (SELECT smp.sample_id, smp.label,
                  row_number() OVER (PARTITION BY smp.label
                                     ORDER BY md5(CAST(smp.sample_id AS VARCHAR) || '|42'),
                                              smp.sample_id) AS rk
           FROM smp)
SELECT r.sample_id, r.label,
       CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_val THEN 'val'
            ELSE 'train' END AS part
FROM ranked r JOIN c3 USING (label)
"""


RANDOM_SQL = random_sql(SAMPLES_SQL)


def chrono_sql(partition: str, min_val: int) -> str:
    val = "floor(CAST(sp AS DOUBLE) * 0.1)"
    if min_val:
        val = f"greatest({val}, {min_val})"
    part_by = f"PARTITION BY {partition}" if partition else ""
    return f"""
WITH smp AS ({SAMPLES_SQL}),
ranked AS (SELECT sample_id, label, date,
                  row_number() OVER ({part_by} ORDER BY date, sample_id) AS rk,
                  count(*) OVER ({part_by}) AS n FROM smp),
cut AS (SELECT *, CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) AS sp FROM ranked),
cut2 AS (SELECT *, greatest(sp - CAST({val} AS BIGINT), 0) AS tr FROM cut)
SELECT sample_id, label, strftime(date, '%Y-%m-%d') AS date,
       CASE WHEN rk <= tr THEN 'train' WHEN rk <= sp THEN 'val' ELSE 'test' END AS part
FROM cut2
"""


@register("split_random_stratified", RANDOM_SQL)
def split_random_stratified(spark, d):
    """Exact-quota stratified random split (md5 order, largest remainder)."""
    return splits.random_stratified(samples(spark, d).drop("date"), "sample_id", "label")


@register("split_global_chrono", chrono_sql("", 0) + "")
def split_global_chrono(spark, d):
    """Global chronological split, ties broken by id."""
    out = splits.global_chronological(samples(spark, d), "sample_id", "date")
    return out.select("sample_id", "label", F.date_format("date", "yyyy-MM-dd").alias("date"), "part")


@register("split_global_boundary", """
WITH smp AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders),
r AS (SELECT date, row_number() OVER (ORDER BY date, o_orderkey) AS rk, count(*) OVER () AS n FROM smp),
c AS (SELECT *, CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) AS sp FROM r)
SELECT strftime(min(CASE WHEN rk = sp + 1 THEN date END), '%Y-%m-%d') AS boundary_date,
       any_value(sp - CAST(floor(CAST(sp AS DOUBLE) * 0.1) AS BIGINT)) AS n_train,
       any_value(CAST(floor(CAST(sp AS DOUBLE) * 0.1) AS BIGINT)) AS n_val,
       any_value(n - sp) AS n_test
FROM c
""")
def split_global_boundary(spark, d):
    """W1 facts: boundary date and part sizes from the date histogram."""
    f = splits.global_boundary(samples(spark, d), "date")
    return f.withColumn("boundary_date", F.date_format("boundary_date", "yyyy-MM-dd"))


@register("split_per_class_chrono", chrono_sql("label", 1))
def split_per_class_chrono(spark, d):
    """Per-class chronological split with val = max(1, int(0.1·train_all))."""
    out = splits.per_class_chronological(samples(spark, d), "sample_id", "label", "date")
    return out.select("sample_id", "label", F.date_format("date", "yyyy-MM-dd").alias("date"), "part")


@register("split_sizes", f"""
SELECT 'random_stratified' AS split, part, count(*) AS n FROM ({RANDOM_SQL}) GROUP BY part
UNION ALL
SELECT 'global_chronological', part, count(*) FROM ({chrono_sql("", 0)}) GROUP BY part
UNION ALL
SELECT 'per_class_chronological', part, count(*) FROM ({chrono_sql("label", 1)}) GROUP BY part
""")
def split_sizes(spark, d):
    """AG4: part sizes of the three splits."""
    s = samples(spark, d)
    return (splits.sizes(splits.random_stratified(s.drop("date"), "sample_id", "label"),
                         "random_stratified")
            .unionByName(splits.sizes(splits.global_chronological(s, "sample_id", "date"),
                                      "global_chronological"))
            .unionByName(splits.sizes(splits.per_class_chronological(s, "sample_id", "label", "date"),
                                      "per_class_chronological")))


HELDOUT_SQL = f"""
WITH smp AS ({SAMPLES_SQL}),
cls AS (SELECT DISTINCT label AS heldout FROM smp),
known AS (SELECT h.heldout, s.* FROM cls h JOIN smp s ON s.label <> h.heldout),
ranked AS (SELECT *, row_number() OVER (PARTITION BY heldout ORDER BY date, sample_id) AS rk,
                  count(*) OVER (PARTITION BY heldout) AS n FROM known),
cut AS (SELECT *, CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) AS sp FROM ranked),
cut2 AS (SELECT *, greatest(sp - CAST(greatest(floor(CAST(sp AS DOUBLE) * 0.1), 1) AS BIGINT), 0) AS tr
         FROM cut),
kparts AS (SELECT heldout, sample_id, label, date,
                  CASE WHEN rk <= tr THEN 'train' WHEN rk <= sp THEN 'val' ELSE 'known_test' END AS part,
                  rk, sp, tr, n FROM cut2),
bounds AS (SELECT heldout, min(CASE WHEN rk = sp + 1 THEN date END) AS boundary_date,
                  any_value(tr) AS n_train, any_value(sp - tr) AS n_val, any_value(n - sp) AS n_known_test
           FROM kparts GROUP BY heldout),
unk AS (SELECT b.heldout, s.sample_id, s.label, s.date, 'unknown_test' AS part
        FROM bounds b JOIN smp s ON s.label = b.heldout AND s.date >= b.boundary_date),
facts AS (SELECT b.*, coalesce(u.n_unknown_test, 0) AS n_unknown_test FROM bounds b
          LEFT JOIN (SELECT heldout, count(*) AS n_unknown_test FROM unk GROUP BY heldout) u
          USING (heldout)),
kept AS (SELECT * FROM facts WHERE n_unknown_test >= 25)
"""


@register("split_heldout", HELDOUT_SQL + """
SELECT heldout, sample_id, label, part FROM kparts WHERE heldout IN (SELECT heldout FROM kept)
UNION ALL
SELECT heldout, sample_id, label, part FROM unk WHERE heldout IN (SELECT heldout FROM kept)
""")
def split_heldout(spark, d):
    """W3, J8, J9, PF7, PF8: known/unknown splits per held-out class."""
    parts, _ = splits.heldout_class(samples(spark, d), "sample_id", "label", "date")
    return parts.select("heldout", "sample_id", "label", "part")


@register("split_heldout_facts", HELDOUT_SQL + """
SELECT heldout, strftime(boundary_date, '%Y-%m-%d') AS boundary_date, n_train, n_val,
       n_known_test, n_unknown_test FROM kept
""")
def split_heldout_facts(spark, d):
    """W3 facts: boundary, train/val/known/unknown sizes per held-out class."""
    _, facts = splits.heldout_class(samples(spark, d), "sample_id", "label", "date")
    return facts.withColumn("boundary_date", F.date_format("boundary_date", "yyyy-MM-dd"))


@register("kfold_assign", f"""
WITH smp AS ({SAMPLES_SQL}),
cls AS (SELECT label, count(*) AS n, min(sample_id) AS first FROM smp GROUP BY label),
place AS (SELECT label, sum(n) OVER (ORDER BY first) - n AS s, sum(n) OVER (ORDER BY first) AS e FROM cls),
share AS (SELECT label, fold, floor((e - 1 - fold) / 5) - floor((s - 1 - fold) / 5) AS m
          FROM place, (SELECT unnest(range(5)) AS fold) f),
upto AS (SELECT label, fold, sum(m) OVER (PARTITION BY label ORDER BY fold) AS hi,
                sum(m) OVER (PARTITION BY label ORDER BY fold) - m AS lo FROM share),
ranked AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS rk FROM smp)
SELECT sample_id, r.label, CAST(fold AS INTEGER) AS fold
FROM ranked r JOIN upto u ON r.label = u.label AND rk > lo AND rk <= hi
""")
def kfold_assign(spark, d):
    """Stratified 5-fold assignment with the library's fold sizes."""
    return splits.kfold(samples(spark, d).drop("date"), "sample_id", "label", 5)
