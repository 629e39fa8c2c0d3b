"""Scalable ranking and split invariants, against brute-force windows, with a
class holding most of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.operators import ranking, splits


def skewed(spark, n=5000):
    # class "hot" holds ~70 % of rows; dates with heavy ties
    return spark.range(n).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")))
        .alias("label"),
        F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("id") * 7919 % 97).cast("int")).alias("date"),
        ((F.col("id") * 31) % 17).cast("double").alias("x"))


def test_row_number_within_matches_window(spark):
    df = skewed(spark)
    got = ranking.row_number_within(df, ["label"], ["date", "sample_id"], out="r", partitions=7)
    fast = ranking.row_number_within(df, ["label"], ["date", "sample_id"], out="r")
    assert got.columns == fast.columns
    assert got.exceptAll(fast).count() == 0
    exp = df.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("date", "sample_id")))
    assert got.select("sample_id", "r").exceptAll(exp.select("sample_id", "r")).count() == 0
    assert got.count() == df.count()


def test_running_total_matches_window(spark):
    df = skewed(spark).groupBy("label", "x").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.running_total(df, ["label"], ["x"], ["n"], partitions=5)
    w = Window.partitionBy("label").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("n_cum", F.sum("n").over(w))
    assert got.select("label", "x", "n_cum").exceptAll(exp.select("label", "x", "n_cum")).count() == 0


def _brute_chrono(df, min_val):
    w = Window.partitionBy("label").orderBy("date", "sample_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    sp = F.floor(n.cast("double") * 0.8)
    val = F.floor(sp * 0.1)
    val = F.greatest(val, F.lit(min_val))
    tr = F.greatest(sp - val, F.lit(0))
    r = F.row_number().over(w)
    return df.withColumn("part", F.when(r <= tr, "train").when(r <= sp, "val").otherwise("test"))


def test_per_class_chronological_matches_brute_force(spark):
    df = skewed(spark)
    got = splits.per_class_chronological(df, "sample_id", "label", "date")
    exp = _brute_chrono(df, 1)
    assert got.select("sample_id", "part").exceptAll(exp.select("sample_id", "part")).count() == 0


def test_random_stratified_exact_quotas(spark):
    df = skewed(spark, 4001)
    parts = splits.random_stratified(df, "sample_id", "label", seed=7)
    assert parts.count() == 4001 and parts.select("sample_id").distinct().count() == 4001
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert (sizes["train"], sizes["val"], sizes["test"]) == splits.expected_random_sizes(4001)
    per = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    n_hot = df.where(F.col("label") == "hot").count()
    assert abs(per[("hot", "test")] - 0.2 * n_hot) <= 1
    again = splits.random_stratified(df, "sample_id", "label", seed=7)
    assert parts.exceptAll(again).count() == 0  # deterministic


def test_heldout_split_invariants(spark):
    df = skewed(spark, 3000)
    parts, facts = splits.heldout_class(df, "sample_id", "label", "date", min_unknown=1)
    f = {r.heldout: r for r in facts.collect()}
    for h, r in f.items():
        p = parts.where(F.col("heldout") == h)
        known = p.where(F.col("part") != "unknown_test")
        assert known.where(F.col("label") == h).count() == 0
        assert known.count() == r.n_train + r.n_val + r.n_known_test
        unk = p.where(F.col("part") == "unknown_test")
        assert unk.where(F.col("date") < F.lit(r.boundary_date)).count() == 0


def test_kfold_blocks(spark):
    df = skewed(spark, 1003)
    f = splits.kfold(df, "sample_id", "label", 5)
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.count(F.lit(1)).alias("k")).collect()
    assert all(r.spread <= 1 and r.k == 5 for r in sizes)
