"""Null keys, duplicate terms, undated rows: expectations written by hand."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tempora.functions import report, text
from tempora.operators import audit, metrics, monitor, splits


def frame(spark, n=100):
    """Every fifth row undated, every tenth without a class; one class holds most."""
    return spark.range(n).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 10 != 0, F.when(F.col("id") % 9 == 1, "rare").otherwise("hot")).alias("label"),
        F.when(F.col("id") % 5 != 0, F.date_add(F.lit("2018-01-01").cast("date"), F.col("id").cast("int"))).alias("date"))


def test_split_parts_add_up_with_nulls(spark):
    df = frame(spark)
    parts = splits.global_chronological(df, "sample_id", "date")
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 72, "val": 8, "test": 20}
    # undated rows come last: the twenty of them are the test part
    assert parts.where("part = 'test' and date is not null").isEmpty()
    for out in (splits.per_class_chronological(df, "sample_id", "label", "date"),
                splits.random_stratified(df, "sample_id", "label"), splits.kfold(df, "sample_id", "label")):
        assert out.count() == 100 and out.select("sample_id").distinct().count() == 100


def test_undated_rows_train_no_window(spark):
    df = spark.sql("SELECT explode(sequence(date'2018-06-01', date'2018-12-31')) AS date, 'a' AS label")
    some = df.unionByName(spark.range(100).select(F.lit(None).cast("date").alias("date"), F.lit("a").alias("label")))
    plan = lambda d: monitor.windows(d, min_train=0, min_test=1).orderBy("window").collect()
    assert plan(some) == plan(df) and plan(df)[0].n_train == 0


@pytest.mark.parametrize("n_terms", [10, 10_000])
def test_vocabulary_size_and_duplicates_do_not_matter(spark, n_terms):
    vocab = {"family_name": ["zeus", "ZEUS"], "detection_indicator": [f"term{i}" for i in range(n_terms)]}
    values = spark.createDataFrame([(1, "f", "C:\\zeus\\Zeus\\term3.exe"), (2, "f", "clean"), (3, "f", None)],
                                   "sample_id long, field string, value string")
    hits = sorted((r.sample_id, r.match_type, r.matched_term) for r in audit.scan(values, vocab).collect())
    assert hits == [(1, "detection_indicator", "term3"), (1, "family_name", "zeus")]


def test_words_by_hand(spark):
    row = spark.createDataFrame([("cafe\u0301s \u0939\u093f\u0928\u094d\u0926\u0940 ab_1 x na\u00efve",)], "t string")
    assert row.select(text.words("t")).first()[0] == ["cafe", "ab_1", "na\u00efve"]


def test_confusion_keeps_zero_cells_of_every_run(spark):
    pred = spark.createDataFrame([("r1", "a", "a"), ("r2", "b", "a")], "run string, y_true string, y_pred string")
    got = {(r.run, r.y_true, r.y_pred): r.n for r in metrics.confusion(pred, ["run"], classes=["a", "b"]).collect()}
    assert len(got) == 8 and got["r1", "a", "a"] == 1 and got["r2", "b", "a"] == 1 and sum(got.values()) == 2


def test_many_sections_take_linear_time(spark):
    body = json.dumps({"static": {"pe": {"sections": [{"entropy": float(i % 7)} for i in range(5000)]}}})
    df = spark.createDataFrame([(body,)], "j string").select(F.parse_json("j").alias("v"))
    began = time.time()
    std = df.select(*report.pe_features("v")).first()["pe_std_entropy"]
    mean = sum(i % 7 for i in range(5000)) / 5000
    assert std == pytest.approx((sum((i % 7 - mean) ** 2 for i in range(5000)) / 5000) ** 0.5)
    assert time.time() - began < 60
