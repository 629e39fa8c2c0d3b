"""The audit moves hits, not segments; short rows are dealt by their number."""

from pyspark.sql import functions as F

from tempora.operators import audit
from tempora.plans import report_plans
from tempora.plans.catalog import ROWS_PER_TASK, table

VOCAB = {"a": ["mit", "Token"], "b": ["token"]}


def test_segments_outside_the_vocabulary_leave_no_task(spark, capsys):
    text = "token " + " ".join(f"w{i}" for i in range(3000)) + " MIT mit"
    df = spark.range(40).select(F.col("id").alias("sample_id"), F.lit("f").alias("field"),
                                F.concat(F.lit(text), F.col("id").cast("string")).alias("value")).repartition(4)
    hits = audit.scan(df, VOCAB)
    got = sorted((h.sample_id, h.match_type, h.matched_term, h.value == text[:200]) for h in hits.collect())
    assert got == sorted((i, t, w, True) for i in range(40) for t, w in (("a", "mit"), ("a", "token"), ("b", "token")))
    hits.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(term" not in plan.split("BroadcastExchange")[0]


def test_a_table_of_terms_gives_the_same_hits(spark):
    df = spark.createDataFrame([(1, "f", "mit x"), (2, "f", None), (3, "f", "TOKEN token")],
                               "sample_id long, field string, value string")
    by_map, by_table = audit.scan(df, VOCAB), audit.scan(df, audit.vocabulary_frame(spark, VOCAB))
    assert sorted(by_map.collect()) == sorted(by_table.collect()) and by_map.count() == 3


def test_events_are_dealt_by_rows(spark, tmp_path):
    n = 8 * ROWS_PER_TASK["events"] + 1
    spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"),
                          F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
                          F.lit('{"k": 3}').alias("props")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert table(spark, str(tmp_path), "events").rdd.getNumPartitions() == 9
    assert report_plans.report_counts(spark, str(tmp_path)).count() == n
