"""Streaming jobs equal their batch counterparts; explanation casebook."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tempora.operators import audit, explain, metrics
from tempora.sources import readers
from tempora.streaming import jobs

VOCAB = {"indicator": ["license", "apache", "mit"], "label": ["the", "and"]}


def test_audit_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tempora-src-")
    out = tempfile.mkdtemp(prefix="tempora-out-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("sample_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    docs.repartition(3).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.start_audit_stream(stream, VOCAB, out, checkpoint=os.path.join(out, "_ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(out).drop("batch_id")
    exp = audit.scan(docs, VOCAB)
    assert got.count() == exp.count() > 0
    assert got.exceptAll(exp).count() == 0


def test_window_monitor_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tempora-src-")
    out = tempfile.mkdtemp(prefix="tempora-out-")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    p = o.select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("y_true"),
                 F.when(F.col("o_orderkey") % 10 < 3, F.lit("5-LOW")).otherwise(F.col("o_orderpriority"))
                 .alias("y_pred"))
    p.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(p.schema).parquet(src)
    q = jobs.start_window_monitor(stream, out, window="30 days", watermark="0 days",
                                  checkpoint=os.path.join(out, "_ckpt"))
    q.awaitTermination(300)
    got = {r.window_start: r.macro_f1 for r in spark.read.parquet(out).collect()}
    batch = p.withColumn("w", F.window("ts", "30 days").start)
    exp = {r.w: r.macro_f1 for r in metrics.summary(batch, ["w"]).collect()}
    # with availableNow the final watermark closes every window but the last
    assert len(got) >= len(exp) - 1 and len(got) > 0
    for k, v in got.items():
        assert abs(v - exp[k]) < 1e-12


def test_casebook_from_run_folders(spark):
    root = tempfile.mkdtemp(prefix="tempora-runs-")
    for run, views in (("run_a", ["api_tfidf"]), ("run_b", ["counts"]), ("run_c", ["art_tfidf"])):
        d = os.path.join(root, run)
        os.makedirs(d)
        with open(os.path.join(d, "metadata.json"), "w") as f:
            json.dump({"views": views, "view_request": views[0], "split": "global", "model": "sgd"}, f)
        with open(os.path.join(d, "case_overview.csv"), "w") as f:
            f.write("case_label,sha256,true_family,predicted_family\ncase1,abc,zeus,zeus\n")
        if run != "run_c":  # run_c lacks its contributions file -> skipped
            with open(os.path.join(d, "case_feature_contributions.csv"), "w") as f:
                f.write("case_label,side,rank,feature_name,contribution\n")
                for i in range(8):
                    f.write(f"case1,supporting,{i + 1},api::tok{i},0.{9 - i}\n")
                f.write("case1,opposing,1,counts::x,0.1\ncase1,opposing,2,artifact::file,0.2\n")
    cases, contrib = readers.read_runs(spark, root)
    assert sorted(r.run_name for r in cases.select("run_name").distinct().collect()) == ["run_a"]
    toks = explain.token_rows(contrib, 6)
    assert toks.where(F.col("side") == "supporting").count() == 6
    assert [r.feature_name for r in toks.where(F.col("side") == "opposing").collect()] == ["artifact::file"]
    m = explain.manifest(cases, toks).first()
    assert (m.runs_included, m.cases_exported, m.token_rows_exported) == (1, 1, 7)
    book = explain.casebook(cases, toks)
    assert book.count() == 7
