"""Readers and sinks on hand-made files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tempora.operators import features
from tempora.sources import readers, reconcile

H1 = "a" * 64
H2 = "B" * 64


def test_read_labels_normalises(spark):
    d = tempfile.mkdtemp(prefix="tempora-lab-")
    with open(os.path.join(d, "labels.csv"), "w") as f:
        f.write(" SHA256 ,Detection_Date, Family ,extra\n")
        f.write(f" {H2} ,2019-01-02, Zeus ,x\n{H1},not a date,EMOTET,y\n")
    df = readers.read_labels(spark, os.path.join(d, "labels.csv"))
    rows = {r.sample_id: r for r in df.collect()}
    assert set(df.columns) == {"sample_id", "date", "label", "extra"}
    assert rows["b" * 64].label == "zeus" and str(rows["b" * 64].date) == "2019-01-02"
    assert rows[H1].date is None and rows[H1].label == "emotet"


def test_read_reports_names_and_malformed(spark):
    d = tempfile.mkdtemp(prefix="tempora-rep-")
    docs = {f"{H1}.json": {"behavior": {"summary": {"files": ["x"]}}}, f"{H2}.json": "{broken",
            f"._{H1}.json": {}, "notes.json": {}, "short.json": {}}
    for name, body in docs.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(body if isinstance(body, str) else json.dumps(body))
    empty = readers.read_reports(spark, d, "empty")
    assert sorted(r.sample_id for r in empty.collect()) == sorted([H1, "b" * 64])
    drop = readers.read_reports(spark, d, "drop")
    assert [r.sample_id for r in drop.collect()] == [H1]
    labels = spark.createDataFrame([(H1,), ("c" * 64,)], "sample_id string")
    att = readers.attach_reports(labels, drop).select("sample_id", F.to_json("report").alias("j")).collect()
    assert {r.sample_id: r.j for r in att}["c" * 64] == "{}"


def test_confusion_csv_and_walk_forward(spark):
    d = tempfile.mkdtemp(prefix="tempora-cm-")
    with open(os.path.join(d, "run1_confusion.csv"), "w") as f:
        f.write(",a,b\na,3,1\nb,0,2\n")
    long = readers.read_confusion(spark, os.path.join(d, "*_confusion.csv"))
    assert sorted((r.run, r.y_true, r.y_pred, r.n) for r in long.collect()) == [
        ("run1", "a", "a", 3), ("run1", "a", "b", 1), ("run1", "b", "a", 0), ("run1", "b", "b", 2)]
    with open(os.path.join(d, "wf.csv"), "w") as f:
        f.write("boundary,test_start,test_end,api_macro_f1\n2018-07-01,2018-07-01,2018-07-31,0.8\n"
                "2018-06-01,2018-06-01,2018-07-01,0.7\n")
    wf = readers.read_walk_forward(spark, os.path.join(d, "wf.csv")).collect()
    assert [str(r.boundary) for r in wf] == ["2018-06-01", "2018-07-01"]
    assert readers.first_existing([os.path.join(d, "nope"), os.path.join(d, "wf.csv")]).endswith("wf.csv")
    with pytest.raises(FileNotFoundError):
        readers.first_existing([os.path.join(d, "nope")])


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tempora-sink-")
    df = spark.createDataFrame([("r1", 1, "a", "a"), ("r2", 2, "b", "a")],
                               "run string, sample_id int, y_true string, y_pred string")
    readers.write_parquet(df, os.path.join(d, "pred"), ["run"])
    back = spark.read.parquet(os.path.join(d, "pred"))
    assert back.where(F.col("run") == "r2").count() == 1
    readers.write_csv(df, os.path.join(d, "csv"))
    readers.write_json_record(df.limit(1), os.path.join(d, "json"))
    assert spark.read.json(os.path.join(d, "json")).count() == 1


def test_reconcile_and_ingest(spark):
    labels = spark.createDataFrame([("x", "a", None), ("x", "a", None), ("y", "b", None)],
                                   "sample_id string, label string, date date")
    reports = spark.createDataFrame([("x",), ("z",)], "sample_id string")
    c = reconcile.reconcile_counts(labels, reports).first()
    assert (c.n_labels, c.n_label_ids, c.n_reports, c.n_matched, c.n_missing_reports, c.n_extra_reports) == \
        (3, 2, 2, 1, 1, 1)
    log = reconcile.ingest_log(labels).first()
    assert (log.n_labels, log.families) == (3, "a,b")
    feats = spark.createDataFrame([("x", 1.0)], "sample_id string, f double")
    with pytest.raises(ValueError):
        reconcile.align(feats, labels.select("sample_id", "label").distinct())


def test_resolve_views():
    assert features.resolve_views("api+fusion") == ["api_tfidf", "art_tfidf", "counts", "pe"]
    assert features.resolve_views("pe_scaled, api_hash") == ["pe", "api_hash"]
    with pytest.raises(ValueError):
        features.resolve_views("bogus")
