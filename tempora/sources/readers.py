"""Readers and sinks.  Each is a plain ``spark.read`` / ``df.write`` with the
schema handling the evaluated study needs."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

HEX_NAME = r"^(?!\._)([0-9a-fA-F]{64})\.json$"


def read_labels(spark: SparkSession, path: str, id_hint: str = "sha",
                date_hint: str = "date", label_hint: str = "family") -> DataFrame:
    """Label CSV: names stripped and lower-cased; the first column containing each
    hint becomes ``sample_id`` / ``date`` / ``label``; other columns pass through.
    Ids and labels are lower-cased and stripped, bad dates become NULL."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    renames = {}
    for hint, target in ((id_hint, "sample_id"), (date_hint, "date"), (label_hint, "label")):
        match = [c for c in df.columns if hint in c]
        if not match:
            raise ValueError(f"no column containing '{hint}' in {df.columns}")
        renames[match[0]] = target
    for src, dst in renames.items():
        df = df.withColumnRenamed(src, dst)
    return (df.withColumn("sample_id", F.lower(strip("sample_id")))
              .withColumn("label", F.lower(strip("label")))
              .withColumn("date", F.to_date(F.try_to_timestamp(strip("date")))))


def read_reports(spark: SparkSession, path: str, on_malformed: str = "empty",
                 source_name: str | None = None) -> DataFrame:
    """One JSON report per file named ``<64 hex>.json`` (names starting ``._``
    skipped).  Returns ``sample_id, source_name, text, report`` where ``report`` is
    a VARIANT.  ``on_malformed``: ``'empty'`` keeps the sample with ``{}``,
    ``'drop'`` removes it, ``'null'`` keeps a NULL report."""
    raw = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").text(path)
           .select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("__fn")))
    ids = raw.withColumn("sample_id", F.lower(F.regexp_extract("__fn", HEX_NAME, 1)))
    ids = ids.where(F.col("sample_id") != "").drop("__fn")
    ids = ids.withColumn("source_name", F.lit(source_name or path))
    parsed = ids.withColumn("report", F.try_parse_json("text"))
    if on_malformed == "drop":
        return parsed.where(F.col("report").isNotNull())
    if on_malformed == "empty":
        return parsed.withColumn("report", F.coalesce("report", F.parse_json(F.lit("{}"))))
    if on_malformed == "null":
        return parsed
    raise ValueError(f"on_malformed must be empty, drop or null, not {on_malformed!r}")


def attach_reports(labels: DataFrame, reports: DataFrame, id_col: str = "sample_id",
                   fallback: DataFrame | None = None) -> DataFrame:
    """Left join reports to labels; a missing report falls back to ``fallback``
    and then to an empty object."""
    out = labels.join(reports.select(id_col, F.col("report").alias("__p")), id_col, "left")
    cols = [F.col("__p")]
    if fallback is not None:
        out = out.join(fallback.select(id_col, F.col("report").alias("__f")), id_col, "left")
        cols.append(F.col("__f"))
    out = out.withColumn("report", F.coalesce(*cols, F.parse_json(F.lit("{}"))))
    return out.drop("__p", "__f")


def read_confusion(spark: SparkSession, path_glob: str, suffix: str = "_confusion.csv") -> DataFrame:
    """Wide confusion CSVs (row labels in column 0) -> long ``run, y_true, y_pred, n``."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path_glob)
    first = raw.columns[0]
    classes = [c for c in raw.columns[1:]]
    df = raw.withColumn("run", F.regexp_replace(F.col("_metadata.file_name"), suffix + "$", ""))
    long = df.unpivot(["run", first], classes, "y_pred", "n")
    return long.select("run", F.col(first).alias("y_true"), "y_pred",
                       F.col("n").cast("long").alias("n"))


def read_walk_forward(spark: SparkSession, path: str) -> DataFrame:
    """Walk-forward results CSV with the three date columns typed, by boundary."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    for c in ("boundary", "test_start", "test_end"):
        if c in df.columns:
            df = df.withColumn(c, F.to_date(F.col(c).cast("string")))
    return df.orderBy("boundary")


def read_runs(spark: SparkSession, source_dir: str,
              vocabulary_views: Sequence[str] = ("api_tfidf", "art_tfidf")):
    """Explanation runs: one folder per run holding ``metadata.json``,
    ``case_overview.csv`` and ``case_feature_contributions.csv``.  Runs lacking a
    file or not using a vocabulary view are skipped.  Returns (cases, contributions)."""
    def run_of(col="_metadata.file_path"):
        return F.element_at(F.split(F.col(col), "/"), -2)

    meta = (spark.read.option("multiLine", True).json(f"{source_dir.rstrip('/')}/*/metadata.json")
            .withColumn("run_name", run_of()))
    views = F.coalesce(F.col("views"), F.array().cast("array<string>")) if "views" in meta.columns \
        else F.array().cast("array<string>")
    meta = meta.where(F.arrays_overlap(views, F.array(*[F.lit(v) for v in vocabulary_views])))
    meta = meta.select("run_name", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                                     if c in meta.columns else F.lit("").alias(c)
                                     for c in ("view_request", "split", "model")])
    cases = (spark.read.option("header", True).csv(f"{source_dir.rstrip('/')}/*/case_overview.csv")
             .withColumn("run_name", run_of()))
    contrib = (spark.read.option("header", True)
               .csv(f"{source_dir.rstrip('/')}/*/case_feature_contributions.csv")
               .withColumn("run_name", run_of()))
    complete = meta.join(cases.select("run_name").distinct(), "run_name") \
        .join(contrib.select("run_name").distinct(), "run_name")
    cases = cases.join(complete, "run_name")
    contrib = contrib.join(complete.select("run_name"), "run_name")
    return cases, contrib


def first_existing(candidates: Sequence[str]) -> str:
    """Driver-side argument check: the first candidate input that exists."""
    for c in candidates:
        if os.path.exists(c) and (not os.path.isdir(c) or os.listdir(c)):
            return c
    raise FileNotFoundError(f"none of the inputs exist: {list(candidates)}")


# ----------------------------------------------------------------------------- sinks

def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """A one-row result (metrics, logs) as a JSON document; the single row makes
    the one output file natural."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model_bundle(model, path: str, sidecar: dict) -> None:
    """Fitted Spark ML model plus a JSON sidecar (labels, split, views, scope)."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(sidecar, sort_keys=True),)], "bundle string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "bundle"))
