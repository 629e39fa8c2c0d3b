"""A training-corpus pipeline of the operators in ``tempora.llm``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a frame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.

Edge cases, stage by stage, are those of the operators: null and empty texts fail the
base quality rule; rows without an id pass the stages that work on ids unchanged;
extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontam, near_dedup, packing, quality, substring
from tempora.llm.tables import Scratch, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a calibrated rule rejects go."""
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.dedupe(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all documents but one; ``n_chars`` follows."""
    out = substring.cut_repeats(docs)
    n_chars = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("text"), "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, documents(spark, sf_dir, "benchmark"))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("length_packing", length_packing),
]
# Calibrated thresholds, chunk hashes and the buckets' dynamic program are beyond SQL;
# tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
