"""Leakage audit: exact-segment scan of string values for answer-revealing terms.

A hit is one (sample, field, value occurrence, term) where the term equals one of
the value's lower-cased alphanumeric segments.  The whole value is scanned; only
the stored copy of the value is cut to 200 characters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.report import report_strings
from ..functions.text import segments

def default_vocabulary() -> dict[str, list[str]]:
    return {"family_name": list(config.CLASS_NAMES),
            "detection_indicator": list(config.DETECTION_TERMS)}


def vocabulary_frame(spark: SparkSession, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(t.lower(), mt) for mt, terms in vocab.items() for t in terms]
    return spark.createDataFrame(rows, "term string, match_type string")


def scan(values: DataFrame, vocab: Mapping[str, Sequence[str]] | DataFrame,
         id_col: str = "sample_id", field_col: str = "field",
         value_col: str = "value", value_chars: int = 200) -> DataFrame:
    """One row per hit: ``id, field, value (<= value_chars), match_type,
    matched_term``.  ``values`` holds one row per (id, field, value occurrence); a term
    counts once per value, whatever its letter case and however often it is listed.
    A vocabulary given as a mapping lies on the driver already: segments are looked up
    in it where the value is, so that only hits leave a task.  A table of terms is
    joined.  Either way the stored copy is cut before a row becomes one row a segment."""
    segs = segments(value_col)
    if isinstance(vocab, DataFrame):
        vdf = vocab
    else:
        vdf = vocabulary_frame(values.sparkSession, vocab)
        known = sorted({t.lower() for terms in vocab.values() for t in terms})
        segs = F.filter(segs, lambda t: t.isin(known))
    vdf = vdf.select(F.lower("term").alias("term"), "match_type").distinct()
    found = values.select(id_col, field_col, F.substring(value_col, 1, value_chars).alias(value_col),
                          F.explode_outer(segs).alias("term")).where(F.col("term").isNotNull())
    if not isinstance(vocab, DataFrame):
        vdf = F.broadcast(vdf)
    return found.join(vdf, "term").select(
        id_col, field_col, value_col, "match_type", F.col("term").alias("matched_term"))


def report_values(reports: DataFrame, id_col: str = "sample_id", report_col: str = "report",
                  fields: Sequence[str] = config.AUDIT_FIELDS) -> DataFrame:
    """Explode the (field, value) string pairs of parsed reports."""
    return reports.select(id_col, F.explode_outer(report_strings(report_col, fields)).alias("__p")) \
        .where(F.col("__p").isNotNull()) \
        .select(id_col, F.col("__p.field").alias("field"), F.col("__p.value").alias("value"))


def scan_reports(reports: DataFrame, vocab=None, id_col: str = "sample_id",
                 report_col: str = "report") -> DataFrame:
    """Audit parsed reports.  Rows whose report is NULL (malformed) must be dropped
    by the caller beforehand if they should not count as scanned."""
    return scan(report_values(reports, id_col, report_col), vocab or default_vocabulary(),
                id_col=id_col)


def summarise(hits: DataFrame, scanned: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row: n_scanned, n_total_hits, n_flagged_samples, hit_rate (0 when
    nothing was scanned).  One aggregate over the tagged union of both inputs —
    no join of the two single-row results."""
    tagged = (scanned.select(F.lit(True).alias("__scan"), F.lit(None).cast("string").alias("__id"))
              .unionByName(hits.select(F.lit(False).alias("__scan"),
                                       F.col(id_col).cast("string").alias("__id"))))
    agg = tagged.agg(F.count_if("__scan").alias("n_scanned"),
                     F.count_if(~F.col("__scan")).alias("n_total_hits"),
                     F.count_distinct("__id").alias("n_flagged_samples"))
    return agg.select(
        "n_scanned", "n_total_hits", "n_flagged_samples",
        F.coalesce(F.try_divide(F.col("n_flagged_samples").cast("double"), F.col("n_scanned")),
                   F.lit(0.0)).alias("hit_rate"))


def by_term(hits: DataFrame, id_col: str = "sample_id", ordered: bool = False) -> DataFrame:
    """Hits and distinct flagged samples per (match_type, matched_term); with
    ``ordered`` most hits first (ties by type and term) for reports."""
    out = hits.groupBy("match_type", "matched_term").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct(id_col).alias("n_samples"))
    return out.orderBy(F.desc("n_hits"), "match_type", "matched_term") if ordered else out
