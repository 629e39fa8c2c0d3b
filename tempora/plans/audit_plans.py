"""Leakage audit and label reconciliation on the driver tables.

Stand-ins: ``documents`` are the reports (one string field ``text``), with a
vocabulary whose terms really occur in them; ``labels`` are the label file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..sources import reconcile as rec
from .catalog import register, table

# stand-in vocabulary for the document corpus (terms that occur in it)
DOC_VOCAB = {"indicator": ["license", "apache", "mit", "token", "com"],
             "label": ["the", "and"]}

_VOCAB_SQL = ", ".join(f"('{t}', '{mt}')" for mt, ts in DOC_VOCAB.items() for t in ts)
_HITS_SQL = f"""
WITH segs AS (
  SELECT doc_id, text,
         list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS s
  FROM documents),
vocab(term, match_type) AS (VALUES {_VOCAB_SQL})
SELECT doc_id, 'text' AS field, substr(text, 1, 200) AS value,
       v.match_type, v.term AS matched_term
FROM segs JOIN vocab v ON list_contains(segs.s, v.term)
"""


def _doc_values(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.lit("text").alias("field"),
        F.col("text").alias("value"))


def _doc_hits(spark, d):
    return audit.scan(_doc_values(spark, d), DOC_VOCAB)


@register("audit_hits", _HITS_SQL)
def audit_hits(spark, d):
    """F1, F13, J13, PF15: one row per (document, term) exact-segment hit."""
    return _doc_hits(spark, d).withColumnRenamed("sample_id", "doc_id")


@register("audit_terms", f"""
WITH h AS ({_HITS_SQL})
SELECT match_type, matched_term, count(*) AS n_hits, count(DISTINCT doc_id) AS n_samples
FROM h GROUP BY match_type, matched_term
""")
def audit_terms(spark, d):
    """AG3, T7: hits per (match_type, term), most hits first."""
    return audit.by_term(_doc_hits(spark, d), ordered=True)


@register("audit_summary", f"""
WITH h AS ({_HITS_SQL})
SELECT (SELECT count(*) FROM documents) AS n_scanned,
       (SELECT count(*) FROM h) AS n_total_hits,
       (SELECT count(DISTINCT doc_id) FROM h) AS n_flagged_samples,
       coalesce((SELECT count(DISTINCT doc_id) FROM h)::DOUBLE
                / nullif((SELECT count(*) FROM documents), 0), 0.0) AS hit_rate
""")
def audit_summary(spark, d):
    """AG2, S6: scanned / hits / flagged / rate."""
    return audit.summarise(_doc_hits(spark, d), table(spark, d, "documents"))


@register("reconcile_counts", """
WITH l AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT DISTINCT doc_id FROM documents)
SELECT (SELECT count(*) FROM labels) AS n_labels,
       (SELECT count(*) FROM l) AS n_label_ids,
       (SELECT count(*) FROM r) AS n_reports,
       (SELECT count(*) FROM l JOIN r USING (doc_id)) AS n_matched,
       (SELECT count(*) FROM l ANTI JOIN r USING (doc_id)) AS n_missing_reports,
       (SELECT count(*) FROM r ANTI JOIN l USING (doc_id)) AS n_extra_reports
""")
def reconcile_counts(spark, d):
    """Matched / missing / extra over distinct ids."""
    return rec.reconcile_counts(table(spark, d, "labels"), table(spark, d, "documents"),
                                id_col="doc_id")


@register("ingest_log", """
SELECT count(*) AS n_labels, strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS date_min,
       strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS date_max,
       count(DISTINCT o_orderpriority) AS n_classes,
       array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS families
FROM orders
""")
def ingest_log(spark, d):
    """AG1: label rows, date range and sorted class list (orders as labels)."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"),
                                         F.to_date("o_orderdate").alias("date"))
    out = rec.ingest_log(o)
    return out.withColumn("date_min", F.date_format("date_min", "yyyy-MM-dd")) \
        .withColumn("date_max", F.date_format("date_max", "yyyy-MM-dd"))


@register("class_counts", """
SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL
""")
def class_counts(spark, d):
    """AG1: rows per class."""
    return rec.class_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")))


@register("reconcile_flags", """
SELECT l.doc_id, l.quality, l.toxic,
       (r.doc_id IS NOT NULL) AS has_report
FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) r USING (doc_id)
""")
def reconcile_flags(spark, d):
    """J2, PF4: label rows flagged with report presence."""
    return rec.flag_reports(table(spark, d, "labels"), table(spark, d, "documents"),
                            id_col="doc_id")


@register("unlabelled_first10", """
SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ANTI JOIN labels USING (doc_id)
ORDER BY doc_id LIMIT 10
""")
def unlabelled_first10(spark, d):
    """First ten report ids without a label (the limit is the feature)."""
    return rec.first_missing(table(spark, d, "documents"), table(spark, d, "labels"),
                             id_col="doc_id", n=10)


@register("labelled_without_report_first10", """
SELECT doc_id FROM documents ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings) e USING (doc_id)
ORDER BY doc_id LIMIT 10
""")
def labelled_without_report_first10(spark, d):
    """First ten labelled ids (documents) without a report (embedding)."""
    reports = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return rec.first_missing(table(spark, d, "documents"), reports, id_col="doc_id", n=10)


@register("dedupe_copies", """
SELECT md5(text) AS text_key, arg_min(doc_id, (source, doc_id)) AS doc_id,
       min(source) AS source, count(*) AS n_copies
FROM documents GROUP BY md5(text)
""")
def dedupe_copies(spark, d):
    """SC6: first writer wins per key (source order, then id) — exact copies of a
    text share a key; a hot key is reduced map-side, never sorted in one task."""
    docs = table(spark, d, "documents").withColumn("text_key", F.md5("text"))
    return rec.dedupe_by_source(docs, "text_key", ["source", "doc_id"],
                                keep=["doc_id", "source"])
