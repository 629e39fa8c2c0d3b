"""Feature views and drift on the driver tables.

Text view: ``documents.text`` words (unigrams + bigrams), documents split by a
stratified random split on ``lang``; TF-IDF is fitted on the train part.
Numeric views: ``lineitem`` aggregated per order; orders split chronologically.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import drift, features, splits
from ..session import cut_lineage
from .catalog import register, table
from .metric_plans import r6
from .split_plans import chrono_sql, random_sql, samples

DOC_SAMPLES_SQL = "SELECT doc_id AS sample_id, lang AS label FROM documents"


TEXT_PER_TASK = 16_000_000  # characters of text that a task tokenises and groups


def doc_split(spark, d):
    """Documents with their ``part``, dealt by ``doc_id`` into tasks of bounded text: what
    is grouped by document later is grouped where the document lies."""
    docs = table(spark, d, "documents", whole_splits=True)
    sp = splits.random_stratified(docs.select(F.col("doc_id").alias("sample_id"),
                                              F.col("lang").alias("label")), "sample_id", "label")
    # the assignment is reused by several branches: materialise it once
    sp = cut_lineage(sp.select(F.col("sample_id").alias("doc_id"), "part"))
    return with_parts(docs, sp)


def with_parts(docs, sp):
    """Documents dealt by ``doc_id``, joined with the columns of ``sp``."""
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_chars // TEXT_PER_TASK))
    return docs.repartition(n, "doc_id").join(sp.hint("shuffle_hash"), "doc_id")


def grams(docs, *cols):
    """``cols`` and ``t``, the unigrams and bigrams of whole texts.  The words are a column
    of their own first: inside ``ngrams`` they would be found once for every use."""
    return docs.select(*cols, text.words("text").alias("w")).select(*cols, text.ngrams("w", 1, 2).alias("t"))


def vocabulary(spark, d):
    """Documents (``doc_id, part``), their grams (``doc_id, part, t``) and the vocabulary
    fitted on the train part.  Terms are counted inside the document's task, so fitting and
    transforming tokenise again rather than store or shuffle a row per (document, term)."""
    docs = doc_split(spark, d)
    toks, docs = grams(docs, "doc_id", "part"), docs.select("doc_id", "part")
    n = docs.where(F.col("part") == "train").agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = features.tfidf_fit(features.term_counts(toks.where(F.col("part") == "train"), "doc_id", "t"), n, "doc_id")
    return docs, toks, cut_lineage(vocab)  # at most max_terms rows, used several times


def doc_weights(toks, vocab):
    """``doc_id, term, index, weight`` of the vocabulary's terms."""
    return features.tfidf_transform(features.term_counts(toks, "doc_id", "t", within=vocab), vocab, "doc_id")


TFIDF_SQL = f"""
WITH sp AS ({random_sql(DOC_SAMPLES_SQL)}),
docs AS (SELECT d.doc_id, sp.part,
                regexp_extract_all(lower(coalesce(d.text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w
         FROM documents d JOIN sp ON sp.sample_id = d.doc_id),
grams AS (SELECT doc_id, part, unnest(w) AS term FROM docs
          UNION ALL
          SELECT doc_id, part, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM docs),
tc AS (SELECT doc_id, any_value(part) AS part, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
ntrain AS (SELECT count(*) AS n FROM docs WHERE part = 'train'),
v0 AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tc WHERE part = 'train' GROUP BY term
       HAVING count(*) >= 2),
v1 AS (SELECT * FROM v0 ORDER BY cf DESC, term LIMIT 50000),
vocab AS (SELECT term, df, cf, ln((1 + n) / (1 + df)) + 1 AS idf,
                 CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index FROM v1, ntrain),
wt AS (SELECT tc.doc_id, tc.term, vocab.index, (1 + ln(tf)) * idf AS w FROM tc JOIN vocab USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM wt GROUP BY doc_id)
"""


@register("tfidf_vocabulary", TFIDF_SQL + """
SELECT term, index, df, cf, round(idf, 6) AS idf FROM vocab
""")
def tfidf_vocabulary(spark, d):
    """T4, AG33, M1 (fit): min_df 2, top 50,000 by corpus count, smoothed idf."""
    _, _, vocab = vocabulary(spark, d)
    return r6(vocab.select("term", "index", "df", "cf", "idf"))


@register("tfidf_weights", TFIDF_SQL + """
SELECT doc_id, term, index, round(w / nr, 6) AS weight FROM wt JOIN nrm USING (doc_id)
""")
def tfidf_weights(spark, d):
    """Sublinear-tf TF-IDF weights (L2 per document), all documents."""
    _, toks, vocab = vocabulary(spark, d)
    return r6(doc_weights(toks, vocab))


@register("top_terms", TFIDF_SQL + """
, tw AS (SELECT doc_id, term, w / nr AS weight FROM wt JOIN nrm USING (doc_id))
SELECT doc_id, term, round(weight, 6) AS weight, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rk FROM tw)
WHERE rk <= 6
""")
def top_terms(spark, d):
    """W7, M19 (token rows): the six highest-weighted terms per document."""
    _, toks, vocab = vocabulary(spark, d)
    top = drift.top_k(doc_weights(toks, vocab), "term", "weight", 6, by=["doc_id"])
    from pyspark.sql import Window
    rk = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.asc("term")))
    return r6(top.select("doc_id", "term", "weight", rk.alias("rank")))


@register("drift_js_distance", TFIDF_SQL + """
, pres AS (SELECT DISTINCT tc.doc_id, tc.part, tc.term FROM tc JOIN vocab USING (term)),
nside AS (SELECT part, count(*) AS n FROM docs GROUP BY part),
rates AS (SELECT p.part, p.term, count(*) / any_value(n) AS rate FROM pres p JOIN nside USING (part) GROUP BY ALL),
fv AS (SELECT v.term, coalesce(a.rate, 0) + 1e-10 AS p, coalesce(b.rate, 0) + 1e-10 AS q FROM vocab v
         LEFT JOIN (SELECT * FROM rates WHERE part = 'train') a USING (term)
         LEFT JOIN (SELECT * FROM rates WHERE part = 'test') b USING (term)),
nz AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM fv),
mm AS (SELECT p, q, (p + q) / 2 AS m FROM nz)
SELECT round(sqrt(greatest(0, (sum(p * ln(p / m)) + sum(q * ln(q / m))) / 2)), 6) AS js_distance FROM mm
""")
def drift_js_distance(spark, d):
    """AG16, AG17: Jensen–Shannon distance of term presence rates, train vs test."""
    docs, toks, vocab = vocabulary(spark, d)
    tc = features.term_counts(toks, ["doc_id", "part"], "t", within=vocab)
    rates = drift.presence_rates(tc, docs, "doc_id", "part", vocab, distinct_terms=True)
    return r6(drift.js_distance(rates, vocab, "part", "train", "test"))


@register("drift_topk_jaccard", TFIDF_SQL + """
, dfs AS (SELECT part, term, count(*) AS df FROM tc WHERE part IN ('train', 'test') GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY df DESC, term) AS r FROM dfs),
a AS (SELECT term FROM rk WHERE part = 'train' AND r <= 50),
b AS (SELECT term FROM rk WHERE part = 'test' AND r <= 50)
SELECT round((SELECT count(*) FROM a JOIN b USING (term)) /
             (SELECT count(*) FROM (SELECT term FROM a UNION SELECT term FROM b)), 6) AS jaccard
""")
def drift_topk_jaccard(spark, d):
    """AG19, T5: Jaccard of the top-50 terms (by document frequency) of two periods."""
    _, toks, _ = vocabulary(spark, d)
    tc = features.term_counts(toks.where(F.col("part").isin("train", "test")), ["doc_id", "part"], "t")
    dfs = tc.groupBy("part", "term").agg(
        F.count(F.lit(1)).alias("df"))
    top = cut_lineage(drift.top_k(dfs, "term", "df", 50, by=["part"]))  # 100 rows, read twice
    return r6(drift.jaccard(top.where(F.col("part") == "train"), top.where(F.col("part") == "test"), "term"))


# ------------------------------------------------------------------ numeric views

COUNT_COLS = ["n_lines", "sum_qty", "n_returned", "max_discount"]
PE_COLS = ["avg_discount_returned", "mean_tax", "price_per_qty"]


def order_features(spark, d):
    li = table(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("n_returned"),
        F.max("l_discount").alias("max_discount"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("avg_discount_returned"),
        F.avg("l_tax").alias("mean_tax"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price_per_qty"))
    smp = cut_lineage(splits.global_chronological(samples(spark, d), "sample_id", "date"))
    j = smp.join(per, smp.sample_id == per.l_orderkey, "left").drop("l_orderkey")
    return j.fillna(0.0, subset=COUNT_COLS)


FEAT_SQL = f"""
WITH sp AS ({chrono_sql("", 0)}),
per AS (SELECT l_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS sum_qty,
               count_if(l_returnflag = 'R')::DOUBLE AS n_returned, max(l_discount) AS max_discount,
               avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS avg_discount_returned,
               avg(l_tax) AS mean_tax, sum(l_extendedprice) / sum(l_quantity) AS price_per_qty
        FROM lineitem GROUP BY l_orderkey),
f AS (SELECT sp.sample_id, sp.part, coalesce(n_lines, 0) AS n_lines, coalesce(sum_qty, 0) AS sum_qty,
             coalesce(n_returned, 0) AS n_returned, coalesce(max_discount, 0) AS max_discount,
             avg_discount_returned, mean_tax, price_per_qty
      FROM sp LEFT JOIN per ON per.l_orderkey = sp.sample_id)
"""


def _maxabs_sql():
    cols = ", ".join(f"max(abs({c})) AS m_{c}" for c in COUNT_COLS)
    sel = ", ".join(f"round({c} / CASE WHEN m_{c} = 0 THEN 1 ELSE m_{c} END, 6) AS {c}" for c in COUNT_COLS)
    return FEAT_SQL + f""", m AS (SELECT {cols} FROM f WHERE part = 'train')
SELECT sample_id, {sel} FROM f, m"""


@register("counts_maxabs", _maxabs_sql())
def counts_maxabs(spark, d):
    """M4, AG32: count features scaled by train max |x|."""
    f = order_features(spark, d)
    out = features.max_abs(f, COUNT_COLS, f.where(F.col("part") == "train"))
    return r6(out.select("sample_id", *COUNT_COLS))


def _std_sql():
    med = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in PE_COLS)
    mom = ", ".join(f"avg(coalesce({c}, med_{c})) AS mu_{c}, stddev_pop(coalesce({c}, med_{c})) AS sd_{c}"
                    for c in PE_COLS)
    sel = ", ".join(f"round((coalesce({c}, med_{c}) - mu_{c}) / CASE WHEN coalesce(sd_{c}, 0) = 0 THEN 1 "
                    f"ELSE sd_{c} END, 6) AS {c}" for c in PE_COLS)
    return FEAT_SQL + f""", md AS (SELECT {med} FROM f WHERE part = 'train'),
mo AS (SELECT {mom} FROM f, md WHERE part = 'train' GROUP BY ALL)
SELECT sample_id, {sel} FROM f, md, mo"""


@register("pe_standardised", _std_sql())
def pe_standardised(spark, d):
    """M5, M6, AG31, AG32: train-median imputation + train standardisation."""
    f = order_features(spark, d)
    out = features.impute_standardise(f, PE_COLS, f.where(F.col("part") == "train"))
    return r6(out.select("sample_id", *PE_COLS))


@register("drift_ks", FEAT_SQL + """
, lng AS (SELECT part, 'n_lines' AS feature, n_lines AS x FROM f UNION ALL
          SELECT part, 'sum_qty', sum_qty FROM f UNION ALL SELECT part, 'n_returned', n_returned FROM f UNION ALL
          SELECT part, 'max_discount', max_discount FROM f),
c AS (SELECT feature, x, count_if(part = 'train') AS ca, count_if(part = 'test') AS cb FROM lng
      WHERE x IS NOT NULL GROUP BY ALL),
cu AS (SELECT *, sum(ca) OVER (PARTITION BY feature ORDER BY x) AS fa,
              sum(cb) OVER (PARTITION BY feature ORDER BY x) AS fb,
              sum(ca) OVER (PARTITION BY feature) AS na, sum(cb) OVER (PARTITION BY feature) AS nb FROM c)
SELECT feature, round(max(abs(fa / na - fb / nb)), 6) AS ks FROM cu GROUP BY feature
""")
def drift_ks(spark, d):
    """AG18, W8: two-sample KS statistic per numeric feature, train vs test."""
    f = order_features(spark, d)
    return r6(drift.ks_statistics(f, COUNT_COLS, "part", "train", "test"))
