"""One registered query per operator, over its whole table with production
parameters, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, fingerprints, language, licenses, near_dedup, packing, quality, spelling, substring, \
    token_store, toxicity, url_trust
from .tables import Scratch, documents as table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the word spans cut out of it and the text that is left."""
    out = substring.cut_repeats(table(spark, sf_dir))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return out.select("row.doc_id", words.alias("removed_words"), "removed", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are token ids, as op9 writes them."""
    import public_tokenizers

    lengths = packing.token_lengths(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(lengths, length=F.col("n_tokens"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir))


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return toxicity.ToxicityModel().fit(docs, table(spark, sf_dir, "labels")).score(docs)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE_COUNTS, "base_failed", "kept",
                      F.array_join("rules", ",").alias("rules"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = Scratch(spark, "token-store").path("store")
    token_store.write(table(spark, sf_dir), root, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.digest(spark, root)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model is counted over all documents."""
    model = language.TextModel().fit(table(spark, sf_dir))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(v, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN comp ON v = doc_id
"""

# crc32 by its table; near words by what is left when a code point is deleted
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
found AS (SELECT r, id, hex(id || ':' || r) AS h, count(*) AS n FROM runs GROUP BY id, r),
hashed AS (
  SELECT r, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2),
           lambda i: 16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1)
                     + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
           lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]))) AS crc FROM found, bits),
words AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(r, 1, crc % length(r)) || substr(r, crc % length(r) + 2) ELSE r END AS w,
         CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY w HAVING length(w) >= 5 AND sum(n) >= 3),
less AS (
  SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v
  FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.w AS w, b.w AS o FROM less a JOIN words b ON a.v = b.w
  UNION SELECT b.w, a.w FROM less a JOIN words b ON a.v = b.w
  UNION SELECT a.w, b.w FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.w <> b.w),
near AS (
  SELECT p.w AS w, count(*) AS n_near, max(x.n) AS best,
         arg_min(p.o, {'less': -x.n, 'form': hex(p.o)}) AS form
  FROM pairs p JOIN words x ON x.w = p.o GROUP BY p.w),
forms AS (
  SELECT words.w AS word, CASE WHEN best >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN best >= 2 * n THEN best END AS form_n FROM words LEFT JOIN near ON near.w = words.w),
chain(word, cur, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.cur AND forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(cur, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_substring_dedup, op3_packing, op4_license_scan, op5_url_trust, op6_decontamination, op7_toxicity,
    op8_quality_rules, op9_token_store, op10_language, op11_spelling_variants,
    op12_token_alignment, op13_fingerprints)}
SQL = {"op1_near_dedup": OP1_SQL, "op11_spelling_variants": OP11_SQL}
