"""Language identification by Bayesian evidence fusion.

Four pieces of evidence on a page are multiplied: the likelihood of its text, its
declared markup language, the language that its address names, and a prior of its
host.

* Text: a multinomial over hashed letter trigrams, ``SLOTS`` slots a language, counted
  over all texts of known language by one pass and grouped sums.  Trigrams of one text
  depend on one another, so the likelihood is tempered to at most ``EVIDENCE`` of them.
* Declarations: how often a page of each language declares each value, counted over
  all pages by the text's posterior and smoothed; a site that declares one language
  everywhere thus says little.  The same holds for the address: its last host label
  or first path segment, where that is one of the languages.
* Host prior: the languages of a host's pages, shrunk towards those of its domain, in
  turn shrunk towards those of all pages (``KAPPA`` pages' worth at each step), from
  grouped sums of the posteriors without the prior.

Scale: texts are read once for the model and once for the pages, never shuffled; what
is shuffled is one small row a page and partial sums by host; a host with a third of
the pages is one row after partial sums, joined back by a plain join that Spark
splits.  The driver holds the model: ``SLOTS`` counts for each language of the texts,
however many there are; a task holds those of the languages it meets.

Edge cases: null or empty markup has no text evidence; a comment, script or style that is
not closed runs to the end; no declaration, an unknown one
or none in the address is a value of its own; a null url has the empty host; ties go
to the first language in order; repeated pages count each time; without any text of
known language the result's language is null; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .text import LOWER, Texts, mix, slices
from .url_trust import with_parts

SLOTS, EVIDENCE, KAPPA = 1 << 14, 60.0, 10.0


def _trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of every byte trigram of letters (word ends count as one
    mark); digits and ASCII signs are left out."""
    own = LOWER[t.buf].astype(np.uint64)
    letter = ((own >= 97) & (own <= 122)) | (own >= 128)
    own = np.where(letter, own, np.uint64(32))
    doc = np.repeat(np.arange(t.n), np.diff(t.off))
    if len(own) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (own[:-2] << np.uint64(16)) | (own[1:-1] << np.uint64(8)) | own[2:]
    keep = (doc[:-2] == doc[2:]) & letter[1:-1]
    return doc[:-2][keep], (mix(key[keep]) & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            lang = np.array([at.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            for t in slices(b.column(0)):
                doc, slot = _trigrams(t)
                own = lang[doc + t.first]
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                for i, part in zip(found.tolist(), np.split(slot[order], first[1:])):
                    if i >= 0:
                        total[i] = total.get(i, 0) + np.bincount(part, minlength=SLOTS)
        for i, counts in total.items():
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), i)), pa.array(held), pa.array(counts[held])],
                                             names=["lang", "slot", "n"])
    return run


class TextModel:
    """Log-likelihoods of trigram slots by language, from texts of known language."""

    def fit(self, texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
        known = texts.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.lower(lang_col).alias("l"))
        self.languages = sorted(r["l"] for r in known.select("l").distinct().collect())
        counts = known.mapInArrow(_count(self.languages), "lang long, slot long, n long") \
            .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # <= languages x SLOTS
        total = np.full((len(self.languages), SLOTS), 0.5)
        total[counts["lang"].to_numpy(np.int64), counts["slot"].to_numpy(np.int64)] += counts["n"].to_numpy(float)
        self.table = np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)
        return self

    def likelihoods(self, rows: DataFrame, key: str, text: Column) -> DataFrame:
        """``key, loglik``: tempered log-likelihood of each language."""
        shared = rows.sparkSession.sparkContext.broadcast(self.table)
        width = len(self.languages)

        def run(batches):
            for b in batches:
                for t in slices(b.column(1)):
                    doc, slot = _trigrams(t)
                    n = np.bincount(doc, minlength=t.n)
                    own = np.stack([np.bincount(doc, row[slot], t.n) for row in shared.value], axis=1)
                    own = own * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(t.first, t.n),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, width, dtype=np.int32)),
                                                  pa.array(own.ravel()))], names=["row", "loglik"])

        own = rows.select(F.col(key).alias("row"), text.alias("t"))
        return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, loglik array<double>")


def page_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags.  A script, style or comment that
    is not closed runs to the end, and a tag holds no ``<``, so that no stretch is looked
    through twice."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(plain, r"<[^<>]*+>|&#?\w++;", " ")


def declared_language(html: Column) -> Column:
    """The language of the ``html`` tag in lower case, empty without one."""
    return F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([a-z]+)", 1))


def _posterior(logit: Column) -> Column:
    """Probabilities from an array of log weights."""
    top = F.array_max(logit)
    e = F.transform(logit, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _plus(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def _soft_counts(rows: DataFrame, by: str, out: str, width: int) -> DataFrame:
    """Sums of the posteriors by a key, as an array."""
    return rows.groupBy(by).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(width)]).alias(out))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row per page: id, ``host, declared, address, text_lang, lang, probability``."""
    scratch = Scratch(pages.sparkSession, "language")
    known, width = model.languages, len(model.languages)
    own = with_parts(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"),
                                  F.col(html_col).alias("__html")), "__url")
    declared = declared_language(F.col("__html"))
    label, segment = F.lower(F.substring_index("host", ".", -1)), F.lower(F.regexp_extract("path", r"^/([^/.]+)", 1))
    one_of = lambda c: F.when(c.isin(known), c)
    info = F.struct(F.col("__id").alias("id"), "host",
                    F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
                    F.coalesce(F.when(declared != "", declared), F.lit("")).alias("declared"),
                    F.coalesce(one_of(segment), one_of(label), F.lit("")).alias("address")).alias("info")
    if not known:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")]
        return own.select(info).select(F.col("info.id").alias(id_col), "info.host", "info.declared", "info.address",
                                       *nothing, F.lit(None).cast("double").alias("probability"))
    scored = model.likelihoods(own.select(info, "__html"), "info", page_text(F.col("__html")))
    rows = scratch.put(scored.select("row.*", "loglik", _posterior(F.col("loglik")).alias("post")), "text")
    evidence = F.col("loglik")
    joined = rows
    for name in ("declared", "address"):
        counts = _soft_counts(rows.where(F.size("post") > 0), name, "n", width)
        totals = rows.agg(F.array(*[F.coalesce(F.sum(F.get("post", F.lit(i))), F.lit(0.0)) for i in range(width)])
                          .alias("all")).first()["all"]  # one number a language
        seen = counts.select(name, F.zip_with("n", F.array(*[F.lit(float(x)) for x in totals]),
                                              lambda n, a: F.log((n + 0.5) / (a + 20.0))).alias(f"w_{name}"))
        joined = joined.join(seen, name, "left")
        evidence = _plus(evidence, F.coalesce(f"w_{name}", F.transform("loglik", lambda x: F.lit(0.0))))
    fused = scratch.put(joined.select("id", "host", "domain", "declared", "address", "loglik",
                                      evidence.alias("evidence")).withColumn("post", _posterior(F.col("evidence"))), "fused")
    shrink = lambda n, base: F.zip_with(n, base, lambda x, b: x + F.lit(KAPPA) * b)
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(1e-9), lambda s, y: s + y))
    totals = fused.agg(F.array(*[F.coalesce(F.sum(F.get("post", F.lit(i))), F.lit(0.0)) for i in range(width)])
                       .alias("all")).first()["all"]
    overall = [(x + 1.0) / (sum(totals) + width) for x in totals]
    everywhere = F.array(*[F.lit(x) for x in overall])
    domains = _soft_counts(fused, "domain", "dn", width)
    hosts = fused.groupBy("host", "domain").agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(width)]).alias("hn"))
    prior = hosts.join(domains, "domain").select("host", share(shrink(F.col("hn"), share(shrink(F.col("dn"), everywhere))))
                                                 .alias("prior"))
    done = fused.join(prior, "host", "left").withColumn(
        "p", _posterior(F.zip_with("evidence", "prior", lambda e, q: e + F.log(q))))
    names = F.array(*[F.lit(x) for x in known]).cast("array<string>")
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return done.select(F.col("id").alias(id_col), "host", "declared", "address", best(F.col("loglik")).alias("text_lang"),
                       best(F.col("p")).alias("lang"), F.array_max("p").alias("probability"))
