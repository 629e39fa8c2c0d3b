"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and letter case; numbers, names and units become
typed placeholders.  A number holds a digit; a unit is a word of a fixed list after a
number; a name is a capitalised word that does not open a sentence.  Every window of
``K`` canonical words (shorter for shorter items, ``SHORTEST`` words at least) is
hashed with its own words, and with placeholders if it has any beside enough plain
words; windows of documents and benchmark items are hash-joined.  The windows that a
document shares with an item at one distance lie on one alignment.  Windows with equal
words always count; those equal by placeholders count if the slots of their alignment
agree: each slot value of the item must stand for one value of the document, so "3
apples and 3 pears" matches "7 apples and 7 pears" but not "7 apples and 8 pears", and
"3 apples and 4 pears" matches "5 apples and 5 pears".  A document is contaminated by
an item of which these windows cover ``COVER`` of the words.

Scale: documents are read once and never shuffled as texts.  A window of a document
leaves its task only if a bitmap of ``SLOTS`` bits (a fixed size, whatever the
benchmark's) has its hash; the bitmap is built from the distinct hash slots of the
benchmark's windows.  A larger benchmark fills the bitmap, more rows reach the join
and the result is the same.  The join is a plain equi-join: AQE broadcasts the
benchmark's side if it is small and splits a hot window if it is not.  Matches are
grouped by (document, item, distance), at most a document's own length.

Edge cases: null or empty texts have no windows; items of fewer than ``SHORTEST``
canonical words are not searched; repeated items are each reported; rows that repeat
an id count as one document; rows without an id are never contaminated; ties (one
item at several places) are one result, with the first place; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .text import SEPARATOR, Texts, mix, slices, window_hashes

K, SHORTEST, COVER, SLOTS = 8, 4, 0.5, 1 << 22

# Units that may follow a number.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds
gram grams kilogram kilograms ml cl l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur
percent degree degrees celsius fahrenheit kmh mph hz khz mhz ghz w kw kwh v volt volts amp amps j joule joules n
newton newtons pa kpa bar meter meters metre metres kilometer kilometers kilometre kilometres""".split()

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?:;")] = True
PLAIN, NUMBER, NAME, UNIT = range(4)
_CODE = mix(np.arange(11, 15, dtype=np.uint64))


def _units() -> np.ndarray:
    t = next(slices(pa.array([" ".join(UNITS)])))
    start, end, _ = t.words()
    return np.sort(t.span_hashes(start, end, lower=True))


UNIT_HASHES = _units()


def canonical(texts: Texts) -> tuple[np.ndarray, ...]:
    """Kinds, codes (placeholder or word) and own hashes of the canonical words, and
    the n + 1 word offsets of the documents."""
    start, end, woff = texts.words()
    buf = texts.buf.copy()
    wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    buf[wide] += 0x20  # capital Latin-1 letters
    upper = np.zeros(len(buf) + 1, bool)
    upper[:-1] = (texts.buf >= 65) & (texts.buf <= 90)
    upper[wide - 1] = True
    lines = np.concatenate([[0], np.cumsum(texts.buf == 10)])
    opens = np.ones(len(start), bool)  # of a sentence
    if len(start) > 1:
        opens[1:] = STOP[texts.buf[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]])
    opens[woff[:-1][woff[:-1] < len(start)]] = True
    for _ in range(4):  # outer punctuation
        start = start + ((start < end) & PUNCTUATION[texts.buf[np.minimum(start, len(buf) - 1)]])
        end = end - ((start < end) & PUNCTUATION[texts.buf[end - 1]])
    digits = np.concatenate([[0], np.cumsum(DIGIT[texts.buf])])
    uppers = np.concatenate([[0], np.cumsum(upper[:-1])])
    number = digits[end] > digits[start]
    name = ~number & ~opens & (end - start > 1) & upper[start] & (uppers[end] - uppers[start] == 1)
    own = Texts(texts.first, buf, texts.off).span_hashes(start, end, lower=True)
    keep = end > start
    doc = np.repeat(np.arange(texts.n), np.diff(woff))[keep]
    own, number, name = own[keep], number[keep], name[keep]
    after_number = np.zeros(len(own), bool)
    after_number[1:] = number[:-1] & (doc[1:] == doc[:-1])
    kind = np.where(number, NUMBER, np.where(name, NAME, PLAIN))
    kind[after_number & ~number & np.isin(own, UNIT_HASHES)] = UNIT
    code = np.where(kind == PLAIN, own, _CODE[kind])
    return kind, code, own, np.searchsorted(doc, np.arange(texts.n + 1))


def _windows(batch, k: int, only_short: bool, bitmap: np.ndarray | None):
    """Windows of k canonical words as rows (id, first, hash, slots); ``only_short``:
    of texts that are no longer.  ``slots``: own hashes of placeholders, 0 elsewhere and
    in windows that are hashed with their own words."""
    for t in slices(batch.column(1)):
        kind, code, own, woff = canonical(t)
        if only_short:
            size = np.diff(woff) == k
            kept = np.repeat(size, np.diff(woff))
            kind, code, own = kind[kept], code[kept], own[kept]
            woff = np.concatenate([[0], np.cumsum(np.where(size, np.diff(woff), 0))])
        plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
        for words, verbatim in ((own, True), (code, False)):
            hashes, offsets = window_hashes(words, woff, k)
            doc = np.repeat(np.arange(t.n), np.diff(offsets))
            place = np.arange(len(hashes)) - offsets[doc]
            at = woff[doc] + place
            n_plain = plain[at + k] - plain[at]
            ok = np.ones(len(hashes), bool) if verbatim else (2 * n_plain >= k) & (n_plain < k)
            if bitmap is not None:
                ok &= bitmap[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
            doc, place, at, hashes = doc[ok], place[ok], at[ok], hashes[ok]
            if len(doc):
                slots = np.zeros((len(at), k), np.uint64) if verbatim else \
                    np.where(kind == PLAIN, np.uint64(0), own)[at[:, None] + np.arange(k)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + t.first)), pa.array(place.astype(np.int32)),
                     pa.array(np.full(len(doc), k, np.int32)), pa.array(hashes.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, k, dtype=np.int32)),
                                              pa.array(slots.view(np.int64).ravel())),
                     pa.array(np.diff(woff)[doc].astype(np.int32))],
                    names=["id", "first", "k", "hash", "slots", "n"])


_KIND = "id long, first int, k int, hash long, slots array<long>, n int"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item): ``doc_id, item_id, covered, first_word,
    last_word`` (places among the document's canonical words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col))

    def of_items(batches):
        for b in batches:
            yield from _windows(b, K, False, None)
            for k in range(SHORTEST, K):
                yield from _windows(b, k, True, None)

    known = scratch.put(items.mapInArrow(of_items, _KIND).distinct(), "items")
    slots = known.select(F.col("hash").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toPandas()
    bits = np.zeros(SLOTS, bool)  # at most SLOTS rows reach the driver
    bits[slots["slot"].to_numpy()] = True
    short = [r["k"] for r in known.where(F.col("k") < K).select("k").distinct().collect()]  # at most 4
    packed = spark.sparkContext.broadcast(np.packbits(bits))

    def of_docs(batches):
        bitmap = np.unpackbits(packed.value).astype(bool)
        for b in batches:
            for k in [K, *short]:
                yield from _windows(b, k, False, bitmap)

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    found = own.mapInArrow(of_docs, _KIND).select(
        F.col("id").alias("doc_id"), F.col("first").alias("at"), "k", "hash", F.col("slots").alias("dv"))
    both = found.join(known.select(F.col("id").alias("item_id"), "first", "k", "hash", F.col("slots").alias("iv"), "n"),
                      ["hash", "k"])
    pair = F.arrays_zip(F.col("iv").alias("i"), F.col("dv").alias("d"))
    lined = both.withColumn("pair", F.filter(pair, lambda x: x["i"] != 0)) \
        .withColumn("words", F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)) \
        .groupBy("doc_id", "item_id", "n", (F.col("at") - F.col("first")).alias("shift")).agg(
            F.array_distinct(F.flatten(F.collect_set("pair"))).alias("pairs"),
            F.array_distinct(F.flatten(F.collect_set("words"))).alias("any"),
            F.array_distinct(F.flatten(F.collect_set(F.when(F.size("pair") == 0, F.col("words"))))).alias("verbatim"))
    agree = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.i")))
    counted = lined.withColumn("words", F.when(agree, F.col("any")).otherwise(F.col("verbatim")))
    held = counted.where(F.size("words") > 0).groupBy("doc_id", "item_id", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words"),
        F.min(F.col("shift") + F.array_min("words")).alias("first_word"),
        F.max(F.col("shift") + F.array_max("words")).alias("last_word"))
    return held.withColumn("covered", F.col("words") / F.col("n")).where(F.col("covered") >= COVER) \
        .select("doc_id", "item_id", "covered", "first_word", "last_word")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    hit = contaminated(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(hit, id_col, "left_anti").select(docs.columns)
