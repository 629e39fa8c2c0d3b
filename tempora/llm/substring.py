"""Substring dedup by content-defined chunking.

A gear hash rolls over the words of a text (each step shifts the hash and adds the
word's random value; a cut looks at its last ``GEAR`` words).  A chunk begins at a
word whose hash is the least within ``RADIUS`` words on either side, so chunks vary in
length and, a few words after an insertion, fall as before.  What is looked up is the
digest of a chunk with its successor (about fourteen words), one row each.

A digest found in two or more documents is kept in the one with the smallest id; in
the others the chunk pair is a copy.  Copies that overlap make a run, and a run of
``MIN_WORDS`` words or more is cut out of the text.  Of a repeated passage of n words
about n - 16 are covered, so passages of over 50 words are found and short phrases
are not.  What repeats only within one document stays.

Scale: digests are counted with partial minima before the shuffle, so a passage in a
third of all documents adds one row a task there; the rows of a hot digest meet that
one row in a plain join, which Spark splits.  Texts are shuffled once, to meet the
runs of their document.  A run carries its digest, and is cut out only where the text
holds it, so rows that share an id but not a text don't harm each other.

Edge cases: null and empty texts, texts of fewer than ``MIN_WORDS`` words and rows
without an id are left as they are; rows that repeat an id count as one document; a
null text stays null; columns other than the two named ones pass through (whatever
their names); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BASE, BASE_INV, Texts, mix, slices

GEAR, RADIUS, MIN_WORDS = 2, 3, 24


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INV):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def chunk_pairs(texts: Texts) -> tuple[np.ndarray, ...]:
    """Document index, first word, end word and digest of every chunk with its
    successor; a lone chunk counts alone."""
    start, end, woff = texts.words()
    n = len(start)
    h = texts.span_hashes(start, end, lower=True)
    place = np.arange(n) - np.repeat(woff[:-1], np.diff(woff))
    after = np.repeat(woff[1:], np.diff(woff)) - 1 - np.arange(n)
    gear = h.copy()
    for j in range(1, GEAR):
        gear[j:] += np.where(place[j:] >= j, h[: n - j] << np.uint64(j), np.uint64(0))
    gear = mix(gear)
    cut = np.ones(n, bool)
    for r in range(1, RADIUS + 1):
        cut[r:] &= (gear[r:] < gear[: n - r]) | (place[r:] < r)
        cut[: n - r] &= (gear[: n - r] <= gear[r:]) | (after[: n - r] < r)
    cut |= place == 0
    first = np.flatnonzero(cut)
    doc = np.searchsorted(woff, first, "right") - 1
    stop = np.minimum(np.append(first[1:], n), woff[doc + 1])
    # a chunk with its successor in the same document
    has_next = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    pair_end = np.where(has_next, np.append(stop[1:], n)[: len(stop)], stop)
    lone = ~has_next & (first == woff[doc])
    keep = (has_next | lone) & (np.diff(woff)[doc] >= MIN_WORDS)
    first, pair_end, doc = first[keep], pair_end[keep], doc[keep]
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    digest = mix((total[pair_end] - total[first]) * down[first])
    return doc, first - woff[doc], pair_end - woff[doc], digest


def _chunks(batches):
    for b in batches:
        for t in slices(b.column(1)):
            doc, first, end, digest = chunk_pairs(t)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc + t.first)), pa.array(digest.view(np.int64)),
                     pa.array((first.astype(np.int64) << 32) | end.astype(np.int64))],
                    names=["doc", "digest", "span"])


def copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, copies: array<struct<span, digest>>)``: per document its chunk pairs
    that an earlier document holds."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    chunks = own.mapInArrow(_chunks, "doc long, digest long, span long")
    shared = chunks.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")) \
        .where("first <> last").select("digest", "first")
    again = chunks.join(shared, "digest").where(F.col("doc") != F.col("first"))
    return again.groupBy("doc").agg(F.collect_list(F.struct("span", "digest")).alias("copies"))


def _runs(spans: np.ndarray, digests: np.ndarray, held: dict[int, int]) -> list[tuple[int, int]]:
    """Overlapping copies that the text holds, joined; runs of ``MIN_WORDS`` or more."""
    out: list[list[int]] = []
    for span, digest in sorted(zip(spans.tolist(), digests.tolist())):
        if held.get(span) != digest:
            continue
        first, end = span >> 32, span & 0xFFFFFFFF
        if out and first < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out if b - a >= MIN_WORDS]


def _cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs and the white space after each."""
    t = next(slices(pa.array([text])))
    start, _, _ = t.words()
    raw, out, at = t.buf.tobytes(), [], 0
    for a, b in runs:
        out.append(raw[at: start[a]])
        at = start[b] if b < len(start) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def _apply(batches):
    """Rows (row, text, copies) -> (row, text, removed)."""
    for b in batches:
        texts, removed = b.column(1).to_pylist(), [[] for _ in range(b.num_rows)]
        for i in np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False)):
            if texts[i] is None:
                continue
            doc, first, end, digest = chunk_pairs(next(slices(pa.array([texts[i]]))))
            held = dict(zip(((first << 32) | end).tolist(), digest.view(np.int64).tolist()))
            got = b.column(2)[int(i)].values
            runs = _runs(got.field("span").to_numpy(), got.field("digest").to_numpy(), held)
            if runs:
                texts[i], removed[i] = _cut(texts[i], runs), [{"first": a, "last": z - 1} for a, z in runs]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()),
             pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
            names=["row", "text", "removed"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (as ``row``), ``text`` without repeated passages, and
    ``removed``: the spans cut out, as first and last word."""
    found = copies(docs, id_col, text_col)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
                      F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"))
    joined = own.join(found, "doc", "left").select("row", "text", "copies")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_apply, f"row {kind}, text string, removed array<struct<first:long,last:long>>")
