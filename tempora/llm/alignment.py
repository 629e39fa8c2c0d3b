"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizations of a text cover the same bytes (a space and the text).  Per batch,
``pandas.merge_asof`` keyed by document finds for each token start the other side's
token that covers it, once in each direction; the union of both directions is every
pair of tokens that overlap (of two overlapping tokens one starts inside the other).
Where tokens of both sides start together (and so the tokens before end together), a
group begins.

What a link's pair of ids counts corpus-wide is one grouped sum over the documents'
distinct pairs, with partial sums; the highest count of each B id is a second one.
Counts get back to documents by a join: the table of pairs is broadcast if it has at most
``BROADCAST`` rows (32 bytes each), else both sides are shuffled by pair (Spark splits
skewed pairs).  Texts are encoded once and never shuffled; the aligned batches are
written to the shared folder as one row a document with its distinct pairs.

Edge cases: null and empty texts, and texts that either side does not give back byte by
byte (such as texts with U+2581), have no tokens: zeros, and '' for the hash; strings of
special tokens are plain text; rows that repeat an id, and rows without one, are
documents of their own; one very long text is a batch of its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch_tokens import byte_level, gather, pieces, text_slices
from .tables import Scratch

BROADCAST = 1_000_000
ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


class Side:
    """One tokenizer: its ids, the bytes of each id, and each id as text followed by a
    comma or by the mark that closes its part of a group."""

    def __init__(self, encoder, mark: str):
        self.encoder = encoder
        tokens = encoder.token_bytes()
        self.size = len(tokens)
        self.flat, self.offsets = self._table(tokens)
        self.said, self.said_offsets = self._table([f"{i}{end}".encode() for i in range(self.size) for end in (",", mark)])

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return Side(byte_level(path_a, True, False), "|"), Side(pieces(path_b), ";")


def _covered(side: Side, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text's bytes."""
    got, offsets = gather(side.flat, side.offsets, ids)
    got_at = offsets[ends]
    good = np.diff(got_at) == np.diff(at)
    if good.all() and len(got) == len(raw):
        differ = np.concatenate([[0], np.cumsum(got != raw)])
        return np.diff(differ[at]) == 0
    for d in np.flatnonzero(good):
        good[d] = np.array_equal(got[got_at[d]: got_at[d + 1]], raw[at[d]: at[d + 1]])
    return good


def _only(ids: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of good texts: ids, and the number of tokens of every text."""
    sizes = np.diff(ends)
    return ids[np.repeat(good, sizes)], np.where(good, sizes, 0)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of tokens ``(doc, at, k)`` of two sides, ``at`` rising over all documents: the
    places i and j of all overlapping pairs, and for each token of a and of b whether a
    token of the other side starts with it."""
    forth = pd.merge_asof(a, b.assign(start=b["at"]), on="at", by="doc", suffixes=("", "_b"))
    back = pd.merge_asof(b, a.assign(start=a["at"]), on="at", by="doc", suffixes=("", "_a"))
    together_a = (forth["start"] == forth["at"]).to_numpy()
    together_b = (back["start"] == back["at"]).to_numpy()
    more = back[~together_b]  # those that start together are in both directions
    i = np.concatenate([forth["k"].to_numpy(), more["k_a"].to_numpy()])
    j = np.concatenate([forth["k_b"].to_numpy(), more["k"].to_numpy()])
    return i.astype(np.int64), j.astype(np.int64), together_a, together_b


def _tokens(side: Side, ids: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    lengths = np.diff(side.offsets)[ids]
    return pd.DataFrame({"doc": np.repeat(np.arange(len(sizes)), sizes), "at": np.cumsum(lengths) - lengths,
                         "k": np.arange(len(ids))})


def align(a: Side, b: Side, texts: pa.Array) -> dict[str, np.ndarray | list]:
    """One slice of texts: columns of ``ALIGNED`` (without row and doc_id)."""
    n = len(texts)
    full = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    at = np.frombuffer(full.buffers()[1], np.int64)[full.offset: full.offset + n + 1]
    raw = np.frombuffer(full.buffers()[2], np.uint8)[at[0]: at[-1]]
    at = at - at[0]
    (ids_a, ends_a), (ids_b, ends_b) = a.encoder.ids(texts), b.encoder.ids(texts)
    good = some & _covered(a, ids_a, ends_a, raw, at) & _covered(b, ids_b, ends_b, raw, at)
    (ids_a, n_a), (ids_b, n_b) = _only(ids_a, ends_a, good), _only(ids_b, ends_b, good)
    frame_a, frame_b = _tokens(a, ids_a, n_a), _tokens(b, ids_b, n_b)
    i, j, first_a, first_b = overlaps(frame_a, frame_b)
    doc_a, doc_b = frame_a["doc"].to_numpy(), frame_b["doc"].to_numpy()
    n_groups = np.bincount(doc_a[first_a], minlength=n)
    n_links = np.bincount(doc_a[i], minlength=n)
    # distinct pairs of each document
    key = ids_a[i].astype(np.int64) * b.size + ids_b[j]
    order = np.lexsort((key, doc_a[i]))
    key, doc = key[order], doc_a[i][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(key))).astype(np.int32)
    pair_at = np.concatenate([[0], np.cumsum(np.bincount(doc[begin], minlength=n))])
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
            "groups_sha256": _said(a, b, ids_a, ids_b, n_a, n_b, first_a, first_b),
            "pairs": pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), pa.array(key[begin])),
            "times": pa.ListArray.from_arrays(pa.array(pair_at, pa.int32()), pa.array(times))}


def _said(a, b, ids_a, ids_b, n_a, n_b, first_a, first_b) -> list[str]:
    """Hashes of the groups as text, group by group the ids of a, then those of b."""
    last_a, last_b = np.append(first_a[1:], True), np.append(first_b[1:], True)
    begin_a, begin_b = np.append(np.flatnonzero(first_a), len(ids_a)), np.append(np.flatnonzero(first_b), len(ids_b))
    group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
    rows = np.zeros(len(ids_a) + len(ids_b), np.int64)
    rows[np.arange(len(ids_a)) + begin_b[group_a]] = 2 * ids_a.astype(np.int64) + last_a[: len(ids_a)]
    rows[np.arange(len(ids_b)) + begin_a[group_b + 1]] = 2 * (ids_b.astype(np.int64) + a.size) + last_b[: len(ids_b)]
    flat = np.concatenate([a.said, b.said])
    offsets = np.concatenate([a.said_offsets, b.said_offsets[1:] + a.said_offsets[-1]])
    text, ends = gather(flat, offsets, rows)
    raw = text.tobytes()
    cut = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    return [hashlib.sha256(raw[lo: hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(cut[:-1], cut[1:])]


def _aligned(path_a: str, path_b: str):
    def run(batches):
        a, b = sides(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                cols = align(a, b, texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n),
                     *[x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()]],
                    names=["row", "doc_id", *cols])
                row += n
    return run


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: how often each pair of ids is linked, and whether that is the
    most of its B id (pair modulo ``size_b``)."""
    counts = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")) \
        .agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = scratch.put(own.mapInArrow(_aligned(path_a, path_b), ALIGNED), "aligned")
    counts = scratch.put(pair_counts(aligned, sides(path_a, path_b)[1].size), "pairs")
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    known = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    sums = links.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
