"""Document fingerprints from prefix polynomial hashes.

A text's code points are the coefficients of a polynomial; ``PrefixHashes`` keeps its
values modulo the prime 2^31 - 1 at two bases for all prefixes.  From them the hash of any
span takes two look-ups, spans are compared in constant time, and the longest common
extension of two places is found by binary search.

A fingerprint is a short string of span hashes: the length and the hash of the whole
text, the hashes of prefixes and of suffixes whose lengths grow by an eighth, and the
``SAMPLE`` smallest distinct hashes of all spans of ``SPAN`` code points.  ``likeness``
of two fingerprints is the larger of two shares: that of the common prefix and suffix,
found by binary search over the stored lengths, in the longer text; and that of common
spans in all spans of both texts, as the samples show it.  It is 1 for equal
fingerprints only.

``neighbours`` needs every document beside the next one in ascending id order.  Quantiles
of the ids (one aggregate) cut the ids into as many ranges as there are shuffle
partitions; an id that holds several ranges (one id, or none, on very many rows) is dealt
over them by the hash of the text.  Texts are shuffled once, by range, together with a
copy of the first document of the next range; so ranges are complete in themselves and no
task waits for another.  What the driver sees is one key a range.

Edge cases: a null or empty text has no spans; two of them are alike; a text shorter than
``SPAN`` is one span; rows without an id come first, rows that repeat an id follow each
other by the hash of their texts; the document after the last is the first (a table of
one row: itself); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix

PRIME = np.uint64(2**31 - 1)
BASES = (1_102_382_059, 731_408_393)
SPAN, SAMPLE, GROWTH = 16, 48, 1.125
SLICE = 1 << 19  # code points that are hashed at once
_STEP = 1 << 12


def _mod(x: np.ndarray) -> np.ndarray:
    """Values below 2^63 modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.minimum(x, x - PRIME)  # below the prime the difference wraps around


class _Powers:
    """Powers of a base modulo the prime: by two short tables, whatever the exponent; the
    first ``KEPT`` are kept."""

    KEPT = 1 << 21

    def __init__(self, base: int):
        self.base, self.small = base, self._table(base, _STEP)
        self.large = np.ones(1, np.uint64)
        self.kept = self.small

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        for i in range(1, n):
            out[i] = int(out[i - 1]) * base % int(PRIME)
        return out

    def _blocks(self, n: int) -> np.ndarray:
        """Powers of ``base ** _STEP``, n of them or more."""
        if n > len(self.large):
            self.large = self._table(pow(self.base, _STEP, int(PRIME)), max(n, 2 * len(self.large)))
        return self.large

    def first(self, n: int) -> np.ndarray:
        """The powers 0 to n - 1."""
        if n > len(self.kept):
            blocks = -(-n // _STEP)
            out = _mod(self._blocks(blocks)[:blocks, None] * self.small[None, :]).ravel()
            if n > self.KEPT:
                return out[:n]
            self.kept = out
        return self.kept[:n]

    def __call__(self, n: np.ndarray) -> np.ndarray:
        most = int(n.max(initial=0))
        if most < self.KEPT:
            return self.first(most + 1)[n]
        return _mod(self._blocks((most >> 12) + 1)[n >> 12] * self.small[n & (_STEP - 1)])


@lru_cache(maxsize=None)
def _powers(base: int, inverse: bool) -> _Powers:
    return _Powers(pow(base, -1, int(PRIME)) if inverse else base)


class PrefixHashes:
    """Prefix hashes of several texts, laid one after the other."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.sums = []
        for base in BASES:
            terms = (codes + np.uint64(1)) * _powers(base, False).first(len(codes))
            total = np.zeros(len(codes) + 1, np.uint64)
            # a folded term is below 2^32, so 2^31 of them fit
            np.cumsum((terms & PRIME) + (terms >> np.uint64(31)), out=total[1:])
            self.sums.append(_mod(total))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes (62 bits) of the spans ``[start, end)``; equal spans of any texts have
        equal hashes."""
        parts = [_mod((t[end] + PRIME - t[start]) * _powers(base, True)(start)) for t, base in zip(self.sums, BASES)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def every(self, size: int) -> np.ndarray:
        """Hashes of the spans of ``size`` code points at all places."""
        n = max(0, len(self.sums[0]) - size)
        parts = [_mod((t[size:] + PRIME - t[:n]) * _powers(base, True).first(n)) for t, base in zip(self.sums, BASES)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Longest common extension, up to ``most``, of places i and j: to the right, or
        with ``back`` to the left; by binary search."""
        low, high = np.zeros(len(i), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.spans(i - n, i) == self.spans(j - n, j) if back else self.spans(i, i + n) == self.spans(j, j + n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low

    def fingerprints(self) -> list[str]:
        start, end = self.off[:-1], self.off[1:]
        n = end - start
        whole = mix(self.spans(start, end) ^ n.astype(np.uint64))
        anchors = np.searchsorted(lengths(int(n.max(initial=0))), n, "right")
        at = np.concatenate([[0], np.cumsum(anchors)])
        doc = np.repeat(np.arange(len(n)), anchors)
        size = lengths(int(n.max(initial=0)))[np.arange(at[-1]) - at[doc]]
        left = (mix(self.spans(start[doc], start[doc] + size)) >> np.uint64(48)).astype(">u2")
        right = (mix(self.spans(end[doc] - size, end[doc])) >> np.uint64(48)).astype(">u2")
        every = mix(self.every(SPAN)) >> np.uint64(32)
        short = mix(self.spans(start, end)) >> np.uint64(32)
        out = []
        for d in range(len(n)):
            if n[d] >= SPAN:
                sample = smallest(every[start[d]: end[d] - SPAN + 1])
            else:
                sample = short[d: d + 1] if n[d] else every[:0]
            out.append(".".join([f"{n[d]:x}", f"{int(whole[d]):016x}", left[at[d]: at[d + 1]].tobytes().hex(),
                                 right[at[d]: at[d + 1]].tobytes().hex(), sample.astype(">u4").tobytes().hex()]))
        return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``SAMPLE`` smallest distinct values, sorted."""
    k = 4 * SAMPLE
    while k < len(hashes):
        some = _distinct(np.partition(hashes, k)[:k])
        if len(some) >= SAMPLE:
            return some[:SAMPLE]
        k *= 8
    return _distinct(hashes)[:SAMPLE]


@lru_cache(maxsize=4)
def _lengths(bits: int) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << bits:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


def lengths(most: int) -> np.ndarray:
    """The lengths of stored prefixes and suffixes, beyond ``most``."""
    return _lengths(max(24, most.bit_length() + 1))


def likeness(one: str, other: str) -> float:
    """From 0 to 1; 1 for equal fingerprints only."""
    if one == other:
        return 1.0
    n, _, *ends, sample = one.split(".")
    m, _, *ends2, sample2 = other.split(".")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    grid = lengths(max(n, m))
    both = min(sum(_shared(x, y, grid) for x, y in zip(ends, ends2)), n, m)
    a, b = ({s[i: i + 8] for i in range(0, len(s), 8)} for s in (sample, sample2))
    union = sorted(a | b)[:SAMPLE]
    spans = sum(x in a and x in b for x in union) / max(len(union), 1)
    return min(max(both / max(n, m), spans), 1 - 1 / (1 + max(n, m)))


def _shared(x: str, y: str, grid: np.ndarray) -> int:
    """The largest stored length at which both are equal: up to it all are, by binary
    search."""
    low, high = 0, min(len(x), len(y)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        at = slice(4 * mid - 4, 4 * mid)
        low, high = (mid, high) if x[at] == y[at] else (low, mid - 1)
    return int(grid[low - 1]) if low else 0


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, common_prefix long, common_suffix long")


def _edited(texts: list[str]) -> list[str]:
    """Each text but the last, its last quarter replaced by the begin of the next one."""
    out = []
    for text, after in zip(texts, texts[1:]):
        k = len(text) // 4
        out.append(text[: len(text) - k] + after[:k])
    return out


def _finish(ids: list, texts: list[str], last: str | None) -> pa.RecordBatch:
    """Rows of all documents but the last one, which is only their next; ``last``: the
    first one's fingerprint, if known."""
    edited = _edited(texts)
    hashed = PrefixHashes(texts + edited)
    prints = hashed.fingerprints()
    own, new = prints[: len(texts)], prints[len(texts):]
    n = len(edited)
    start, start2 = hashed.off[:n], hashed.off[len(texts): len(texts) + n]
    end, end2 = hashed.off[1: n + 1], hashed.off[len(texts) + 1:]
    most = np.minimum(end - start, end2 - start2)
    left = hashed.common(start, start2, most)
    right = hashed.common(end, end2, most - left, back=True)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids[:n], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": own[:n], "edited_fingerprint": new,
        "near_edited": pa.array(map(likeness, own, new), pa.float64()),
        "near_next": pa.array(map(likeness, own, own[1:]), pa.float64()),
        "common_prefix": left, "common_suffix": right})


def _pairs(batches):
    """Sorted rows (range, last, id, text): each range ends with the copy of the document
    that follows it."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for b in batches:
        for copy, key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            text = text.as_py() or ""
            ids.append(key)
            texts.append(text)
            held += len(text)
            if copy or held >= SLICE:
                if len(ids) > 1:
                    yield _finish(ids, texts, None)
                # the last one goes on as the first of what follows, unless it is a copy
                ids, texts = ([], []) if copy else (ids[-1:], texts[-1:])
                held = sum(map(len, texts))


def _range_of(cuts: np.ndarray, none: int):
    """Order of (id, hash) -> range.  ``cuts``: quantiles of the ids; an id that is several
    of them holds the ranges between; ``none``: ranges of rows without an id."""
    def share(hashes, parts):
        unit = (hashes.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return ((unit * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)

    def run(batches):
        for b in batches:
            ids = b.column(0)
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            hashes = b.column(1).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            own = none + low + share(hashes, high - low + 1)
            own = np.where(empty, share(hashes, np.full(len(key), max(none, 1))), own)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *b.columns],
                                             names=["range", *b.schema.names])
    return run


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: columns ``OUT``."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"),
                      F.col(text_col).alias("text"))
    steps = [k / ranges for k in range(1, ranges)] or [0.5]
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"),
                   F.percentile_approx("id", steps, 10 * ranges).alias("cuts")).first()
    none = -(-ranges * (seen["n"] - seen["ids"]) // max(seen["n"], 1))
    deal = _range_of(np.array(seen["cuts"] or [], np.int64), none)
    keys = own.select("id", "hash").mapInArrow(deal, "range int, id long, hash long")
    first = keys.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "hash")).alias("k")) \
        .orderBy("range").collect()  # one key a range
    if not first:
        return spark.createDataFrame([], OUT)
    after = spark.createDataFrame(
        [(first[i - 1]["range"], x["k"]["id"], x["k"]["hash"]) for i, x in enumerate(first)],
        "range int, id long, hash long")
    copies = own.join(F.broadcast(after), own["id"].eqNullSafe(after["id"]) & (own["hash"] == after["hash"])) \
        .groupBy("range").agg(F.min(F.struct(own["id"], own["text"])).alias("row")) \
        .select("range", F.lit(True).alias("copy"), "row.id", F.lit(0).cast("long").alias("hash"), "row.text")
    rows = own.mapInArrow(deal, "range int, id long, hash long, text string") \
        .select("range", F.lit(False).alias("copy"), "id", "hash", "text").unionByName(copies)
    total = first[-1]["range"] + 1
    return rows.repartitionById(total, F.col("range")) \
        .sortWithinPartitions("range", "copy", F.asc_nulls_first("id"), "hash") \
        .select("range", "copy", "id", "text").mapInArrow(_pairs, OUT)
