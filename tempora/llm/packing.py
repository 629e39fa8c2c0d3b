"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``max_len`` units (nothing is dropped), and
the lengths of all pieces are counted.  Dynamic programming over that histogram (at
most ``max_len`` rows, whatever the corpus) places ``buckets`` upper bounds so that
the padding of all pieces to their bucket's bound is the least possible.  Inside a
bucket of bound b a batch holds ``budget // b`` pieces: its padded size never exceeds
the token budget.

Scale: the histogram is a grouped count with partial sums.  A bucket's pieces are
dealt by hash over as many lanes as its count asks for (about ``LANE`` pieces each),
and batches are numbered within a lane, so no bucket, however common its length, is
in one task; each lane leaves at most one batch unfilled.  The pieces (a few numbers
each) are written once with a number for each row, which deals rows that share all else,
such as rows without an id: lanes then hold on a retry of a task.

The unit is a white-space word plus one closing mark by default; ``length`` may be
any column expression.  ``token_lengths`` gives the number of ids that the token store
writes for a text, its end id included, so that bounds and budget hold for token ids.

Edge cases: null and empty texts have length 1 (the closing mark); equal lengths share
a bucket; repeated rows and rows without an id are packed like others, over all lanes; fewer distinct lengths than buckets give
fewer buckets; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .tokens import as_texts, encoder

LANE = 20_000


def word_length(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens``: ids of each whole text and one end id; written once, since
    packing reads lengths twice."""
    def run(batches):
        own = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                n = [len(raw) // 4 + 1 for raw in own.encode(as_texts(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    own = docs.select(F.col(id_col), F.col(text_col))
    kind = own.schema[0].dataType.simpleString()
    return Scratch(docs.sparkSession, "packing").put(
        own.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col), "lengths")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``cost[k][j]``: least padding of the j smallest lengths in k buckets; the last
    bucket holds lengths i..j-1 and is padded to ``lengths[j - 1]``."""
    order = np.argsort(lengths)
    x = np.array(lengths, np.float64)[order]
    n = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64)[order])])
    s = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64)[order] * x)])
    m = len(x)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        new[0] = 0
        for j in range(1, m + 1):
            padded = cost[:j] + x[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(padded))
            new[j] = padded[cut[j]]
        back.append(cut)
        cost = new
    bounds, j = [], m
    for cut in reversed(back):
        if j:
            bounds.append(int(x[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pieces(docs: DataFrame, id_col: str, length: Column, max_len: int) -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_len)).cast("int"))
    return own.select("doc_id", "n", F.explode(starts).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * max_len).alias("start"),
        F.least(F.lit(max_len), F.col("n") - F.col("piece").cast("long") * max_len).alias("length"))


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text",
         max_len: int = 2048, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bound, padding, lane, batch,
    slot``; (bound, lane, batch) names a batch of padded size ``<= budget``."""
    cut = pieces(docs, id_col, word_length(text_col) if length is None else length, max_len) \
        .withColumn("row", F.monotonically_increasing_id())
    cut = Scratch(docs.sparkSession, "packing").put(cut, "pieces")
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= max_len rows
    if not histogram:
        bounds, lanes = [max_len], {max_len: 1}
    else:
        bounds = best_bounds([r["length"] for r in histogram], [r["n"] for r in histogram], buckets)
        held = {b: 0 for b in bounds}
        for r in histogram:
            held[next(b for b in bounds if b >= r["length"])] += r["n"]
        lanes = {b: max(1, -(-n // LANE)) for b, n in held.items()}
    bound = F.coalesce(*[F.when(F.col("length") <= b, F.lit(b)) for b in bounds], F.lit(bounds[-1]))
    n_lanes = F.coalesce(*[F.when(F.col("bound") == b, F.lit(k)) for b, k in lanes.items()], F.lit(1))
    dealt = cut.withColumn("bound", bound.cast("long")) \
        .withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "length", "row"), n_lanes).cast("long"))
    numbered = dealt.select("*", (F.row_number().over(_lane()) - 1).cast("long").alias("i"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound")))
    return numbered.select("doc_id", "piece", "start", "length", "bound",
                           (F.col("bound") - F.col("length")).alias("padding"), "lane",
                           F.floor(F.col("i") / size).alias("batch"), (F.col("i") % size).cast("long").alias("slot"))


def _lane():
    from pyspark.sql import Window

    return Window.partitionBy("bound", "lane").orderBy("doc_id", "piece", "length", "row")
