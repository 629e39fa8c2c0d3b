"""Models of all held-out classes from one pass over the rows.

The known training rows of held-out class h are the rows of the other classes up to
h's last training row.  The K last training rows cut the order of all rows into K + 1
stretches; one aggregation sums the feature vectors by (class, stretch), and a running
total over the stretches gives the sums of every model.  Two models are functions of
such sums: nearest centroid (cosine) and multinomial naive Bayes.

Scale: rows are read once to sum and once to score, and are never copied by held-out
class before they are scored: a task multiplies a batch of vectors with the models.  The
driver walks the stretches in order and holds the sums of one model and the weights of
one block of models, at most ``BLOCK_CELLS`` numbers (or one model, classes x
dimensions, where that is more); further blocks take a further scan each.

Edge cases: rows without a class train no model but are scored as known rows; a null vector
trains nothing and is scored as zeros; a centroid or vector of zeros has cosine 0 with all; a class
without training rows is not predicted; a model without any class predicts null with null
scores; with one class the margin is its probability; ties go to the first class in
order.  Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .selection import at_most
from .splits import aligned_parts

BLOCK_CELLS = 4_000_000
KINDS = ("centroid", "naive_bayes")


def _ordered(cuts: list[dict]) -> list[tuple | None]:
    """Distinct last training rows in order (None: no training row; dates may be null)."""
    rows = {c["train"] for c in cuts if c["train"] is not None}
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def stretch_sums(df: DataFrame, cuts: list[dict], vec: str, id_col: str = "sample_id", label: str = "label",
                 date: str = "date") -> DataFrame:
    """``class, stretch, n, total (array<double>)`` of the rows that train some model."""
    ends = _ordered(cuts)
    kinds = [df.schema[date].dataType, df.schema[id_col].dataType]
    after = F.lit(0)
    for row in ends:
        after = after + F.when(at_most([date, id_col], [F.lit(v).cast(k) for v, k in zip(row, kinds)]), 0).otherwise(1)
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(label).cast("string").alias("class"), after.alias("stretch"),
        array_to_vector(F.col(vec).cast("array<double>")).alias("v")).where(F.col("stretch") < len(ends))
    sums = rows.groupBy("class", "stretch").agg(Summarizer.metrics("sum", "count").summary(F.col("v")).alias("s"))
    return sums.select("class", "stretch", F.col("s.count").alias("n"), vector_to_array("s.sum").alias("total"))


def _weights(total: np.ndarray, n: np.ndarray, kind: str, temperature: float, alpha: float) -> np.ndarray:
    """One row of weights a class."""
    if kind == "centroid":
        mean = total / n[:, None]
        norm = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        return temperature * mean / np.where(norm > 0, norm, 1.0)
    return np.log((total + alpha) / (total.sum(axis=1, keepdims=True) + alpha * total.shape[1]))


def models(sums: DataFrame, cuts: list[dict], kind: str, temperature: float = 10.0,
           alpha: float = 1.0) -> Iterator[list[tuple[dict, list[str], np.ndarray]]]:
    """Blocks of ``(cut, classes, weights)``, in the order of the last training rows."""
    if kind not in KINDS:
        raise ValueError(f"Unsupported open-set model: {kind}")
    ends = _ordered(cuts)
    place = {row: i for i, row in enumerate(ends)}
    total: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    block, cells = [], 0
    for c in cuts:
        if c["train"] is None:
            block.append((c, [], np.zeros((0, 0))))
    size = sums.agg(F.count_distinct("class").alias("k"), F.max(F.size("total")).alias("d")).first()
    step = max(1, BLOCK_CELLS // max(1, (size["k"] or 0) * (size["d"] or 0)))  # stretches read together
    for i, row in enumerate(ends):
        if i % step == 0:
            read: dict[int, list] = {}
            for r in sums.where(F.col("stretch").between(i, i + step - 1)).collect():  # a row a class and stretch
                read.setdefault(r["stretch"], []).append(r)
        for r in read.get(i, []):
            total[r["class"]] = total.get(r["class"], 0.0) + np.asarray(r["total"])
            n[r["class"]] = n.get(r["class"], 0) + r["n"]
        for c in cuts:
            if c["train"] is None or place[c["train"]] != i:
                continue
            known = sorted(k for k in total if k != str(c["heldout"]))
            w = _weights(np.stack([total[k] for k in known]), np.array([float(n[k]) for k in known]),
                         kind, temperature, alpha) if known else np.zeros((0, 0))
            if block and cells + w.size > BLOCK_CELLS:
                yield block
                block, cells = [], 0
            block.append((c, known, w))
            cells += w.size
    if block:
        yield block


def _scorer(spark, block: list, kind: str):
    shared = spark.sparkContext.broadcast([(known, w) for _, known, w in block])
    width = max((w.shape[1] for _, _, w in block), default=0)

    @F.pandas_udf("pred array<string>, max_prob array<double>, margin array<double>")
    def run(vectors: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            if v is not None:
                x[i] = v
        if kind == "centroid":
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x /= np.where(norm > 0, norm, 1.0)
        pred = np.full((len(x), len(shared.value)), None, object)
        best, margin = np.full(pred.shape, np.nan), np.full(pred.shape, np.nan)
        for j, (known, w) in enumerate(shared.value):
            if not known:
                continue
            z = x @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            pred[:, j] = np.array(known, object)[p.argmax(axis=1)]
            top = np.sort(p, axis=1)[:, ::-1]
            best[:, j] = top[:, 0]
            margin[:, j] = top[:, 0] - (top[:, 1] if len(known) > 1 else 0.0)
        return pd.DataFrame({"pred": pred.tolist(), "max_prob": best.tolist(), "margin": margin.tolist()})

    return run


def score(df: DataFrame, cuts: list[dict], vec: str, kind: str = "centroid", id_col: str = "sample_id",
          label: str = "label", date: str = "date", places: int | None = None, temperature: float = 10.0,
          alpha: float = 1.0) -> DataFrame:
    """Rows ``heldout, id, y_true, part, y_pred, method, score`` of every validation, known
    and unknown test row under each model that it is judged by, for the methods ``max_prob``
    and ``margin``; with ``places`` scores are rounded.  Written once."""
    schema = "heldout string, {} {}, y_true string, part string, y_pred string, method string, score double".format(
        id_col, df.schema[id_col].dataType.simpleString())
    if not cuts:
        return df.sparkSession.createDataFrame([], schema)
    sums = cut_lineage(stretch_sums(df, cuts, vec, id_col, label, date))
    digits = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    value = lambda c: digits(F.when(~F.isnan(c), c))
    out = None
    for block in models(sums, cuts, kind, temperature, alpha):
        run = _scorer(df.sparkSession, block, kind)
        own = df.select(F.col(id_col), F.col(label).cast("string").alias("y_true"),
                        aligned_parts(df, [c for c, _, _ in block], id_col, label, date).alias("at"),
                        F.col(vec).cast("array<double>").alias("v"))
        own = own.where(F.exists("at", lambda a: a["part"] != "train"))
        rows = own.select(id_col, "y_true", "at", run("v").alias("s")) \
            .select(id_col, "y_true", F.inline(F.arrays_zip("at", "s.pred", "s.max_prob", "s.margin"))) \
            .where(F.col("at.part") != "train")
        rows = rows.select(F.col("at.heldout").cast("string").alias("heldout"), id_col, "y_true", "at.part",
                           F.col("pred").alias("y_pred"), F.explode(F.array(*[
                               F.struct(F.lit(m).alias("method"), value(F.col(m)).alias("score"))
                               for m in ("max_prob", "margin")])).alias("m"))
        rows = rows.select("heldout", id_col, "y_true", "part", "y_pred", "m.method", "m.score")
        out = rows if out is None else out.unionByName(rows)
    return cut_lineage(out)
