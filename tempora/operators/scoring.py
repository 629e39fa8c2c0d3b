"""A nearest-centroid probability model over dense vectors.

Fitting is one partial aggregation (mean per group, class and dimension); the
fitted model is a small DataFrame — one row per model group holding the sorted
class list and the K×d centroid matrix — bounded by classes × dimensions, not
by rows.  Scoring joins it to the rows by broadcast, like shipping any fitted
model to executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MODEL_CELLS = 5_000_000


def fit_centroids(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Model table ``by…, classes array<string>, cents array<array<double>>,
    norms array<double>`` (classes sorted, dimensions in order)."""
    g = list(by)
    cells = (df.select(*g, F.col(label).cast("string").alias("__c"),
                       F.posexplode(vec).alias("__i", "__x"))
             .groupBy(*g, "__c", "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m")))
    per_class = cells.groupBy(*g, "__c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("__v"))
    per_class = per_class.withColumn("__norm", F.sqrt(F.aggregate(
        F.transform("__v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)))
    agg = per_class.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("__c", "__v", "__norm"))).alias("__s"))
    return agg.select(*g, F.transform("__s", lambda s: s["__c"]).alias("classes"),
                      F.transform("__s", lambda s: s["__v"]).alias("cents"),
                      F.transform("__s", lambda s: s["__norm"]).alias("norms"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_logits(vec: str, temperature: float = 10.0) -> Column:
    """``temperature · cos(vec, centroid_k)`` for every class k of the joined
    model columns ``cents`` / ``norms``.  Per-row quantities (the vector norm)
    are evaluated once and handed to the per-class lambda as array elements —
    a value captured inside a higher-order lambda is re-evaluated per element."""
    v = F.col(vec)
    vnorm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    denom = F.zip_with("norms", F.array_repeat(vnorm, F.size("norms")), lambda nc, nv: nc * nv)
    dots = F.transform("cents", lambda c: F.aggregate(
        F.zip_with(v, c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x))
    return F.zip_with(dots, denom, lambda dt, dn: F.lit(float(temperature)) * dt / dn)


def softmax(logits: Column) -> Column:
    """exp(z) / Σ exp(z) with the sum evaluated once per row."""
    ex = F.transform(logits, lambda z: F.exp(z))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(ex, F.array_repeat(tot, F.size(ex)), lambda e, t: e / t)


def score(rows: DataFrame, model: DataFrame, vec: str, by: Sequence[str] = (),
          temperature: float = 10.0) -> DataFrame:
    """Adds ``p`` (class probabilities) and ``classes`` to ``rows``.  The model
    table is bounded (checked) and broadcast."""
    g = list(by)
    if g:
        n = model.select(F.sum(F.size("cents") * F.size(F.element_at("cents", 1)))).first()[0] or 0
        if n > MAX_MODEL_CELLS:
            raise ValueError(f"centroid model of {n} cells is too large to broadcast")
        j = rows.join(F.broadcast(model), g)
    else:  # a single model: its row becomes literal columns
        m = model.first()
        if len(m["cents"]) * len(m["cents"][0]) > MAX_MODEL_CELLS:
            raise ValueError("centroid model too large to ship")
        j = rows.withColumn("cents", F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m["cents"]])) \
            .withColumn("norms", F.array(*[F.lit(float(x)) for x in m["norms"]])) \
            .withColumn("classes", F.array(*[F.lit(c) for c in m["classes"]]))
    return j.withColumn("p", softmax(cosine_logits(vec, temperature))).drop("cents", "norms")
