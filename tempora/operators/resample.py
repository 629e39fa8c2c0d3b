"""Resampling and paired tests.

The data are reduced to contingency cells first (K x K confusion cells, or K^3 cells of
truth, run A, run B): one partial aggregation at any scale.  A bootstrap replicate is a
multinomial draw over cells, which ``cell_draws`` distributes: the cells of a draw are
dealt by hash to the leaves of a binary tree of about ``LEAF`` cells each, and a leaf gets
its share of the total by binomial draws at the nodes above it, the conditional
distributions of the multinomial.  Every node and leaf draws from a generator seeded by
(seed, chunk of replicates, draw, node), so leaves agree on the nodes that they share
without exchanging anything, results do not depend on partitioning, and a retried task
redraws the same numbers.  No task holds more than a leaf's cells for ``CHUNK`` replicates and,
for each class, the sums of one input batch; the driver holds none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import cut_lineage
from . import metrics
from .ranking import join_null_safe

LEAF, CHUNK, GROUP = 2_000, 200, 64  # cells a leaf, replicates drawn together, leaves a task


def ln_factorial(x: Column) -> Column:
    """ln(x!) for x >= 0 as a column expression: Stirling series on x+9 shifted
    down by eight logarithms (absolute error below 1e-11)."""
    xd = x.cast("double")
    y = xd + F.lit(9.0)
    stirling = ((y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi))
                + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
                - 1 / (1680 * F.pow(y, 7)))
    shift = sum(F.log(xd + F.lit(float(k))) for k in range(1, 9))
    return stirling - shift


def mcnemar(df: DataFrame, y_true: str, pred_a: str, pred_b: str, weight: str | None = None) -> DataFrame:
    """Exact two-sided McNemar (binomial, p = 1/2) on correctness: b = A right and
    B wrong, c = A wrong and B right, p = min(1, 2·P[X <= min(b, c)]),
    X ~ Bin(b+c, 1/2); p = 1 without discordant pairs.  With ``weight`` a row counts that
    often.  The binomial terms are generated as a distributed range."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0))
    bc = df.agg(count((F.col(pred_a) == F.col(y_true)) & (F.col(pred_b) != F.col(y_true))).alias("b"),
                count((F.col(pred_a) != F.col(y_true)) & (F.col(pred_b) == F.col(y_true))).alias("c"))
    b, c = bc.first()
    n, m = b + c, min(b, c)
    spark = df.sparkSession
    terms = spark.range(0, m + 1).select(
        F.exp(ln_factorial(F.lit(n)) - ln_factorial(F.col("id")) - ln_factorial(F.lit(n) - F.col("id"))
              - F.lit(n * math.log(2.0))).alias("t"))
    s = terms.agg(F.sum("t").alias("s"))
    return s.select(F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c"),
                    F.lit(n).cast("long").alias("n_discordant"),
                    (F.lit(1.0) if n == 0 else F.least(F.lit(1.0), 2 * F.col("s"))).alias("p_value"))


def _tree(cells: DataFrame, root: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row a leaf: ``root, leaf, held`` (its cells, ordered by key), ``total`` of the
    draw and ``path`` from the top: (level, node, whether the leaf is in the left half,
    count of the left half, count of the node)."""
    g = list(root)
    sizes = cells.groupBy(*g).agg(F.count(F.lit(1)).alias("__k"), F.sum("n").alias("total")).withColumn(
        "depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("__k") / F.lit(LEAF)))).cast("int")).drop("__k")
    if g:
        placed = join_null_safe(cells, sizes, g)
    else:  # one draw: its size becomes literals
        one = sizes.first()
        placed = cells.withColumn("total", F.lit(one["total"] or 0).cast("long")).withColumn("depth", F.lit(one["depth"] or 0))
    leaf = F.when(F.col("depth") > 0, F.pmod(F.xxhash64(*keys), F.expr("shiftleft(1L, depth)"))) \
        .otherwise(F.lit(0).cast("long"))
    leaves = placed.withColumn("leaf", leaf).groupBy(*g, "depth", "total", "leaf").agg(
        F.array_sort(F.collect_list(F.struct(*keys, "n"))).alias("held"), F.sum("n").alias("here"))
    leaves = cut_lineage(leaves)
    flat = leaves.withColumn("path", F.expr("cast(array() as array<struct<level:int,node:bigint,is_left:boolean,"
                                            "n_left:bigint,n_node:bigint>>)"))
    if not leaves.where("depth > 0").limit(1).count():
        return flat.drop("depth", "here")
    steps = leaves.where("depth > 0").select(*g, "leaf", "here", "depth", F.explode(F.sequence(F.lit(0), "depth")).alias("level")) \
        .withColumn("node", F.expr("shiftright(leaf, level)"))
    nodes = steps.groupBy(*g, "level", "node").agg(F.sum("here").alias("n_node"))
    left = nodes.where("node % 2 = 0").select(*g, (F.col("level") + 1).alias("level"), F.expr("node div 2").alias("node"),
                                              F.col("n_node").alias("n_left"))
    up = join_null_safe(steps.where("level > 0"), nodes, [*g, "level", "node"])
    up = join_null_safe(up, left, [*g, "level", "node"], "left")
    own = up.select(*g, "leaf", F.struct((-F.col("level")).alias("level"), "node", F.expr(
        "shiftright(leaf, level - 1) % 2 = 0").alias("is_left"), F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"),
        "n_node").alias("s"))
    paths = own.groupBy(*g, "leaf").agg(F.array_sort(F.collect_list("s")).alias("path"))  # log2 of the leaves
    deep = join_null_safe(leaves.where("depth > 0"), paths, [*g, "leaf"])
    return flat.where("depth = 0").unionByName(deep).drop("depth", "here")


def _draw(rng_key: list[int], total: int, path, held_n: np.ndarray, leaf: int) -> np.ndarray:
    """Counts (CHUNK x cells) of a leaf's cells."""
    n = np.full(CHUNK, total, np.int64)
    for s in path:
        rng = np.random.default_rng([*rng_key, 1 - int(s["level"]), int(s["node"])])
        part = rng.binomial(n, s["n_left"] / s["n_node"]) if s["n_node"] else np.zeros(CHUNK, np.int64)
        n = part if s["is_left"] else n - part
    here = held_n.sum()
    if not here:
        return np.zeros((CHUNK, len(held_n)), np.int64)
    return np.random.default_rng([*rng_key, 0, leaf]).multinomial(n, held_n / here)


def cell_draws(cells: DataFrame, root: Sequence[str], keys: Sequence[str], roles: dict[str, Sequence[str]],
               group: Sequence[str] = (), b: int = config.BOOTSTRAP_B, seed: int = config.BOOTSTRAP_SEED,
               partitions: int | None = None) -> DataFrame:
    """Sums of redrawn cell counts.  The cells of each ``root`` are redrawn as Multinomial
    (their total, their shares); ``cells`` holds ``root``, ``keys`` and ``n``, a row a cell,
    and is read twice (write it first).
    ``roles``: for each output column the keys that must be equal; the column counts, for
    each class, the draws whose keys all hold the class.  Returns ``group, replicate,
    class`` and the roles' sums; a null key counts for no class."""
    group, root, keys = list(group), list(root), list(keys)
    if not set(group) <= set(root):
        raise ValueError("groups must be part of the draws' roots")
    spark = cells.sparkSession
    chunks = max(1, math.ceil(b / CHUNK))
    leaves = _tree(cells.select(*{c: None for c in [*root, *keys]}, F.col("n").cast("long").alias("n")), root, keys)
    name = F.pmod(F.xxhash64(*[F.col(c) for c in root], F.lit(0)), F.lit(2**62))
    work = leaves.withColumn("root_id", name).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the roots of a group meet, so their sums are merged before they are shuffled again
    work = work.select(*group, "chunk", "root_id", "total", "leaf", "path", "held") \
        .repartition(parts, "chunk", *group, F.floor(F.col("leaf") / GROUP))
    kinds = {c: cells.schema[c].dataType.simpleString() for c in group}
    schema = ", ".join([*[f"`{c}` {k}" for c, k in kinds.items()], "chunk int", "class string",
                        *[f"`{r}` array<bigint>" for r in roles]])

    def run(batches):
        for pdf in batches:
            sums: dict[tuple, np.ndarray] = {}
            for row in pdf.to_dict("records"):
                held = row["held"]
                n = np.array([c["n"] for c in held], np.int64)
                counts = _draw([seed, int(row["chunk"]), int(row["root_id"])], int(row["total"]), row["path"], n,
                               int(row["leaf"]))
                for k, (_, same) in enumerate(roles.items()):
                    own = [c[same[0]] if all(c[x] == c[same[0]] for x in same) else None for c in held]
                    at: dict[str, list[int]] = {}
                    for i, c in enumerate(own):
                        if c is not None:
                            at.setdefault(c, []).append(i)
                    for c, where in at.items():
                        key = (*[row[x] for x in group], int(row["chunk"]), c)
                        if key not in sums:
                            sums[key] = np.zeros((len(roles), CHUNK), np.int64)
                        sums[key][k] += counts[:, where].sum(axis=1)
            if sums:
                yield pd.DataFrame([(*k, *v.tolist()) for k, v in sums.items()],
                                   columns=[*group, "chunk", "class", *roles])

    long = work.mapInPandas(run, schema).select(*group, "chunk", "class", F.posexplode(F.arrays_zip(*roles)))
    long = long.select(*group, (F.col("chunk").cast("long") * CHUNK + F.col("pos")).alias("replicate"), "class",
                       *[F.col("col")[r].alias(r) for r in roles]).where(F.col("replicate") < b)
    return long.groupBy(*group, "replicate", "class").agg(*[F.sum(r).alias(r) for r in roles])


def _prf(tp: str, n_pred: str, n_true: str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts, 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (share(F.col(tp), F.col(n_pred)), share(F.col(tp), F.col(n_true)),
            share(2 * F.col(tp), F.col(n_pred) + F.col(n_true)))


def _all_cells(cells: DataFrame, classes: Sequence[str] | None, run: str) -> DataFrame:
    """The cells of each run whose truth and prediction are classes, with an empty
    diagonal cell for each class: given classes, else those that the run holds."""
    if run not in cells.columns:
        cells = cells.withColumn(run, F.lit(""))
    cells = cells.select(F.col(run).alias("run"), "y_true", "y_pred", F.col("n").cast("long").alias("n")) \
        .where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    if classes is None:
        own = cells.select("run", F.explode(F.array("y_true", "y_pred")).alias("c")).distinct()
    else:
        own = cells.select("run").distinct().withColumn("c", F.explode(F.array(*[F.lit(c) for c in classes])))
        cells = cells.where(F.col("y_true").isin(list(classes)) & F.col("y_pred").isin(list(classes)))
    empty = own.select("run", F.col("c").alias("y_true"), F.col("c").alias("y_pred"), F.lit(0).cast("long").alias("n"))
    return cut_lineage(cells.unionByName(empty).groupBy("run", "y_true", "y_pred").agg(F.sum("n").alias("n")))


def confusion_bootstrap(cells: DataFrame, classes: Sequence[str] | None = None,
                        b: int = config.BOOTSTRAP_B, seed: int = config.BOOTSTRAP_SEED,
                        run: str = "run", partitions: int | None = None) -> DataFrame:
    """Per run and replicate: every confusion row is redrawn as
    Multinomial(row total, row shares) (empty rows stay zero); returns long rows
    ``run, replicate, class, precision, recall, f1`` plus ``class = '__macro__'``
    holding macro-F1 over all K classes in ``f1``.  Cells whose truth or prediction is
    null or no class are left out."""
    return _confusion_draws(_all_cells(cells, classes, run), b, seed, partitions)


def _confusion_draws(full: DataFrame, b: int, seed: int, partitions: int | None) -> DataFrame:
    draws = cut_lineage(cell_draws(full, ["run", "y_true"], ["y_true", "y_pred"],
                                   {"n_true": ["y_true"], "n_pred": ["y_pred"], "tp": ["y_true", "y_pred"]},
                                   ["run"], b, seed, partitions))
    p, r, f = _prf("tp", "n_pred", "n_true")
    per = draws.select("run", "replicate", "class", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    macro = per.groupBy("run", "replicate").agg(F.avg("f1").alias("f1")).select(
        "run", "replicate", F.lit("__macro__").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1")
    return per.unionByName(macro)


def bootstrap_report(cells: DataFrame, classes: Sequence[str] | None = None, b: int = config.BOOTSTRAP_B,
                     seed: int = config.BOOTSTRAP_SEED, run: str = "run", partitions: int | None = None) -> DataFrame:
    """Summary of many runs: for each ``run`` and ``class`` the ``support``, and for
    precision, recall and f1 the point value, the 95 % percentile interval and its width;
    class ``__macro__`` holds macro-F1 and all rows as support (no precision or recall)."""
    full = _all_cells(cells, classes, run)
    draws = _confusion_draws(full, b, seed, partitions)
    names = ("precision", "recall", "f1")
    ci = draws.groupBy("run", "class").agg(*[e for m in names for e in (
        F.percentile(m, 0.025).alias(f"{m}_ci_lo"), F.percentile(m, 0.975).alias(f"{m}_ci_hi"))])
    point = metrics.per_class(full, ["run"], weight="n").select("run", "class", "support", *names)
    macro = point.groupBy("run").agg(F.sum("support").alias("support"), F.avg("f1").alias("f1")).select(
        "run", F.lit("__macro__").alias("class"), "support", F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1")
    point = point.unionByName(macro).withColumnsRenamed({m: f"{m}_point" for m in names})
    out = join_null_safe(point, ci, ["run", "class"])
    return out.select("run", "class", "support", *[c for m in names for c in (
        F.col(f"{m}_point"), F.col(f"{m}_ci_lo"), F.col(f"{m}_ci_hi"),
        (F.col(f"{m}_ci_hi") - F.col(f"{m}_ci_lo")).alias(f"{m}_ci_width"))])


def percentile_ci(draws: DataFrame, value: str, by: Sequence[str], lo: float = 0.025,
                  hi: float = 0.975) -> DataFrame:
    """Linear-interpolated percentile interval per group.  Groups hold B values
    (a parameter, not data), so the exact in-memory percentile is bounded."""
    return draws.groupBy(*by).agg(F.percentile(value, lo).alias(f"{value}_ci_lo"),
                                  F.percentile(value, hi).alias(f"{value}_ci_hi"))


def paired_cells(pairs: DataFrame, y_true: str = "y_true", pred_a: str = "pred_a",
                 pred_b: str = "pred_b") -> DataFrame:
    """Contingency cells (truth, A, B) with counts — at most K³ rows; written once."""
    return cut_lineage(pairs.groupBy(F.col(y_true).alias("y_true"), F.col(pred_a).alias("pred_a"),
                                     F.col(pred_b).alias("pred_b")).agg(F.count(F.lit(1)).alias("n")))


def paired_bootstrap(pairs: DataFrame, b: int = config.BOOTSTRAP_B,
                     seed: int = config.BOOTSTRAP_SEED, partitions: int | None = None,
                     y_true: str = "y_true", pred_a: str = "pred_a",
                     pred_b: str = "pred_b") -> DataFrame:
    """Paired bootstrap of macro-F1 (observed labels): resampling n rows with
    replacement is Multinomial(n, cell shares) over the (truth, A, B) cells, so
    each replicate draws at most K^3 counts, not n indices.  Rows ``replicate, macro_f1_a,
    macro_f1_b, delta``.  A null prediction is no class; without rows there is no replicate."""
    return _paired_draws(paired_cells(pairs, y_true, pred_a, pred_b), b, seed, partitions)


def _paired_draws(cells: DataFrame, b: int, seed: int, partitions: int | None) -> DataFrame:
    draws = cell_draws(cells, [], ["y_true", "pred_a", "pred_b"],
                       {"n_true": ["y_true"], "n_a": ["pred_a"], "n_b": ["pred_b"],
                        "tp_a": ["y_true", "pred_a"], "tp_b": ["y_true", "pred_b"]}, [], b, seed, partitions)

    def macro(x):  # classes in truth or prediction
        return F.coalesce(F.avg(F.when(F.col("n_true") + F.col(f"n_{x}") > 0, _prf(f"tp_{x}", f"n_{x}", "n_true")[2])),
                          F.lit(0.0)).alias(f"macro_f1_{x}")

    return draws.groupBy("replicate").agg(macro("a"), macro("b")).withColumn(
        "delta", F.col("macro_f1_a") - F.col("macro_f1_b"))


def paired_report(boot: DataFrame) -> DataFrame:
    """Means and 95 % percentile intervals of both runs and of their difference;
    ``significant`` when the difference's interval excludes zero."""
    agg = boot.agg(*[e for c in ("macro_f1_a", "macro_f1_b", "delta") for e in (
        F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.025).alias(f"{c}_ci_lo"),
        F.percentile(c, 0.975).alias(f"{c}_ci_hi"))], F.count(F.lit(1)).alias("b"))
    return agg.withColumn("significant", (F.col("delta_ci_lo") > 0) | (F.col("delta_ci_hi") < 0))


def paired_comparison(pairs: DataFrame, b: int = config.BOOTSTRAP_B, seed: int = config.BOOTSTRAP_SEED,
                      y_true: str = "y_true", pred_a: str = "pred_a", pred_b: str = "pred_b") -> DataFrame:
    """The whole report of two runs, one row: points of both and their difference, the
    bootstrap of ``paired_report``, McNemar's counts and p."""
    cells = paired_cells(pairs, y_true, pred_a, pred_b)
    points = [metrics.summary(cells, [], "y_true", x, weight="n").select(
        F.col("macro_f1").alias(f"point_macro_f1_{x[-1]}")) for x in ("pred_a", "pred_b")]
    test = mcnemar(cells, "y_true", "pred_a", "pred_b", "n")
    rows = [*points, paired_report(_paired_draws(cells, b, seed, None)),
            test.select(*[F.col(c).alias(f"mcnemar_{c}") for c in test.columns])]
    keyed = [r.withColumn("__one", F.lit(1)) for r in rows]  # one row each
    out = reduce(lambda x, y: x.join(y, "__one"), keyed).drop("__one")
    return out.withColumn("point_delta", F.col("point_macro_f1_a") - F.col("point_macro_f1_b"))


def check_pairing(run_a: DataFrame, run_b: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Full outer join of two prediction runs; raises unless both cover the
    same samples with the same truth.  Returns ``id, y_true, pred_a, pred_b``."""
    j = run_a.select(id_col, F.col("y_true").alias("ta"), F.col("y_pred").alias("pred_a")).join(
        run_b.select(id_col, F.col("y_true").alias("tb"), F.col("y_pred").alias("pred_b")), id_col, "full")
    bad = j.where(F.col("ta").isNull() | F.col("tb").isNull() | (F.col("ta") != F.col("tb"))).limit(1).count()
    if bad:
        raise ValueError("runs do not share the same test samples and truths")
    return j.select(id_col, F.col("ta").alias("y_true"), "pred_a", "pred_b")
