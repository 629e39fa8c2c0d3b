"""Evaluation splits as keyed assignments ``(id, part)`` — never row positions.

All splits are exact in size.  A split is a few rows at given ranks (``selection``):
class counts give the ranks, one histogram of (stretch of the order, class), refined
around them, gives the rows, and each row of the input is compared with its class's
rows.  Nothing is sorted or copied per class, and a class holding a third of all rows
is spread over as many tasks as the input has.  The driver holds class counts and cut
rows, one a class.

Ties in the order are broken by the sample id.  A null class is a class of its own;
undated rows come after all dates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from .ranking import join_null_safe
from .selection import Rank, at_most, rows_at

BROADCAST_ROWS = 100_000  # cut tables beyond are joined without a hint


def hash_key(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random order key: md5 of ``id|seed`` (identical in DuckDB)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|"), F.lit(str(seed))))


def _apportion(counts: DataFrame, label: str, weight: str, total: Column, out: str) -> DataFrame:
    """Largest-remainder split of ``total`` over classes in proportion to
    ``weight``; remainders tie-break by class name.  ``counts`` has one row per
    class (small), so the global windows here are over K rows."""
    w_all = Window.partitionBy()
    df = counts.withColumn("__tot", total).withColumn("__sum", F.sum(weight).over(w_all))
    # exact integer arithmetic (decimal(38,0): n_total * n_class overflows a long at scale)
    prod = F.col("__tot").cast("decimal(38,0)") * F.col(weight).cast("decimal(38,0)")
    den = F.col("__sum").cast("decimal(38,0)")
    df = df.withColumn("__f", F.when(den > 0, (prod - F.pmod(prod, den)) / den)
                       .otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("__r", F.when(den > 0, F.pmod(prod, den)).otherwise(F.lit(0)))
    df = df.withColumn("__extra", F.col("__tot") - F.sum("__f").over(w_all))
    df = df.withColumn("__rr", F.row_number().over(Window.orderBy(F.desc("__r"), F.col(label))))
    df = df.withColumn(out, F.col("__f") + F.when(F.col("__rr") <= F.col("__extra"), 1).otherwise(0))
    return df.drop("__tot", "__sum", "__f", "__r", "__extra", "__rr")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))


def _counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n_c"] for r in class_counts(df, label).collect()}


def by_ranks(df: DataFrame, groups: Sequence[str], order: Sequence[str], cuts: dict[tuple, list[int]],
             labels: Sequence[str | int], out: str = "part") -> DataFrame:
    """Labels rows by their rank inside a group: ``labels[i]`` up to the i-th cumulative
    upper rank of ``cuts[group]``, the last label for the rest.  The rank is not computed:
    rows are compared with the group's rows at those ranks."""
    groups, order = list(groups), list(order)
    asked = [Rank((g, i), r, g) for g, ranks in cuts.items() for i, r in enumerate(ranks[: len(labels) - 1])]
    rows = rows_at(df, order, asked, groups)
    kinds = {c: df.schema[c].dataType for c in [*groups, *order]}
    n = len(labels) - 1

    def row(g, i):
        found = rows.get((g, i))
        return [found is not None, *(found or [None] * len(order))]

    names = [[f"__has{i}", *[f"__c{i}_{c}" for c in order]] for i in range(n)]
    if groups:
        schema = T.StructType([T.StructField(c, kinds[c]) for c in groups] + [
            f for i in range(n) for f in (T.StructField(names[i][0], T.BooleanType()), *[
                T.StructField(a, kinds[c]) for a, c in zip(names[i][1:], order)])])
        table = df.sparkSession.createDataFrame([(*g, *[v for i in range(n) for v in row(g, i)]) for g in cuts], schema)
        own = join_null_safe(df, F.broadcast(table) if len(cuts) <= BROADCAST_ROWS else table, groups)
    else:
        own = df.withColumns({a: F.lit(v).cast(kind) for i in range(n) for a, v, kind in zip(
            names[i], row((), i), ["boolean", *[kinds[c] for c in order]])})
    part = F.lit(None)
    for i in range(n):
        here = F.col(names[i][0]) & at_most(order, [F.col(f"`{a}`") for a in names[i][1:]])
        part = F.when(here, F.lit(labels[i])) if i == 0 else part.when(here, F.lit(labels[i]))
    return own.withColumn(out, part.otherwise(F.lit(labels[n]))).select(*df.columns, out)


def random_stratified(df: DataFrame, id_col: str = "sample_id", label: str = "label",
                      seed: int = config.SEED, train_frac: float = config.TRAIN_FRAC,
                      val_frac: float = config.VAL_FRAC) -> DataFrame:
    """Exact-size stratified random split: test = ceil((1-train_frac)·n) shared
    over classes by largest remainder, then val = ceil(val_frac·n_train) likewise;
    inside a class rows are taken in md5(id|seed) order.  Adds ``part``."""
    test_frac = 1.0 - train_frac
    counts = class_counts(df, label)
    counts = _apportion(counts, label, "n_c",
                        F.ceil(F.sum("n_c").over(Window.partitionBy()).cast("double")
                               * F.lit(test_frac)).cast("long"), "q_test")
    counts = counts.withColumn("n_trainall", F.col("n_c") - F.col("q_test"))
    counts = _apportion(counts, label, "n_trainall",
                        F.ceil(F.sum("n_trainall").over(Window.partitionBy()).cast("double")
                               * F.lit(float(val_frac))).cast("long"), "q_val")
    cuts = {(r[label],): [r["q_test"], r["q_test"] + r["q_val"]] for r in counts.collect()}
    keyed = df.withColumn("__key", hash_key(id_col, seed))
    return by_ranks(keyed, [label], ["__key", id_col], cuts, ["test", "val", "train"]).drop("__key")


def _chrono_cuts(n: int, train_frac: float, val_frac: float, min_val: int) -> list[int]:
    """Ranks of the last train and the last val row."""
    split = math.floor(float(n) * train_frac)
    val = max(math.floor(float(split) * val_frac), min_val)
    return [max(split - val, 0), split]


def global_chronological(df: DataFrame, id_col: str = "sample_id", date: str = "date",
                         train_frac: float = config.TRAIN_FRAC,
                         val_frac: float = config.VAL_FRAC) -> DataFrame:
    """First ``int(train_frac·n)`` rows by (date, id) are train+val, the last
    ``int(val_frac·that)`` of them val, the rest test.  Adds ``part``."""
    cuts = {(): _chrono_cuts(df.count(), train_frac, val_frac, 0)}
    return by_ranks(df, [], [date, id_col], cuts, ["train", "val", "test"])


def global_boundary(df: DataFrame, date: str = "date", train_frac: float = config.TRAIN_FRAC,
                    val_frac: float = config.VAL_FRAC) -> DataFrame:
    """Split facts: date of the first test row (null if that row has none, since undated
    rows come last: then no dated row is tested), part sizes."""
    n = df.count()
    train, split = _chrono_cuts(n, train_frac, val_frac, 0)
    row = rows_at(df, [date], [Rank("first", split + 1)]).get("first", (None,))
    schema = T.StructType([T.StructField("boundary_date", df.schema[date].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_train", "n_val", "n_test")]])
    return df.sparkSession.createDataFrame([(row[0], train, split - train, n - split)], schema)


def per_class_chronological(df: DataFrame, id_col: str = "sample_id", label: str = "label",
                            date: str = "date", train_frac: float = config.TRAIN_FRAC,
                            val_frac: float = config.VAL_FRAC) -> DataFrame:
    """Chronological split inside every class; ``val = max(1, int(val_frac·
    train_all))``.  Adds ``part``."""
    cuts = {(c,): _chrono_cuts(n, train_frac, val_frac, 1) for c, n in _counts(df, label).items()}
    return by_ranks(df, [label], [date, id_col], cuts, ["train", "val", "test"])


def class_list(df: DataFrame, label: str) -> list[str]:
    """Sorted distinct classes (driver side, one value a class)."""
    return sorted(c for c in _counts(df, label) if c is not None)


def heldout_cuts(df: DataFrame, id_col: str = "sample_id", label: str = "label", date: str = "date",
                 train_frac: float = config.TRAIN_FRAC, val_frac: float = config.VAL_FRAC,
                 min_unknown: int = config.MIN_UNKNOWN, classes: list[str] | None = None) -> list[dict]:
    """Facts of the open-set splits, one per held-out class h: ``heldout``, the last
    train row and the last val row as (date, id) (None: no such row), the date of the
    first known test row, and part sizes.  Ranks among the rows that are not h are ranks
    among all rows less those of h, so one histogram serves all classes.  Classes with
    fewer than ``min_unknown`` rows dated on or after their boundary are left out."""
    counts = _counts(df, label)
    n = sum(counts.values())
    names = [c for c in (classes if classes is not None else sorted(k for k in counts if k is not None))]
    ranks = {h: _chrono_cuts(n - counts.get(h, 0), train_frac, val_frac, 1) for h in names}
    asked = [Rank((h, k), r, (h,), True) for h, (train, split) in ranks.items()
             for k, r in (("train", train), ("split", split), ("first", split + 1))]
    rows = rows_at(df, [date, id_col], asked, [label])
    first = {h: rows.get((h, "first"), (None,))[0] for h in names}
    dated = [(h, d) for h, d in first.items() if d is not None]
    unknown: dict = {}
    if dated:
        table = df.sparkSession.createDataFrame(dated, T.StructType([
            T.StructField(label, df.schema[label].dataType), T.StructField("__first", df.schema[date].dataType)]))
        table = F.broadcast(table) if len(dated) <= BROADCAST_ROWS else table
        unknown = _counts(df.select(label, date).join(table, label).where(F.col(date) >= F.col("__first")), label)
    out = []
    for h, (train, split) in ranks.items():
        if unknown.get(h, 0) >= min_unknown:
            out.append({"heldout": h, "train": rows.get((h, "train")), "split": rows.get((h, "split")),
                        "boundary_date": first[h], "n_train": train, "n_val": split - train,
                        "n_known_test": n - counts.get(h, 0) - split, "n_unknown_test": unknown.get(h, 0)})
    return out


def aligned_parts(df: DataFrame, cuts: list[dict], id_col: str = "sample_id", label: str = "label",
                  date: str = "date") -> Column:
    """Array of ``(heldout, part)`` of a row, one entry a cut: its part in the split of that
    held-out class, null for rows of the class before its boundary.  Rows without a class
    are known in every split."""
    kinds = [df.schema[date].dataType, df.schema[id_col].dataType]

    def upto(row):
        if row is None:
            return F.lit(False)
        return at_most([date, id_col], [F.lit(v).cast(k) for v, k in zip(row, kinds)])

    def part(c):
        own = F.col(label).eqNullSafe(F.lit(c["heldout"]))
        late = F.col(date) >= F.lit(c["boundary_date"]).cast(kinds[0])
        known = F.when(upto(c["train"]), "train").when(upto(c["split"]), "val").otherwise("known_test")
        name = F.when(own, F.when(late, F.lit("unknown_test"))).otherwise(known)
        return F.struct(F.lit(c["heldout"]).cast(df.schema[label].dataType).alias("heldout"), name.alias("part"))

    return F.array(*[part(c) for c in cuts])


def heldout_parts(df: DataFrame, cuts: list[dict], id_col: str = "sample_id", label: str = "label",
                  date: str = "date") -> Column:
    """``aligned_parts`` without the splits in which the row has no part."""
    return F.filter(aligned_parts(df, cuts, id_col, label, date), lambda x: x["part"].isNotNull())


def heldout_class(df: DataFrame, id_col: str = "sample_id", label: str = "label",
                  date: str = "date", train_frac: float = config.TRAIN_FRAC,
                  val_frac: float = config.VAL_FRAC, min_unknown: int = config.MIN_UNKNOWN,
                  classes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Open-set splits, one per held-out class h: the other classes are split
    chronologically (train / val / known_test); rows of h dated on or after the
    known boundary are ``unknown_test``.  Returns (assignments ``heldout, id, label, date,
    part``, facts); the assignments are written out row by row, without a shuffle."""
    spark = df.sparkSession
    cuts = heldout_cuts(df, id_col, label, date, train_frac, val_frac, min_unknown, classes)
    names = ["n_train", "n_val", "n_known_test", "n_unknown_test"]
    facts = spark.createDataFrame(
        [(c["heldout"], c["boundary_date"], *[c[k] for k in names]) for c in cuts],
        T.StructType([T.StructField("heldout", df.schema[label].dataType),
                      T.StructField("boundary_date", df.schema[date].dataType),
                      *[T.StructField(k, T.LongType()) for k in names]]))
    slim = df.select(id_col, label, date)
    if not cuts:
        return slim.where(F.lit(False)).select("*", F.lit(None).cast(df.schema[label].dataType).alias("heldout"),
                                               F.lit("").alias("part")), facts
    return slim.select("*", F.inline(heldout_parts(slim, cuts, id_col, label, date))), facts


def kfold(df: DataFrame, id_col: str = "sample_id", label: str = "label", k: int = 5) -> DataFrame:
    """Stratified k-fold assignment without shuffling, with the fold sizes of the usual
    library: with all rows sorted by class (classes in the order of their least id), fold i
    takes every k-th row from the i-th on; a class's rows fill its shares in id order."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"), F.min(id_col).alias("first")).collect()
    cuts, start = {}, 0
    for r in sorted(rows, key=lambda r: (r["first"] is None, r["first"])):
        end = start + r["n_c"]
        # places start..end-1 that leave i when divided by k
        shares = [(end - 1 - i) // k - (start - 1 - i) // k for i in range(k)]
        cuts[(r[label],)] = [sum(shares[: i + 1]) for i in range(k - 1)]
        start = end
    return by_ranks(df, [label], [id_col], cuts, list(range(k)), "fold")


def sizes(assigned: DataFrame, split_name: str | Column, part: str = "part") -> DataFrame:
    """Part sizes ``split, part, n``."""
    name = F.lit(split_name) if isinstance(split_name, str) else split_name
    return assigned.groupBy(name.alias("split"), F.col(part).alias("part")).agg(
        F.count(F.lit(1)).alias("n"))


def expected_random_sizes(n: int, train_frac: float = config.TRAIN_FRAC,
                          val_frac: float = config.VAL_FRAC) -> tuple[int, int, int]:
    n_test = math.ceil((1.0 - train_frac) * n)
    n_val = math.ceil(val_frac * (n - n_test))
    return n - n_test - n_val, n_val, n_test
