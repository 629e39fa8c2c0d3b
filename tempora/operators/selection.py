"""Rows at given ranks, from histograms that are refined only around those ranks.

A split, a quantile or a boundary needs the row at a few ranks of an order, not the rank
of every row.  ``rows_at`` finds these rows without sorting the input and without a copy
per class: one pass counts rows by (cell, group), where a cell is a stretch of the order
key; running sums over the cells tell which cell holds a rank; only the rows of those
cells are looked at again, until a cell is small enough (``SMALL``) to be sorted by
one task.  A rank may count the rows of one group, or all rows *but* those of one
group: that is the total count less the group's, so the boundaries of all held-out
classes come from the same histogram.

Ordering columns may be integers, doubles, dates, timestamps, booleans or strings; nulls
sort last, NaN after all numbers.  A cell whose rows share one value of a column goes on
with the next column, so a date that holds a third of all rows is refined by id.

The driver holds one row a rank that is asked for, and ``CELLS`` total counts a cell that
is still open; group counts stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

CELLS, SMALL = 1024, 50_000
_CHUNK = 6  # bytes of a string that one number holds


@dataclass
class Rank:
    """The row of rank ``rank`` (from 1) in the rows of ``group``, or with ``but`` in all
    other rows; ``group`` is a tuple of the group columns' values (nulls are values)."""

    name: object
    rank: int
    group: tuple = ()
    but: bool = False


@dataclass
class _Cell:
    """A stretch of the order: column ``dim`` between ``lo`` and ``hi``; ranks asked in it
    are counted from its first row."""

    key: int
    dim: int
    lo: float | int | None
    hi: float | int | None
    asked: list[Rank] = field(default_factory=list)


def _dims(schema: T.StructType, order: Sequence[str]):
    """Numbers that sort like the order columns: functions of a place, None at the end."""
    out = []
    for name in order:
        kind, col = schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            out.append(("text", name))
        elif isinstance(kind, T.DateType):
            out.append(("long", F.unix_date(col).cast("long")))
        elif isinstance(kind, T.TimestampType):
            out.append(("long", F.unix_micros(col)))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            x = col.cast("double")
            edge = F.when(F.isnan(x), 2).when(F.abs(x) == float("inf"), F.signum(x)).otherwise(0).cast("long")
            out.append(("long", F.when(x.isNotNull(), edge)))  # infinities and NaN apart
            out.append(("double", F.when(x.isNotNull(), F.when(edge == 0, x).otherwise(0.0))))
        else:
            out.append(("long", col.cast("long")))

    def dim(k: int):
        for kind, col in out:
            if kind != "text":
                if not k:
                    return kind, col
                k -= 1
                continue
            if k < 24:  # 144 bytes; equal beginnings beyond are sorted in the last step
                part = F.substring(F.encode(F.col(f"`{col}`"), "UTF-8"), k * _CHUNK + 1, _CHUNK)
                return "long", F.conv(F.rpad(F.hex(part), 2 * _CHUNK, "0"), 16, 10).cast("long")
            k -= 24
        return None
    return dim


def _bucket(kind: str, x: Column, lo: Column, hi: Column, wide: bool) -> Column:
    """A non-decreasing number from 0 to CELLS - 1 of values from lo to hi; CELLS: null.
    ``wide``: differences are out of range, so values are shifted first."""
    if wide:
        x, lo, hi = ((F.shiftright(c, 2) if kind == "long" else c / 4) for c in (x, lo, hi))
    share = (x - lo).cast("double") / F.when(hi > lo, (hi - lo).cast("double")).otherwise(1.0) * CELLS
    return F.when(x.isNull(), F.lit(CELLS)).otherwise(
        F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(CELLS - 1))).cast("int")


def _same(a: pd.DataFrame, group: tuple) -> np.ndarray:
    """Rows of ``a`` (its group columns are g0, g1, ...) in ``group``."""
    ok = np.ones(len(a), bool)
    for k, v in enumerate(group):
        col = a[f"g{k}"]
        ok &= (col.isna() if v is None else (col == v)).to_numpy(bool, na_value=False)
    return ok


def rows_at(df: DataFrame, order: Sequence[str], asked: Sequence[Rank], groups: Sequence[str] = (),
            written: bool = False) -> dict:
    """``{name: row}``: for each rank its row as a tuple of the ``order`` columns' values;
    ranks beyond the rows have none.  ``order`` must be total (end in an id).  The group
    and order columns are written once, and the passes read them, unless ``df`` is
    ``written`` already."""
    spark = df.sparkSession
    found: dict = {}
    asked = [r for r in asked if r.rank >= 1]
    if not asked:
        return found
    order, groups = list(order), list(groups)
    own = df.select(*[F.col(c).alias(f"g{k}") for k, c in enumerate(groups)], *[F.col(f"`{c}`").alias(f"o{k}")
                                                                               for k, c in enumerate(order)])
    own = own if written else cut_lineage(own)
    names = [f"o{k}" for k in range(len(order))]
    keys = [f"g{k}" for k in range(len(groups))]
    dim = _dims(own.schema, names)
    first = [dim(k)[1] for k in (0, 1) if dim(k) is not None]
    ends = own.agg(F.count(F.lit(1)).alias("n"), F.count(first[0]).alias("some"), *[
        f(x).alias(f"{w}{k}") for k, x in enumerate(first) for w, f in (("lo", F.min), ("hi", F.max))]).first()
    # a column with one value parts nothing
    d = int(len(first) > 1 and ends["some"] == ends["n"] and ends["lo0"] == ends["hi0"])
    open_cells = [_Cell(0, d, ends[f"lo{d}"], ends[f"hi{d}"], asked)]
    rows = own.withColumn("cell", F.lit(0))
    small = {0: open_cells[0]} if ends["n"] <= SMALL else {}
    open_cells = [] if small else open_cells
    done: list[DataFrame] = [rows] if small else []
    while open_cells:
        used = 1 + max(c.key for c in [*open_cells, *small.values()])
        rows, open_cells, ready = _refine(rows, open_cells, dim, keys, used)
        if ready:
            held = F.array(*[F.lit(c.key) for c in ready])
            done.append(rows.where(F.array_contains(held, F.col("cell"))))
            small |= {c.key: c for c in ready}
        if open_cells:
            held = F.array(*[F.lit(c.key) for c in open_cells])
            rows = cut_lineage(rows.where(F.array_contains(held, F.col("cell"))))
    if not small:
        return found
    picked = reduce(DataFrame.unionByName, [d.select("cell", *keys, *names) for d in done])
    cells = {k: c.asked for k, c in small.items()}

    # a small cell is numbered by one task
    w = Window.partitionBy("cell").orderBy(*[F.col(c).asc_nulls_last() for c in names])
    numbered = cut_lineage(picked.withColumn("rk", F.row_number().over(w)))

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        at, out = [], []
        for k, r in enumerate(cells[int(key[0])]):
            ok = _same(pdf, r.group) if r.group else np.ones(len(pdf), bool)
            places = np.flatnonzero(~ok if r.but else ok)
            if r.rank <= len(places):
                at.append(int(pdf["rk"].iloc[places[r.rank - 1]]))
                out.append(k)
        return pd.DataFrame({"cell": np.full(len(at), int(key[0]), np.int32), "k": np.array(out, np.int32),
                             "rk": np.array(at, np.int32)})

    hits = numbered.select("cell", "rk", *keys).groupBy("cell").applyInPandas(pick, "cell int, k int, rk int")
    for r in numbered.join(hits, ["cell", "rk"]).collect():  # one row a rank
        found[cells[r["cell"]][r["k"]].name] = tuple(r[c] for c in names)
    return found


def _refine(rows: DataFrame, cells: list[_Cell], dim, keys: list[str], used: int):
    """One pass: counts of all sub-cells of ``cells``; returns the rows with their new
    cells, the cells that stay open and those that are small."""
    spark = rows.sparkSession
    sub = None
    for k in sorted({c.dim for c in cells}):  # usually one column at a time
        kind, x = dim(k)
        own = {c.key: c for c in cells if c.dim == k}

        def bound(which, own=own, kind=kind):
            return F.element_at(F.create_map(*[v for c in own.values() for v in (
                F.lit(c.key), F.lit(getattr(c, which)).cast(kind))]), F.col("cell"))

        here = F.array_contains(F.array(*[F.lit(c) for c in own]), F.col("cell"))
        widest = max((float(c.hi) / 4 - float(c.lo) / 4 for c in own.values() if c.lo is not None), default=0.0)
        at = _bucket(kind, x, bound("lo"), bound("hi"), widest >= (2.0**60 if kind == "long" else 1e307))
        sub = F.when(here, at) if sub is None else sub.when(here, at)
    tagged = rows.withColumn("sub", sub)
    after = sorted({k for c in cells for k in (c.dim, c.dim + 1) if dim(k) is not None})
    sizes = tagged.groupBy("cell", "sub", *keys).agg(
        F.count(F.lit(1)).alias("n"), *[f(dim(k)[1]).alias(f"{w}{k}") for k in after for w, f in (("lo", F.min), ("hi", F.max))])
    sizes = cut_lineage(sizes)
    total = sizes.groupBy("cell", "sub").agg(
        F.sum("n").alias("n"), *[f(f"{w}{k}").alias(f"{w}{k}") for k in after for w, f in (("lo", F.min), ("hi", F.max))]) \
        .orderBy("cell", "sub").toPandas()  # at most CELLS + 1 a cell
    counts = {key: (t["sub"].to_numpy(), t["n"].to_numpy()) for key, t in total.groupby("cell")}
    of = {c.key: c for c in cells}

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The ranks asked of one group, in the cell of ``pdf``."""
        return _places(pdf, of[int(key[0])].asked, *counts[int(key[0])])

    plain = [(c, k, r) for c in cells for k, r in enumerate(c.asked) if not r.group and not r.but]
    hits = []
    for c, k, r in plain:
        subs, n = counts[c.key]
        ends = np.cumsum(n)
        i = int(np.searchsorted(ends, r.rank))
        if i < len(ends):
            hits.append((c.key, k, int(subs[i]), int(ends[i] - n[i])))
    if len(plain) < sum(len(c.asked) for c in cells):
        wanted = spark.createDataFrame(
            sorted({(c.key, *r.group) for c in cells for r in c.asked if r.group}, key=str),
            T.StructType([T.StructField("wc", T.IntegerType()), *[T.StructField(f"w{k}", sizes.schema[k].dataType)
                                                                  for k in keys]]))
        on = (F.col("cell") == F.col("wc")) & reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"w{k}")) for k in keys])
        # a group without rows in the cell still has ranks among the others
        own = wanted.join(sizes.select("cell", "sub", *keys, "n"), on, "left").select(
            F.col("wc").alias("cell"), *[F.col(f"w{k}").alias(k) for k in keys], "sub", "n")
        hits += [tuple(r) for r in own.groupBy("cell", *keys).applyInPandas(
            place, "cell int, k int, sub int, before long").collect()]
    at = {(int(c), int(s)): t for (c, s), t in total.set_index(["cell", "sub"]).to_dict("index").items()}
    new: dict[tuple[int, int], _Cell] = {}
    for key, k, s, before in hits:
        r, old = of[key].asked[k], of[key]
        if (key, s) not in new:
            facts, d = at[(key, s)], old.dim
            if s == CELLS or facts[f"lo{d}"] == facts[f"hi{d}"]:  # one value: on with the next column
                d += 1
            lo, hi = (facts.get(f"{w}{d}") for w in ("lo", "hi"))
            lo, hi = (None if v is None or pd.isna(v) else v for v in (lo, hi))
            if dim(d) is not None and dim(d)[0] == "long":
                lo, hi = (None if v is None else int(v) for v in (lo, hi))
            new[(key, s)] = _Cell(0, d, lo, hi)
        new[(key, s)].asked.append(Rank(r.name, r.rank - before, r.group, r.but))
    for i, c in enumerate(new.values()):
        c.key = used + i
    ready = [c for (key, s), c in new.items() if at[(key, s)]["n"] <= SMALL or dim(c.dim) is None]
    names = F.create_map(*[v for (key, s), c in new.items() for v in (F.lit(key * (CELLS + 1) + s), F.lit(c.key))]) \
        if new else None
    moved = tagged.where(F.lit(False)) if names is None else tagged.withColumn(
        "cell", F.element_at(names, F.col("cell") * (CELLS + 1) + F.col("sub"))).where("cell is not null")
    return moved.drop("sub"), [c for c in new.values() if c not in ready], ready


def _places(pdf: pd.DataFrame, asked: list[Rank], subs: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    out = []
    own = np.zeros(len(subs), np.int64)
    some = pdf.dropna(subset=["sub"])
    own[np.searchsorted(subs, some["sub"].to_numpy())] = some["n"].to_numpy()
    for k, r in enumerate(asked):
        if r.group and _same(pdf.iloc[:1], r.group).all():
            count = n - own if r.but else own
            ends = np.cumsum(count)
            i = int(np.searchsorted(ends, r.rank))
            if i < len(ends):
                out.append((int(pdf["cell"].iloc[0]), k, int(subs[i]), int(ends[i] - count[i])))
    return pd.DataFrame(out, columns=["cell", "k", "sub", "before"])


def at_most(order: Sequence[str], row: Sequence[Column]) -> Column:
    """Whether a row's ``order`` columns sort at or before ``row`` (nulls last)."""
    out = F.lit(True)
    for name, v in zip(reversed(list(order)), reversed(list(row))):
        x = F.col(f"`{name}`") if isinstance(name, str) else name
        before = (x.isNotNull() & v.isNull()) | F.coalesce(x < v, F.lit(False))
        out = before | (x.eqNullSafe(v) & out)
    return out
