"""Rows at ranks against sorted lists, at every size of cells."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import selection
from tempora.operators.selection import Rank

SCHEMA = "label string, date date, at timestamp, x double, name string, id long"


def table(seed, n=300):
    r = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    rows = []
    for i in range(n):
        d = None if r.random() < 0.1 else day + datetime.timedelta(days=r.choice([0, 0, 0, 1, 5, 400, r.randint(-900, 900)]))
        at = None if d is None else datetime.datetime(d.year, d.month, d.day, r.randint(0, 23))
        x = r.choice([None, float("nan"), math.inf, -math.inf, 0.0, 0.5, r.gauss(0, 1), r.gauss(0, 1e9), 1e-300 * r.random()])
        name = r.choice([None, "", "é", "same begin ", "a"])
        rows.append((r.choice(["hot", "hot", "hot", "a", "b", None]), d, at, x,
                     None if name is None else name * r.randint(1, 2) + str(r.randint(0, 3)), r.choice([-1, 1]) * i * 10**15))
    return rows


def key(row, order):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = []
    for c in order:
        v = row[names.index(c)]
        nan = isinstance(v, float) and math.isnan(v)
        out.append((2, 0) if v is None else (1, 0) if nan else (0, v.encode() if isinstance(v, str) else v))
    return out


@pytest.mark.parametrize("cells,small,order", [
    (1024, 50_000, ["x", "id"]), (64, 40, ["date", "id"]), (64, 40, ["at", "id"]), (32, 40, ["x", "id"]),
    (64, 60, ["name", "id"]), (16, 1, ["id"])])
def test_rows_equal_sorted_lists(spark, monkeypatch, cells, small, order):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "SMALL", small)
    rows = table(len(order) + cells)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked, want = [], {}
    for label in ("hot", "a", None, "absent"):
        for but in (False, True):
            own = sorted((r for r in rows if (r[0] != label if but else r[0] == label)), key=lambda r: key(r, order))
            for rank in {1, 2, len(own) // 3, len(own) - 1, len(own), len(own) + 1}:
                asked.append(Rank((label, but, rank), rank, (label,), but))
                if 1 <= rank <= len(own):
                    want[(label, but, rank)] = own[rank - 1][5]
    got = selection.rows_at(df, order, asked, ["label"])
    assert {k: v[-1] for k, v in got.items()} == want


def test_ranks_of_all_rows_and_comparison(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 10)
    rows = table(9)
    df = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda r: key(r, ["date", "id"]))
    got = selection.rows_at(df, ["date", "id"], [Rank("a", 100), Rank("b", 290), Rank("none", 301), Rank("zero", 0)])
    assert set(got) == {"a", "b"}
    for name, n in (("a", 100), ("b", 290)):
        assert got[name] == (order[n - 1][1], order[n - 1][5])
        cut = [F.lit(got[name][0]).cast("date"), F.lit(got[name][1])]
        assert df.where(selection.at_most(["date", "id"], cut)).count() == n
    assert selection.rows_at(df.limit(0), ["date", "id"], [Rank("a", 1)]) == {}
