"""Splits by selected rows: undated rows, null classes, many classes, fold sizes."""

import datetime
import math
import random

import pytest

from tempora.operators import metrics, selection, splits

DAY = datetime.date(2020, 1, 1)


def table(spark, n=400, classes=("hot", "hot", "hot", "a", "b", None), seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(classes), None if r.random() < 0.2 else DAY + datetime.timedelta(days=r.randint(0, 40)))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id long, label string, date date")


def place(row):
    return row[2] is None, row[2] or DAY, row[0]


def chrono(rows, min_val):
    rows = sorted(rows, key=place)
    split = math.floor(len(rows) * 0.8)
    train = max(split - max(math.floor(split * 0.1), min_val), 0)
    return rows, train, split


@pytest.mark.parametrize("small", [50_000, 20])
def test_heldout_equals_plain_splits(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "CELLS", 16)
    rows, df = table(spark)
    parts, facts = splits.heldout_class(df, min_unknown=1)
    got = {(p.heldout, p.sample_id): p.part for p in parts.collect()}
    want, bounds = {}, {}
    for h in ("a", "b", "hot"):
        known, train, split = chrono([r for r in rows if r[1] != h], 1)
        want |= {(h, r[0]): "train" if i < train else "val" if i < split else "known_test" for i, r in enumerate(known)}
        first = known[split][2]
        unknown = [r[0] for r in rows if r[1] == h and r[2] is not None and first is not None and r[2] >= first]
        if not unknown:
            want = {k: v for k, v in want.items() if k[0] != h}
            continue
        want |= {(h, i): "unknown_test" for i in unknown}
        bounds[h] = (first, train, split - train, len(known) - split, len(unknown))
    assert got == want
    assert {f.heldout: tuple(f)[1:] for f in facts.collect()} == bounds


def test_boundary_agrees_with_parts_on_undated_rows(spark):
    rows = [(i, "a", None if i % 5 == 0 else DAY + datetime.timedelta(days=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id long, label string, date date")
    assert tuple(splits.global_boundary(df).first()) == (None, 72, 8, 20)
    some = spark.createDataFrame(rows[:50] + [(i + 100, "a", DAY) for i in range(50)], df.schema)
    order, train, split = chrono([tuple(r) for r in some.collect()], 0)
    assert tuple(splits.global_boundary(some).first()) == (order[split][2], train, split - train, 100 - split)
    parts = splits.global_chronological(some)
    assert parts.where("part = 'test'").agg({"date": "min"}).first()[0] == order[split][2]


def test_many_classes_and_no_rows(spark):
    rows, df = table(spark, 500, [f"c{i}" for i in range(120)])
    out = splits.per_class_chronological(df)
    got = {r.sample_id: r.part for r in out.collect()}
    for c in {r[1] for r in rows}:
        own, train, split = chrono([r for r in rows if r[1] == c], 1)
        assert [got[r[0]] for r in own] == ["train"] * train + ["val"] * (split - train) + ["test"] * (len(own) - split)
    assert splits.per_class_chronological(df.limit(0)).count() == 0
    assert splits.global_chronological(df.limit(0)).count() == 0
    parts, facts = splits.heldout_class(df.limit(0))
    assert parts.count() == 0 and facts.count() == 0


def test_kfold_sizes_by_hand(spark):
    # sorted by class a a a a a a a b b b b: every third row from row i on goes to fold i
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(11)], "sample_id long, label string")
    got = {r.sample_id: r.fold for r in splits.kfold(df, k=3).collect()}
    assert [got[i] for i in range(11)] == [0, 0, 0, 1, 1, 2, 2, 0, 1, 1, 2]


def test_quantiles_equal_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(selection, "SMALL", 30)
    monkeypatch.setattr(selection, "CELLS", 32)
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.8 else "b", r.choice([None, r.gauss(0, 1), 0.0, r.gauss(5, 1e6)])) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("none", None)], "g string, x double")
    for q in (0.0, 0.05, 0.5, 1.0):
        got = {x.g: x.quantile for x in metrics.exact_quantile(df, "x", q, ["g"]).collect()}
        want = {g: np.quantile([x for k, x in rows if k == g and x is not None], q) for g in ("hot", "b")}
        assert got == pytest.approx(want)
    assert metrics.exact_quantile(df.limit(0), "x", 0.5).first()[0] is None
