"""Distributed multinomial draws: published intervals, exact totals, distribution, splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import resample
from tests.test_goldens import CLASSES, confusion_cells

PUBLISHED = {"baseline_random_api_hash_sgd": (0.8635, 0.8805), "table_5_11_fusion_global_sgd": (0.9257, 0.9376),
             "table_5_12_fusion_per_family_sgd": (0.9563, 0.9651), "table_5_8": (0.8801, 0.9306),
             "table_6_1_fusion_global_lightgbm": (0.9054, 0.9183)}


def test_published_intervals(spark):
    rep = resample.bootstrap_report(confusion_cells(spark), CLASSES).collect()
    macro = {r.run: r for r in rep if r["class"] == "__macro__"}
    assert set(macro) == set(PUBLISHED) and len(rep) == 5 * 11
    for run, (lo, hi) in PUBLISHED.items():
        assert abs(macro[run].f1_ci_lo - lo) < 1e-3 and abs(macro[run].f1_ci_hi - hi) < 1e-3, run
        assert macro[run].precision_point is None
    assert macro["table_5_8"].support == 9796 and abs(macro["table_5_8"].f1_point - 0.9024446384) < 1e-9
    for r in rep:
        if r["class"] != "__macro__":
            for m in ("precision", "recall", "f1"):
                lo, at, hi = r[f"{m}_ci_lo"], r[f"{m}_point"], r[f"{m}_ci_hi"]
                assert lo <= at + 1e-12 and at <= hi + 1e-12 and abs(r[f"{m}_ci_width"] - (hi - lo)) < 1e-12


@pytest.mark.parametrize("leaf", [2_000, 2])
def test_draws_are_multinomial(spark, monkeypatch, leaf):
    monkeypatch.setattr(resample, "LEAF", leaf)  # 2: every draw goes down a tree
    monkeypatch.setattr(resample, "GROUP", 1)
    counts = {("r", c): n for c, n in zip("abcdefghijkl", [900, 1, 5, 40, 0, 60, 300, 2, 8, 10, 74, 100])} | {("q", "a"): 7}
    cells = spark.createDataFrame([(r, c, n) for (r, c), n in counts.items()], "root string, key string, n long")
    got = resample.cell_draws(cells, ["root"], ["key"], {"k": ["key"]}, ["root"], b=2000).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, {}).setdefault(r["class"], {})[r.replicate] = r.k
    assert set(by["q"]) == {"a"} and set(by["q"]["a"].values()) == {7} and len(by["q"]["a"]) == 2000
    names = sorted(by["r"])
    draws = np.array([[by["r"][c][i] for c in names] for i in range(2000)])
    assert (draws.sum(axis=1) == 1500).all()
    p = np.array([counts["r", c] for c in names]) / 1500
    assert (np.abs(draws.mean(axis=0) - 1500 * p) <= 5 * np.sqrt(1500 * p * (1 - p) / 2000) + 1e-9).all()
    want = 1500 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(draws.T) - want).max() < 0.15 * want.max()
    again = resample.cell_draws(cells.repartition(5), ["root"], ["key"], {"k": ["key"]}, ["root"], b=2000, partitions=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    few = resample.cell_draws(cells, ["root"], ["key"], {"k": ["key"]}, ["root"], b=150).collect()
    assert max(r.replicate for r in few) == 149


@pytest.mark.parametrize("leaf", [2_000, 3])
def test_paired_bootstrap_equals_resampled_rows(spark, monkeypatch, leaf):
    monkeypatch.setattr(resample, "LEAF", leaf)
    r = random.Random(4)
    rows = [(t, t if r.random() < 0.8 else r.choice("abc"), (t if r.random() < 0.7 else r.choice("abcd")) if i % 50 else None)
            for i, t in enumerate(r.choices("abc", weights=(8, 3, 1), k=400))]
    df = spark.createDataFrame(rows, "y_true string, pred_a string, pred_b string")
    boot = resample.paired_bootstrap(df, b=3000)
    got = resample.paired_report(boot).first()

    def macro(t, p):
        f = []
        for c in set(t) | (set(p) - {None}):
            tp, n = sum(x == y == c for x, y in zip(t, p)), sum(x == c for x in t) + sum(y == c for y in p)
            f.append(2 * tp / n)
        return sum(f) / len(f)

    rng = np.random.default_rng(0)
    a, b = [], []
    for _ in range(1500):
        own = [rows[i] for i in rng.integers(0, len(rows), len(rows))]
        a.append(macro([x[0] for x in own], [x[1] for x in own]))
        b.append(macro([x[0] for x in own], [x[2] for x in own]))
    d = np.array(a) - np.array(b)
    assert got.b == 3000
    assert abs(got.mean_macro_f1_a - np.mean(a)) < 0.004 and abs(got.mean_macro_f1_b - np.mean(b)) < 0.006
    assert abs(got.delta_ci_lo - np.percentile(d, 2.5)) < 0.015 and abs(got.delta_ci_hi - np.percentile(d, 97.5)) < 0.015
    whole = resample.paired_comparison(df, b=200).first()
    assert abs(whole.point_macro_f1_a - macro([x[0] for x in rows], [x[1] for x in rows])) < 1e-12
    assert abs(whole.point_delta - (whole.point_macro_f1_a - whole.point_macro_f1_b)) < 1e-12
    assert whole.mcnemar_n_discordant == whole.mcnemar_b + whole.mcnemar_c


def test_absent_classes_nulls_and_empty(spark):
    cells = spark.createDataFrame([("x", "a", "a", 5), ("x", "a", None, 3), ("x", None, "a", 2), ("x", "a", "z", 4)],
                                  "run string, y_true string, y_pred string, n long")
    rep = {r["class"]: r for r in resample.bootstrap_report(cells, ["a", "b"], b=50).collect()}
    assert rep["a"].f1_point == rep["a"].f1_ci_lo == 1.0 and rep["a"].support == 5
    assert rep["b"].f1_point == rep["b"].f1_ci_hi == 0.0 and rep["__macro__"].f1_ci_hi == 0.5
    assert resample.bootstrap_report(cells.where(F.lit(False)), ["a"], b=50).count() == 0
    none = spark.createDataFrame([], "y_true string, pred_a string, pred_b string")
    assert resample.paired_bootstrap(none, b=50).count() == 0
