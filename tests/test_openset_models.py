"""Open-set models from running sums against models fitted one by one."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import metrics, openset_models, splits

DAY = datetime.date(2020, 1, 1)


def table(spark, n=160, dims=3, seed=5, classes=("hot", "hot", "hot", "a", "b", None), undated=0.1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [float(r.randint(0, 6)) for _ in range(dims)] if r.random() > 0.05 else r.choice([None, [0.0] * dims])
        rows.append((i, r.choice(classes), None if r.random() < undated else DAY + datetime.timedelta(days=r.randint(0, 40)), vec))
    return rows, spark.createDataFrame(rows, "sample_id long, label string, date date, vec array<double>")


def brute(rows, cuts, kind, dims):
    place = lambda d, i: (d is None, d or DAY, i)
    out = {}
    for c in cuts:
        h, train, split = c["heldout"], place(*c["train"]), place(*c["split"])
        fit, judged = {}, []
        for i, label, date, vec in rows:
            at = place(date, i)
            if label == h:
                if date is not None and date >= c["boundary_date"]:
                    judged.append((i, vec, "unknown_test"))
            elif at <= train:
                if label is not None and vec is not None:
                    fit.setdefault(label, []).append(vec)
            else:
                judged.append((i, vec, "val" if at <= split else "known_test"))
        known = sorted(fit)
        for i, vec, part in judged:
            x = np.array(vec if vec is not None else [0.0] * dims)
            z = []
            for k in known:
                m = np.array(fit[k])
                if kind == "centroid":
                    mean = m.mean(axis=0)
                    both = np.linalg.norm(mean) * np.linalg.norm(x)
                    z.append(10 * mean @ x / both if both else 0.0)
                else:
                    s = m.sum(axis=0)
                    z.append(x @ np.log((s + 1) / (s.sum() + dims)))
            p = np.exp(np.array(z) - max(z))
            p /= p.sum()
            top = sorted(p, reverse=True)
            out[h, i, part] = (known[int(p.argmax())], top[0], top[0] - (top[1] if len(top) > 1 else 0.0))
    return out


@pytest.mark.parametrize("kind", openset_models.KINDS)
@pytest.mark.parametrize("block", [4_000_000, 1])
def test_equals_models_fitted_one_by_one(spark, monkeypatch, kind, block):
    monkeypatch.setattr(openset_models, "BLOCK_CELLS", block)  # 1: a scan for each model
    rows, df = table(spark)
    cuts = splits.heldout_cuts(df.drop("vec"), min_unknown=1)
    assert len(cuts) == 3
    got = {}
    for r in openset_models.score(df, cuts, "vec", kind).collect():
        got.setdefault((r.heldout, r.sample_id, r.part), {})[r.method] = (r.y_pred, r.score)
    want = brute(rows, cuts, kind, 3)
    assert set(got) == set(want)
    for key, (pred, best, margin) in want.items():
        assert math.isclose(got[key]["max_prob"][1], best, abs_tol=1e-9)
        assert math.isclose(got[key]["margin"][1], margin, abs_tol=1e-9)
        if margin > 1e-9:
            assert got[key]["max_prob"][0] == got[key]["margin"][0] == pred


def test_no_cuts_one_class_and_empty(spark):
    _, df = table(spark, classes=("a",), undated=0.0)
    assert openset_models.score(df, [], "vec").count() == 0
    assert splits.heldout_cuts(df.drop("vec"), min_unknown=1) == []
    _, two = table(spark, classes=("a", "b"), undated=0.0)
    cuts = splits.heldout_cuts(two.drop("vec"), min_unknown=1)
    out = openset_models.score(two, cuts, "vec")  # one known class: sure of it
    assert out.where("score <> 1 or y_pred = heldout").count() == 0 and out.count() > 0
    assert openset_models.score(df.limit(0), splits.heldout_cuts(df.limit(0).drop("vec")), "vec").count() == 0
    with pytest.raises(ValueError):
        openset_models.score(two, cuts, "vec", "trees").count()


def test_ranking_summary_equals_the_single_metrics(spark):
    r = random.Random(3)
    rows = [(g, r.random() < 0.4, float(r.randint(0, 9))) for g in ("x", "y") for _ in range(200)]
    rows += [("only", True, 1.0), ("only", True, 2.0)]
    df = spark.createDataFrame(rows, "g string, label boolean, score double") \
        .withColumn("label", F.col("label").cast("int"))
    both = {t.g: (t.auroc, t.average_precision) for t in metrics.ranking_summary(df, by=["g"]).collect()}
    one = {t.g: t.auroc for t in metrics.auroc(df, by=["g"]).collect()}
    two = {t.g: t.average_precision for t in metrics.average_precision(df, by=["g"]).collect()}
    assert both["only"] == (None, None) == (one["only"], two["only"])
    for g in ("x", "y"):
        assert math.isclose(both[g][0], one[g], abs_tol=1e-12) and math.isclose(both[g][1], two[g], abs_tol=1e-12)
