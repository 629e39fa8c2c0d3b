"""Published values of the evaluated study reproduced from their inputs."""

import io
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import metrics, monitor, openset, resample, splits

WF = """boundary,test_end,n_train,n_test,families_present,api_macro_f1,trailing_mean,trigger_reason,retrain_recommended
2018-06-01,2018-07-01,8753,1519,8,0.8155361381752463,,,False
2018-07-01,2018-07-31,10272,1223,9,0.8144446008945307,,,False
2018-07-31,2018-08-30,11495,1174,8,0.8240866260825213,,,False
2018-08-30,2018-09-29,12669,1605,9,0.6696110307050376,0.8180224550507661,floor+trailing_mean_drop,True
2018-09-29,2018-10-29,14274,1701,10,0.8744731369514133,0.7693807525606965,,False
2018-10-29,2018-11-28,15975,1752,10,0.9289462099308315,0.7893902645796573,,False
2018-11-28,2018-12-28,17727,2169,10,0.8840294995865138,0.8243434591957608,,False
2018-12-28,2019-01-27,19896,2414,10,0.891557148838652,0.8958162821562529,,False
2019-01-27,2019-02-26,22310,2449,10,0.9113618689745016,0.9015109527853324,,False
2019-02-26,2019-03-28,24759,3000,10,0.6919521584108598,0.8956495057998891,floor+trailing_mean_drop,True
2019-03-28,2019-04-27,27759,2810,10,0.7323249411366086,0.8316237254080044,floor,False
2019-04-27,2019-05-27,30569,2868,10,0.6845143790998036,0.7785463228406565,floor,False
2019-05-27,2019-06-26,33437,2103,10,0.7044829646501838,0.702930492882424,floor,False
2019-06-26,2019-07-26,35540,1656,10,0.7410388581501655,0.7071074282955321,floor,False
2019-07-26,2019-08-25,37196,1387,9,0.6690237956937872,0.7100120673000511,floor,False
2019-08-25,2019-09-24,38583,1463,9,0.8431498985402717,0.7048485394980455,,False
2019-09-24,2019-10-24,40046,2813,10,0.7669974976638769,0.7510708507947413,,False
2019-10-24,2019-11-23,42859,5221,9,0.7956960123810108,0.7597237306326452,,False
2019-11-23,2019-12-23,48080,858,10,0.7825310775977123,0.8019478028617198,,False
"""


@pytest.fixture(scope="module")
def wf(spark):
    pdf = pd.read_csv(io.StringIO(WF), keep_default_na=False)
    df = spark.createDataFrame(pdf[["boundary", "test_end", "n_train", "n_test", "families_present",
                                    "api_macro_f1"]])
    return (df.withColumn("boundary", F.to_date("boundary")).withColumn("test_start", F.col("boundary"))
              .withColumn("test_end", F.to_date("test_end"))), pdf


def test_trigger_windows(wf):
    df, pdf = wf
    got = monitor.triggers(df).orderBy("boundary").toPandas()
    for g, e in zip(got.itertuples(), pdf.itertuples()):
        if e.trailing_mean == "":
            assert g.trailing_mean_macro_f1 is None or math.isnan(g.trailing_mean_macro_f1)
        else:
            assert abs(g.trailing_mean_macro_f1 - float(e.trailing_mean)) < 1e-12
        assert g.trigger_reason == e.trigger_reason
        assert bool(g.retrain_recommended) == (str(e.retrain_recommended) == "True")


def test_trigger_episodes_and_summary(wf):
    df, _ = wf
    t = monitor.triggers(df)
    ep = monitor.episodes(t).orderBy("start_boundary").collect()
    assert [(str(r.start_boundary), str(r.end_boundary), str(r.end_test_end), r.trigger_reason, r.n_windows)
            for r in ep] == [("2018-08-30", "2018-08-30", "2018-09-29", "floor+trailing_mean_drop", 1),
                             ("2019-02-26", "2019-07-26", "2019-08-25", "floor+trailing_mean_drop", 6)]
    assert abs(ep[0].min_macro_f1 - 0.6696110307050376) < 1e-12
    assert abs(ep[1].min_macro_f1 - 0.6690237956937872) < 1e-12
    s = monitor.trigger_summary(t).first()
    assert (s.n_windows, s.n_trigger_windows, s.n_trigger_episodes) == (19, 7, 2)
    assert (s.mean_macro_f1, s.min_macro_f1, s.max_macro_f1) == (0.7908, 0.669, 0.9289)
    assert s.recommended_retrain_boundaries == "2018-08-30,2019-02-26"


def test_drop_trigger_only(spark):
    df = spark.createDataFrame([(f"2020-01-0{i + 1}", m) for i, m in enumerate([0.9, 0.9, 0.9, 0.79])],
                               "boundary string, api_macro_f1 double").withColumn("boundary", F.to_date("boundary"))
    last = monitor.triggers(df).orderBy(F.desc("boundary")).first()
    assert (last.floor_trigger, last.drop_trigger, last.trigger_reason) == (False, True, "trailing_mean_drop")


CM = {
    "baseline_random_api_hash_sgd": ("""140,0,0,0,1,0,0,0,0,0
8,2716,47,20,1,0,6,13,47,28
0,0,131,0,0,0,0,0,0,0
0,41,1,699,47,6,18,9,8,9
1,19,1,4,551,41,15,10,12,20
0,7,0,0,0,972,0,0,0,0
0,1,0,25,16,0,2451,6,4,15
4,30,0,8,15,31,169,580,3,1
1,2,4,1,6,1,0,0,252,2
8,24,3,7,7,7,11,8,32,412""", 0.9089424255, 0.8718281565),
    "table_5_11_fusion_global_sgd": ("""3,0,0,0,0,0,0,0,0,0
0,3240,0,67,2,0,7,59,46,103
0,0,68,0,1,0,0,0,0,0
0,1,0,486,23,0,0,0,0,2
0,0,0,0,368,0,2,1,0,6
0,1,0,0,0,344,0,0,0,2
0,1,0,1,13,0,3238,0,0,0
0,2,0,1,12,0,3,1063,1,25
0,0,0,0,0,0,0,0,476,1
0,2,0,0,1,0,0,0,0,124""", 0.9605961617, 0.9316918837),
    "table_5_12_fusion_per_family_sgd": ("""141,0,0,0,0,0,0,0,0,0
0,2723,0,14,4,58,7,33,46,1
0,0,130,0,1,0,0,0,0,0
0,4,0,762,67,0,4,1,0,1
0,0,0,2,664,0,2,1,0,6
0,1,0,0,0,975,0,0,0,3
0,1,0,0,5,0,2513,0,0,0
0,2,0,1,3,0,3,806,0,26
0,0,0,0,0,0,0,0,268,1
0,10,0,5,12,2,0,1,0,489""", 0.9665271967, 0.9607077106),
    "table_5_8": ("""3,0,0,0,0,0,0,0,0,0
0,3242,0,90,7,0,0,49,0,136
0,0,68,0,1,0,0,0,0,0
0,2,0,478,22,0,10,0,0,0
0,0,0,1,368,0,2,1,0,5
0,3,0,0,0,344,0,0,0,0
0,1,0,5,28,0,3218,0,0,1
0,28,0,0,11,0,2,1066,0,0
2,0,0,1,1,0,0,0,473,0
0,2,0,3,4,0,0,0,0,118""", 0.9573295223, 0.9024446384),
    "table_6_1_fusion_global_lightgbm": ("""3,0,0,0,0,0,0,0,0,0
0,3083,0,176,102,1,0,26,43,93
0,0,68,0,1,0,0,0,0,0
0,1,0,483,6,0,0,4,0,18
0,0,0,2,372,0,0,0,2,1
0,0,0,0,0,345,0,0,0,2
0,0,0,0,1,0,3251,0,0,1
0,0,0,0,3,0,1,1074,2,27
0,0,0,1,0,0,0,0,466,10
0,1,0,0,1,4,0,0,0,121""", 0.9458962842, 0.9118023805),
}
CLASSES = ["adload", "emotet", "harhar", "lokibot", "njrat", "qakbot", "swisyn", "trickbot", "ursnif", "zeus"]


def confusion_cells(spark):
    rows = []
    for run, (mat, _, _) in CM.items():
        for i, line in enumerate(mat.splitlines()):
            for j, n in enumerate(line.split(",")):
                rows.append((run, CLASSES[i], CLASSES[j], int(n)))
    return spark.createDataFrame(rows, "run string, y_true string, y_pred string, n long")


def test_confusion_goldens(spark):
    cells = confusion_cells(spark)
    got = {r.run: r for r in metrics.summary(cells, ["run"], classes=CLASSES, weight="n").collect()}
    for run, (_, acc, mf1) in CM.items():
        assert abs(got[run].accuracy - acc) < 1e-9, run
        assert abs(got[run].macro_f1 - mf1) < 1e-9, run
    assert got["table_5_8"].n == 9796


def test_bootstrap_point_inside_ci(spark):
    cells = confusion_cells(spark).where(F.col("run") == "table_5_8")
    draws = resample.confusion_bootstrap(cells, CLASSES, b=400, seed=2026)
    ci = resample.percentile_ci(draws.where(F.col("class") == "__macro__"), "f1", ["run"]).first()
    assert ci.f1_ci_lo < 0.9024446384 < ci.f1_ci_hi
    again = resample.confusion_bootstrap(cells, CLASSES, b=400, seed=2026, partitions=3)
    assert sorted(r.f1 for r in draws.where(F.col("class") == "__macro__").collect()) == \
        sorted(r.f1 for r in again.where(F.col("class") == "__macro__").collect())


def test_mcnemar_golden(spark):
    rows = [("x", "x", "y")] * 96 + [("x", "y", "x")] * 64 + [("x", "x", "x")] * 500
    df = spark.createDataFrame(rows, "y_true string, pred_a string, pred_b string")
    r = resample.mcnemar(df, "y_true", "pred_a", "pred_b").first()
    assert (r.b, r.c, r.n_discordant) == (96, 64, 160)
    assert abs(r.p_value - 0.0140010162) < 1e-9
    none = spark.createDataFrame([("x", "x", "x")], "y_true string, pred_a string, pred_b string")
    assert resample.mcnemar(none, "y_true", "pred_a", "pred_b").first().p_value == 1.0


OPENSET = """emotet,api_tfidf,margin,0.9456,0.9632,0.9781,0.9849
harhar,api_tfidf,margin,0.8704,0.9246,0.9855,0.9788
lokibot,api_tfidf,margin,0.8777,0.8763,0.8775,0.9419
njrat,api_tfidf,margin,0.8728,0.8817,0.7908,0.9263
qakbot,api_tfidf,margin,0.857,0.9317,0.5714,0.9517
swisyn,api_tfidf,margin,0.7884,0.9188,0.0307,0.8166
trickbot,api_tfidf,margin,0.8892,0.9253,0.6486,0.9295
ursnif,api_tfidf,margin,0.8988,0.9147,0.9346,0.9593
zeus,api_tfidf,margin,0.8898,0.9253,0.8571,0.9638
emotet,api_tfidf,max_prob,0.9503,0.9608,0.9898,0.991
harhar,api_tfidf,max_prob,0.8682,0.9216,0.9855,0.9807
lokibot,api_tfidf,max_prob,0.8857,0.888,0.8775,0.9377
njrat,api_tfidf,max_prob,0.8855,0.8859,0.9312,0.9343
qakbot,api_tfidf,max_prob,0.9046,0.9215,1.0,0.9474
swisyn,api_tfidf,max_prob,0.7859,0.9222,0.0225,0.8263
trickbot,api_tfidf,max_prob,0.9102,0.9219,0.7028,0.927
ursnif,api_tfidf,max_prob,0.9114,0.922,0.9939,0.9688
zeus,api_tfidf,max_prob,0.8977,0.9268,0.9524,0.9691
emotet,fusion,margin,0.9209,0.9647,0.9231,0.9801
harhar,fusion,margin,0.8711,0.9275,0.9855,0.9377
lokibot,fusion,margin,0.877,0.8879,0.965,0.9578
njrat,fusion,margin,0.82,0.8471,0.6533,0.8853
qakbot,fusion,margin,0.8945,0.9326,0.8762,0.9412
swisyn,fusion,margin,0.6945,0.9563,0.007,0.9246
trickbot,fusion,margin,0.9217,0.92,0.887,0.9689
ursnif,fusion,margin,0.9059,0.9244,0.9755,0.9679
zeus,fusion,margin,0.8864,0.9204,0.9603,0.958
emotet,fusion,max_prob,0.9322,0.9592,0.962,0.9882
harhar,fusion,max_prob,0.864,0.9181,0.9855,0.9434
lokibot,fusion,max_prob,0.8786,0.8926,0.965,0.946
njrat,fusion,max_prob,0.8194,0.8498,0.6562,0.8795
qakbot,fusion,max_prob,0.8997,0.9199,0.9905,0.9424
swisyn,fusion,max_prob,0.7002,0.943,0.0007,0.9037
trickbot,fusion,max_prob,0.9255,0.9173,0.9769,0.968
ursnif,fusion,max_prob,0.9076,0.9227,0.9898,0.9686
zeus,fusion,max_prob,0.8791,0.9121,0.9683,0.9609"""


def test_openset_rollup_golden(spark):
    rows = [tuple(x if i < 3 else float(x) for i, x in enumerate(line.split(",")))
            for line in OPENSET.splitlines()]
    df = spark.createDataFrame(rows, "heldout string, view_request string, score_method string, "
                                     "open_set_macro_f1 double, known_acceptance_rate double, "
                                     "unknown_rejection_rate double, unknown_detection_auroc double")
    got = {(r.view_request, r.score_method): r for r in openset.rollup(df).collect()}
    exp = {("api_tfidf", "margin"): (0.8766, 0.7416, 0.9180, 0.9392),
           ("api_tfidf", "max_prob"): (0.8888, 0.8284, 0.9190, 0.9425),
           ("fusion", "margin"): (0.8658, 0.8037, 0.9201, 0.9468),
           ("fusion", "max_prob"): (0.8674, 0.8328, 0.9150, 0.9445)}
    for k, (f1, rej, acc, auc) in exp.items():
        r = got[k]
        assert (r.mean_open_set_macro_f1, r.mean_unknown_rejection_rate, r.mean_known_acceptance_rate,
                r.mean_unknown_detection_auroc) == (f1, rej, acc, auc), k


def test_split_size_formulas(spark):
    assert splits.expected_random_sizes(48976) == (35262, 3918, 9796)
    df = spark.range(48976).select(F.col("id").alias("sample_id"),
                                   F.date_add(F.to_date(F.lit("2018-01-01")), (F.col("id") % 700).cast("int"))
                                   .alias("date"))
    f = splits.global_boundary(df, "date").first()
    assert (f.n_train, f.n_val, f.n_test) == (35262, 3918, 9796)
    parts = splits.global_chronological(df, "sample_id", "date")
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {"train": 35262, "val": 3918, "test": 9796}


def test_probability_scores(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([1.0],)], "p array<double>")
    r = df.select(*metrics.top_scores("p")).collect()
    assert r[0].pred_idx == 1 and r[0].max_prob == 0.5 and abs(r[0].margin - 0.2) < 1e-12
    assert r[1].margin == 1.0
    bins = spark.createDataFrame([(0.1,), (0.0,), (1.0,), (0.30000000000000004,), (0.3,)], "p double") \
        .select(metrics.ece_bin("p").alias("b")).collect()
    assert [b.b for b in bins] == [0, None, 9, 2, 2]
