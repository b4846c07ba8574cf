"""Evaluation goldens (recorded confusion matrices) and AUC vs brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from opinio.operators import evaluate as EV

# fixed values: the recorded test metrics of the studied run
GOLD = {"accuracy": 0.9182031511900771,
        "precision_neg": 0.9244897959183673, "recall_neg": 0.910857908847185,
        "f1_neg": 0.9176232275489534, "precision_pos": 0.9120951751487112,
        "recall_pos": 0.9255533199195171, "f1_pos": 0.918774966711052,
        "precision_weighted": 0.9182945630764103, "recall_weighted": 0.9182031511900771,
        "f1_weighted": 0.9181989040795229, "precision_macro": 0.9182924855335393,
        "recall_macro": 0.918205614383351, "f1_macro": 0.9181990971300027}


def _cm_df(spark, tn, fp, fn, tp):
    rows = ([(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp)
    return spark.createDataFrame([(i, l, s) for i, (l, s) in enumerate(rows)],
                                 "seq long, label int, score double")


def test_recorded_test_matrix(spark):
    r = EV.evaluate(_cm_df(spark, 1359, 133, 111, 1380)).first().asDict()
    for k, v in GOLD.items():
        assert r[k] == pytest.approx(v, abs=1e-15), k
    assert r["n_errors"] == 244 and r["n"] == 2983


def test_recorded_val_matrix(spark):
    r = EV.evaluate(_cm_df(spark, 568, 28, 76, 521)).first().asDict()
    assert r["accuracy"] == pytest.approx(0.9128248113998323, abs=1e-12)


def _auc_brute(pairs):
    pos = [s for l, s in pairs if l == 1]
    neg = [s for l, s in pairs if l == 0]
    if not pos or not neg:
        return float("nan")
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_with_ties(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "label int, score double").repartition(5)
    got = EV.roc_auc(df).first()["roc_auc"]
    assert got == pytest.approx(_auc_brute(pairs), abs=1e-12)


def test_auc_one_class_nan_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    r = EV.evaluate(df).first()
    assert math.isnan(r["roc_auc"])
    assert r["precision_pos"] == 0.0 and r["f1_pos"] == 0.0   # nothing predicted positive
    empty = spark.createDataFrame([], "label int, score double")
    e = EV.evaluate(empty).first()
    assert e["accuracy"] == 0.0 and e["n"] == 0


def test_threshold_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.49999)], "label int, score double")
    r = EV.confusion_counts(df).first()
    assert (r["tp"], r["tn"]) == (1, 1)


def test_log_loss_batches(spark):
    rows = [(i, 1, 0.8, i // 3) for i in range(7)]  # batches of 3,3,1
    rows[6] = (6, 0, 0.8, 2)
    df = spark.createDataFrame(rows, "seq long, label int, score double, b long")
    r = EV.log_loss(df, batch_col="b").first()
    l1, l0 = -math.log(0.8), -math.log(0.2)
    assert r["log_loss"] == pytest.approx((6 * l1 + l0) / 7, abs=1e-11)
    assert r["loss"] == pytest.approx((l1 + l1 + l0) / 3, abs=1e-11)


def test_top_errors_stable_ties(spark):
    rows = [(i, 0, 0.9, f"t{i}") for i in range(10)] + [(10, 1, 0.05, "x")]
    df = spark.createDataFrame(rows, "seq long, label int, score double, text string")
    got = [r["seq"] for r in EV.top_errors(df.repartition(4), k=4).collect()]
    assert got == [10, 0, 1, 2]
    e = EV.error_rows(df).filter("seq = 10").first()
    assert e["error_confidence"] == pytest.approx(0.95) and e["length_chars"] == 1


def test_metrics_document_json(spark):
    flat = EV.evaluate(_cm_df(spark, 1359, 133, 111, 1380))
    d = json.loads(EV.metrics_document(flat, standalone=True).first()["json"])
    assert d["confusion_matrix"] == [[1359, 133], [111, 1380]]
    assert d["n_errors"] == 244 and d["n_test"] == 2983
    assert "macro" not in d and "loss" not in d
    t = json.loads(EV.metrics_document(flat).first()["json"])
    assert t["macro"]["f1"] == pytest.approx(GOLD["f1_macro"], abs=1e-15)


def test_rows_without_a_score_are_counted_apart(spark):
    rows = [(0, 0.2), (1, 0.8), (1, None), (0, float("nan"))]
    r = EV.evaluate(spark.createDataFrame(rows, "label int, score double")).first()
    assert (r["n"], r["n_unscored"], r["tn"], r["tp"], r["roc_auc"]) == (2, 2, 1, 1, 1.0)
    assert EV.error_count(spark.createDataFrame(rows, "label int, score double")).first()[0] == 0


def test_auc_of_saturated_scores(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.randrange(2), 1 - rng.randrange(1, 400) * 1e-12) for _ in range(600)]
    got = EV.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()[0]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12
