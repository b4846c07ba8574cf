"""The classifier against numpy, and sweeps with a failing run."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from opinio.operators import evaluate as EV
from opinio.operators import runs as R
from opinio.operators import score as S


def data(spark, n=160, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["good", "bad", "odd"] + [["poor"], ["fine"]][i % 2] * 3) for _ in range(6)), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, text string, label int")


def plan(spark, bad):
    rows = [(0, "a", 64, 0.1, 0.0), (1, "b", 64, -1.0 if bad else 0.5, 0.0), (2, "c", 32, 0.2, 0.0), (3, "d", 64, 0.3, 0.0)]
    return spark.createDataFrame(rows, "grid_idx int, run_id string, num_features int, reg_param double, elastic_net double")


def test_a_failed_run_is_a_row(spark):
    train, test = data(spark), data(spark, 60, 4)
    got = {r["run_id"]: r for r in S.run_sweep(train, test, plan(spark, True)).collect()}
    assert set(got) == set("abcd") and got["b"]["status"] == "failed" and "regParam" in got["b"]["reason"]
    assert got["b"]["test_accuracy"] is None
    for k in "acd":
        assert got[k]["status"] == "ok" and got[k]["reason"] is None and got[k]["test_accuracy"] > .6
    # the same numbers as a fit of its own
    m = S.fit_classifier(train, num_features=32, reg_param=0.2)
    one = EV.evaluate(S.score_with(m, test).select("label", "score")).first()
    assert got["c"]["test_accuracy"] == one["accuracy"] and got["c"]["test_loss"] == pytest.approx(one["loss"])


def test_abort_cancels_the_others(spark):
    train, test = data(spark), data(spark, 60, 4)
    with pytest.raises(S.SweepAborted, match="run b: .*regParam") as e:
        S.run_sweep(train, test, plan(spark, True), on_error="abort", at_once=1)
    got = {r["run_id"]: r["status"] for r in e.value.results.collect()}
    assert got == {"a": "ok", "b": "failed", "c": "cancelled", "d": "cancelled"}
    with pytest.raises(ValueError):
        S.run_sweep(train, test, plan(spark, False), on_error="ignore")


def test_running_jobs_are_cancelled(spark, monkeypatch):
    """A run that is in the middle of a job when another fails ends as cancelled."""
    real, begun = S.regression, threading.Event()

    class Slow:
        def fit(self, d):
            begun.set()
            d.select("_y").mapInPandas(lambda parts: (p for p in parts if time.sleep(60) is None), "_y double").collect()

    class Failing:
        def fit(self, d):
            begun.wait(60)
            time.sleep(2)
            raise RuntimeError("lost")

    monkeypatch.setattr(S, "regression", lambda reg_param, **k: Slow() if reg_param == 0.1 else Failing() if reg_param == 0.5 else real(reg_param, **k))
    t = time.time()
    with pytest.raises(S.SweepAborted, match="lost") as e:
        S.run_sweep(data(spark), data(spark, 20), plan(spark, False).where("grid_idx < 2"), on_error="abort", at_once=2)
    assert time.time() - t < 50
    assert {r["run_id"]: r["status"] for r in e.value.results.collect()} == {"a": "cancelled", "b": "failed"}


def test_dry_run(spark):
    rows = S.run_sweep(data(spark, 4), data(spark, 4), R.fit_plan(spark), dry_run=True).collect()
    assert len(rows) == 4 and {r["status"] for r in rows} == {"planned"}


def test_regression_equals_numpy(spark):
    """The fitted weights are the minimum of the same objective over the same features, found by Newton's method."""
    train = data(spark)
    f = S.feature_pipeline(16).fit(train)
    d = f.transform(S._with_y(train, "label")).select(vector_to_array("_features").alias("x"), "_y", "_features")
    got = d.orderBy("x", "_y").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["_y"] for r in got])
    sd = x.std(0, ddof=1)
    use = sd > 0  # the regression penalises weights of standardised features
    z = np.column_stack((x[:, use] / sd[use], np.ones(len(x))))
    w, reg = np.zeros(z.shape[1]), 0.1
    penalty = np.diag(np.append(np.full(use.sum(), reg), 0))
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty, z.T @ (p - y) / len(y) + penalty @ w)
    m = S.regression(reg_param=reg, max_iter=200).fit(d)
    assert np.allclose(m.coefficients.toArray()[use] * sd[use], w[:-1], atol=1e-3) and abs(m.intercept - w[-1]) < 1e-3


def test_metrics_from_scores(spark):
    """Accuracy, confusion, loss and AUC of scores, recomputed in Python."""
    train, test = data(spark), data(spark, 80, 9)
    s = S.score_with(S.fit_classifier(train, num_features=64, reg_param=.1), test).select("label", "score")
    rows = [(r["label"], r["score"]) for r in s.collect()]
    e = EV.evaluate(s).first()
    assert e["accuracy"] == pytest.approx(np.mean([(p >= .5) == (y == 1) for y, p in rows]))
    assert e["tp"] == sum(y == 1 and p >= .5 for y, p in rows) and e["fn"] == sum(y == 1 and p < .5 for y, p in rows)
    assert e["log_loss"] == pytest.approx(-np.mean([np.log(p if y else 1 - p) for y, p in rows]), abs=1e-9)
    pairs = [(a, b) for y, a in rows if y for x, b in rows if not x]
    assert e["roc_auc"] == pytest.approx(np.mean([(a > b) + .5 * (a == b) for a, b in pairs]), abs=1e-9)
