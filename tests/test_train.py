"""Epoch training against a numpy run, resumed and not."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import runs as R
from opinio.operators import train as T

NF, BUCKETS = 64, 3


def rows(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = i % 2
        words = [rng.choice(["good", "fine", "top"] if rng.random() < (.8 if y else .3) else ["bad", "poor", "weak"])
                 for _ in range(rng.randrange(1, 9))] + [f"w{rng.randrange(30)}" for _ in range(3)]
        out.append((i, " ".join(words), y))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "seq long, text string, label int")


def numpy_run(spark, train, val, epochs, rates, decay, patience, seed):
    """The same training over a dense matrix, in one process."""
    def dense(df):
        d = T.hashed_words(df, NF).select("seq", "label", "words", F.pmod(F.xxhash64("seq", F.lit(7)), F.lit(BUCKETS)).alias("b"))
        got = [r for r in d.orderBy("seq").collect() if r["words"] and r["label"] is not None]
        x = np.zeros((len(got), NF + 1))
        for i, r in enumerate(got):
            for w in r["words"]:
                x[i, w] += 1 / np.sqrt(len(r["words"]))
        x[:, -1] = 1
        return x, np.array([r["label"] for r in got], float), np.array([r["b"] for r in got])

    (x, y, b), (vx, vy, _) = dense(train), dense(val)
    w, m, v, t, log, accs = np.zeros(NF + 1), np.zeros(NF + 1), np.zeros(NF + 1), 0, [], []
    best, since, saved = -1, 0, None
    for epoch in range(1, sum(epochs) + 1):
        phase = 1 if epoch <= epochs[0] else 2
        for k in np.random.default_rng([seed, epoch]).permutation(BUCKETS):
            xs, ys = x[b == k], y[b == k]
            p = 1 / (1 + np.exp(-xs @ w))
            log.append((epoch, int(k), -np.mean(ys * np.log(p) + (1 - ys) * np.log(1 - p)), np.mean((p >= .5) == (ys == 1))))
            g, t = xs.T @ (p - ys) / len(ys), t + 1
            m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
            w = w - rates[phase - 1] * decay * np.append(w[:-1], 0) - rates[phase - 1] * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .999 ** t)) + 1e-8)
        acc = np.mean((vx @ w >= 0) == (vy == 1))
        accs.append(acc)
        if acc > best:
            best, since, saved = acc, 0, w.copy()
        else:
            since = since + 1 if phase == 2 else 0
        if phase == 2 and 0 < patience <= since:
            break
    return w, saved, log, accs


HOW = dict(epochs=(2, 4), rates=(.3, .1), decay=.02, patience=2, seed=5)


def test_weights_equal_numpy_and_resume(spark):
    data = rows() + [(1000, None, 1), (1001, "...", 0), (1002, "good", None)]
    train, val = frame(spark, data).repartition(4), frame(spark, rows(80, 2))
    w, best, log, accs = numpy_run(spark, train, val, **HOW)
    one, two = (tempfile.mkdtemp(prefix="opinio-test-") for _ in range(2))
    end = T.train_epochs(train, val, one, num_features=NF, buckets=BUCKETS, **HOW)
    last = T.Model.read(spark, f"{one}/model/epoch={end['epoch']}", NF, end["steps"])
    assert np.allclose(last.weights, w, atol=1e-10) and np.allclose(T.best_model(spark, one, NF).weights, best, atol=1e-10)
    got = sorted((r["step"], r["epoch"], r["bucket"], r["loss"], r["correct"]) for r in T.batch_log(spark, one).collect())
    assert len(got) == len(log) and all(a[1:3] == b[:2] and np.allclose(a[3:], b[2:]) for a, b in zip(got, log))
    states = [r["accuracy"] for r in T.epoch_states(spark, one).orderBy("epoch").collect()]
    assert np.allclose(states, accs)
    # interrupted after two epochs, and a third that wrote its model but not its state
    T.train_epochs(train, val, two, num_features=NF, buckets=BUCKETS, until=2, **HOW)
    T.Model.zeros(NF).write(spark, f"{two}/model/epoch=3")
    assert T.train_epochs(train, val, two, num_features=NF, buckets=BUCKETS, **HOW).keys() == end.keys()
    again = T.Model.read(spark, f"{two}/model/epoch={end['epoch']}", NF, 0)
    assert np.allclose(again.weights, w, atol=1e-10)
    # the log feeds the roll-up and the rule of the best epoch
    epochs = R.epoch_rollup(T.batch_log(spark, one))
    assert epochs.count() == len(accs)
    val_log = T.epoch_states(spark, one).select(F.lit("run").alias("run_id"), "epoch", "accuracy")
    rule = R.best_and_stop(val_log, frozen_epochs=2, patience=2).first()
    assert (rule["best_epoch"], rule["epochs_run"]) == (end["best_epoch"], len(accs))


def test_scores_and_no_rows(spark):
    m = T.Model.zeros(NF)
    m.weights[-1] = 1.0
    got = T.scored(frame(spark, [(1, "a b", 1), (2, None, 0), (3, "..", 0)]), m).orderBy("seq").collect()
    assert got[0]["score"] == pytest.approx(1 / (1 + np.exp(-1))) and got[1]["score"] is None and got[2]["score"] is None
    with pytest.raises(ValueError, match="no training rows"):
        T.train_epochs(frame(spark, [(1, None, 1)]), frame(spark, []), tempfile.mkdtemp(prefix="opinio-test-"), num_features=NF, buckets=2)
