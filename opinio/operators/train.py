"""Training a text classifier by epochs (O84), with checkpoints, resume and a log for O86/O87.

The model is logistic regression over hashed words, fitted by mini-batches
with Adam steps and decoupled weight decay. Words are hashed in the JVM and
written once, dealt over ``buckets`` folders by the hash of the id; a
mini-batch is a bucket, so an epoch reads each row once. A step is one job:
every task adds up its rows' gradient, Spark adds up the tasks' by feature,
and the driver (which holds the weights and both moments, ``num_features``
numbers each) takes the step. Buckets come in another order each epoch, by a
seeded permutation.

Phase 1 runs ``epochs[0]`` epochs at ``rates[0]``, phase 2 at most
``epochs[1]`` at ``rates[1]``; it stops after ``patience`` epochs without a
gain in validation accuracy. The best epoch is the first of the greatest
accuracy, carried over both phases.

After each epoch its weights, moments and log rows are written, the state of
training last, below ``out_dir``. A run on the same folder goes on after the
last whole epoch and ends with the same weights as one that was not
interrupted.

Cases: rows without a label or a word are left out of the fit, and a text
without a word has no score (null); a bucket without rows gives no step and
no log row; no training rows at all raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import hard_pred
from ..session import ship_package
from .tokens import TOKEN_RE

STATE = "epoch int, phase int, accuracy double, best_epoch int, best_accuracy double, since int, stopped boolean, steps long"
LOG = "run_id string, phase int, epoch int, step long, bucket int, n long, loss double, correct double"
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def hashed_words(df: DataFrame, num_features: int, text_col: str = "text") -> DataFrame:
    """``df`` with ``words``: the feature number of each word, in order (null for a null text)."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN_RE), F.lit(0))
    return df.withColumn("words", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(num_features)).cast("int")))


def bucketed(train: DataFrame, path: str, num_features: int, buckets: int, id_col: str = "seq", text_col: str = "text",
             label_col: str = "label") -> DataFrame:
    """Write (y, words) of the training rows below ``path``, a folder a bucket."""
    d = hashed_words(train, num_features, text_col).where(F.col(label_col).isin(0, 1) & (F.size("words") > 0))
    d = d.select(F.col(label_col).cast("double").alias("y"), "words",
                 F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(buckets)).cast("int").alias("bucket"))
    d.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return train.sparkSession.read.schema("y double, words array<int>, bucket int").parquet(path)


def _rows(column):
    """The flat words of a list column, the row of each, and each row's factor (1 / sqrt of its words)."""
    n = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    words = column.flatten().to_numpy(zero_copy_only=False)
    return words, np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(n, 1)), n


def _margin(column, weights, bias):
    words, row, factor, n = _rows(column)
    return np.bincount(row, weights[words], len(n)) * factor + bias, words, row, factor, n


def gradient(batch: DataFrame, weights: np.ndarray, bias: float) -> dict:
    """{feature: gradient} of the summed log-loss; -1 the bias, -2 the loss, -3 the rows, -4 the right ones."""

    def partial(batches: Iterator):
        import pyarrow as pa
        g, more = np.zeros(len(weights)), np.zeros(4)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            z, words, row, factor, _ = _margin(b.column(1), weights, bias)
            error = 1 / (1 + np.exp(-z)) - y
            g += np.bincount(words, (error * factor)[row], len(g))
            more += error.sum(), (np.logaddexp(0, z) - y * z).sum(), len(y), ((z >= 0) == (y == 1)).sum()
        at = np.flatnonzero(g)
        yield pa.record_batch([pa.array(np.concatenate((at, [-1, -2, -3, -4])), pa.int32()),
                               pa.array(np.concatenate((g[at], more)))], names=["feature", "value"])

    parts = batch.select("y", "words").mapInArrow(partial, "feature int, value double")
    return {r["feature"]: r["value"] for r in parts.groupBy("feature").agg(F.sum("value").alias("value")).collect()}


@dataclass
class Model:
    """Weights and Adam's moments, the bias last; ``steps`` taken so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def zeros(cls, num_features: int) -> Model:
        return cls(*(np.zeros(num_features + 1) for _ in range(3)))

    def step(self, g: np.ndarray, rate: float, decay: float) -> None:
        self.steps += 1
        self.first += (1 - BETA1) * (g - self.first)
        self.second += (1 - BETA2) * (g * g - self.second)
        ahead = self.first / (1 - BETA1 ** self.steps) / (np.sqrt(self.second / (1 - BETA2 ** self.steps)) + EPSILON)
        self.weights[:-1] -= rate * decay * self.weights[:-1]
        self.weights -= rate * ahead

    def write(self, spark: SparkSession, path: str) -> None:
        import pandas as pd
        at = np.flatnonzero(self.weights.astype(bool) | self.first.astype(bool) | self.second.astype(bool))
        rows = pd.DataFrame({"feature": at.astype("int32"), "weight": self.weights[at], "first": self.first[at], "second": self.second[at]})
        spark.createDataFrame(rows, "feature int, weight double, first double, second double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, num_features: int, steps: int) -> Model:
        m = cls.zeros(num_features)
        rows = spark.read.parquet(path).toPandas()  # num_features rows at most
        at = rows["feature"].to_numpy()
        for field, column in ((m.weights, "weight"), (m.first, "first"), (m.second, "second")):
            field[at] = rows[column].to_numpy()
        m.steps = steps
        return m


def scored(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1, null for a text without a word."""
    weights, bias = model.weights[:-1], float(model.weights[-1])
    ship_package(df.sparkSession)
    d = hashed_words(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")),
                     len(weights)).select("row", "words")

    def score(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            z, _, _, _, n = _margin(b.column(1), weights, bias)
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-z)), mask=n == 0)], names=["row", "score"])

    out = d.mapInArrow(score, d.select("row", F.lit(None).cast("double").alias("score")).schema)
    return out.select("row.*", F.col("score").alias(score_col))


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def train_epochs(train: DataFrame, val: DataFrame, out_dir: str, run_id: str = "run", num_features: int = 1 << 16, buckets: int = 8,
                 epochs: tuple = (3, 5), rates: tuple = (0.05, 0.01), decay: float = 0.01, patience: int = 2, seed: int = 42,
                 id_col: str = "seq", text_col: str = "text", label_col: str = "label", until: int | None = None) -> dict:
    """Train, or go on with what ``out_dir`` holds; returns the last state (the fields of STATE).

    ``until`` ends the call after that epoch, as an interruption would.
    """
    from ..streaming.incremental import _exists
    spark = train.sparkSession
    ship_package(spark)
    path = f"{out_dir}/words"
    state = last_state(spark, out_dir)
    if not _exists(spark, f"{path}/_SUCCESS"):
        bucketed(train, path, num_features, buckets, id_col, text_col, label_col)
    data = spark.read.schema("y double, words array<int>, bucket int").parquet(path)
    model = Model.read(spark, f"{out_dir}/model/epoch={state['epoch']}", num_features, state["steps"]) if state else Model.zeros(num_features)
    state = state or {"epoch": 0, "phase": 1, "accuracy": None, "best_epoch": None, "best_accuracy": -1.0, "since": 0,
                      "stopped": False, "steps": 0}
    held = val.select(id_col, text_col, label_col)
    for epoch in range(state["epoch"] + 1, sum(epochs) + 1):
        if state["stopped"] or until is not None and epoch > until:
            break
        phase = 1 if epoch <= epochs[0] else 2
        log = []
        for bucket in np.random.default_rng([seed, epoch]).permutation(buckets).tolist():
            sums = gradient(data.where(F.col("bucket") == bucket), model.weights[:-1], float(model.weights[-1]))
            n = sums.get(-3, 0)
            if not n:
                continue
            g = np.zeros(num_features + 1)
            at = [f for f in sums if f >= 0]
            g[at], g[-1] = [sums[f] / n for f in at], sums[-1] / n
            model.step(g, rates[phase - 1], decay)
            log.append((run_id, phase, epoch, model.steps, bucket, int(n), sums[-2] / n, sums[-4] / n))
        if not log:
            raise ValueError("no training rows with a label and a word")
        right = F.avg((F.col(label_col) == hard_pred("score")).cast("double"))
        accuracy = scored(held, model, text_col).where("score IS NOT NULL").agg(right).first()[0] or 0.0
        gain = accuracy > state["best_accuracy"]
        since = 0 if gain or phase == 1 else state["since"] + 1
        state = {"epoch": epoch, "phase": phase, "accuracy": accuracy, "best_epoch": epoch if gain else state["best_epoch"],
                 "best_accuracy": accuracy if gain else state["best_accuracy"], "since": since,
                 "stopped": phase == 2 and 0 < patience <= since, "steps": model.steps}
        model.write(spark, f"{out_dir}/model/epoch={epoch}")
        _append(spark, log, LOG, f"{out_dir}/log/epoch={epoch}")
        _append(spark, [tuple(state.values())], STATE, f"{out_dir}/state/at={epoch}")  # the epoch counts once this is there
    return state


def last_state(spark: SparkSession, out_dir: str) -> dict | None:
    """The state after the last whole epoch."""
    from ..streaming.incremental import _exists
    if not _exists(spark, f"{out_dir}/state"):
        return None
    last = epoch_states(spark, out_dir).orderBy(F.desc("epoch")).first()
    return last and last.asDict()


def epoch_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """A row an epoch: phase, validation accuracy, best so far."""
    return spark.read.schema(STATE).parquet(*_folders(spark, f"{out_dir}/state"))


def _folders(spark: SparkSession, path: str) -> list:
    """The whole folders (with a success mark) below ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS"))
    return [s.getPath().getParent().toString() for s in found]


def batch_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """The log of all steps of whole epochs, for ``runs.epoch_rollup``."""
    upto = (last_state(spark, out_dir) or {"epoch": 0})["epoch"]
    names = [c.split()[0] for c in LOG.split(", ")]
    return spark.read.schema(LOG).parquet(*_folders(spark, f"{out_dir}/log")).where(F.col("epoch") <= upto).select(*names)


def best_model(spark: SparkSession, out_dir: str, num_features: int = 1 << 16) -> Model:
    """The checkpoint of the best epoch."""
    state = last_state(spark, out_dir)
    return Model.read(spark, f"{out_dir}/model/epoch={state['best_epoch']}", num_features, 0)
