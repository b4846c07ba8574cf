"""Training-run logs: epoch roll-up (O86), best epoch and early stop (O87),
sweep plan and leaderboard (O85).

Batch logs are aggregated per (run, epoch) first (map-side partial
aggregation absorbs a run that owns most batches); the best-epoch and
early-stop rules then run as windows over the per-epoch table, which has
one row per epoch, so every window partition is small.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def epoch_rollup(log: DataFrame, run: str = "run_id", epoch: str = "epoch",
                 loss: str = "loss", correct: str = "correct",
                 digits: int = 12) -> DataFrame:
    """Mean batch loss, accuracy and perplexity ``exp(mean loss)``
    (Infinity on overflow) per (run, epoch). Means are rounded to ``digits``
    places so they do not depend on the partial-sum order."""
    g = log.groupBy(run, epoch).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.avg(loss), digits).alias("loss"),
        F.round(F.avg(F.col(correct).cast("double")), digits).alias("accuracy"))
    return g.withColumn("perplexity", F.round(F.exp("loss"), 9))


def best_and_stop(epochs: DataFrame, run: str = "run_id", epoch: str = "epoch",
                  acc: str = "accuracy", frozen_epochs: int = 3,
                  patience: int = 2) -> DataFrame:
    """O87 per run: (n_epochs, best_epoch, best_accuracy, stop_epoch,
    epochs_run).

    Epochs 1..frozen_epochs are phase 1, later ones phase 2. The best
    accuracy is carried across phases and only a strict gain counts (first
    maximum wins). In phase 2 the counter of epochs without gain restarts at
    the phase start; reaching ``patience`` (> 0) stops the run after that
    epoch, and later epochs are ignored.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    prev = F.max(acc).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = epochs.withColumn("_gain", F.col(acc) > F.coalesce(prev, F.lit(-1.0)))
    e = e.withColumn("_i2", F.when(F.col(epoch) > frozen_epochs,
                                   F.col(epoch) - F.lit(frozen_epochs)))
    last = F.max(F.when(F.col("_gain") & F.col("_i2").isNotNull(), F.col("_i2"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_cnt", F.col("_i2") - F.coalesce(last, F.lit(0)))
    hit = F.col("_i2").isNotNull() & (F.col("_cnt") >= patience) & F.lit(patience > 0)
    e = e.withColumn("_stop", F.min(F.when(hit, F.col(epoch))).over(Window.partitionBy(run)))
    kept = e.filter(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return kept.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs_run"),
        F.max(F.when(F.col("_gain"), F.col(epoch))).alias("best_epoch"),
        F.max(acc).alias("best_accuracy"),
        F.first("_stop", ignorenulls=True).alias("stop_epoch"))


def run_id(hidden, layers, dropout):
    return f"h{hidden}_l{layers}_d{int(round(dropout * 100))}"


def sweep_plan(spark: SparkSession, hidden=(128, 256, 384), layers=(1, 2),
               dropout=(0.2, 0.3, 0.4)) -> DataFrame:
    """O85 plan: the Cartesian grid (a few rows) with ordinal and run id."""
    rows = [(i, run_id(h, l, d), h, l, float(d)) for i, (h, l, d) in
            enumerate(itertools.product(hidden, layers, dropout))]
    return spark.createDataFrame(
        rows, "grid_idx int, run_id string, hidden int, layers int, dropout double")


def fit_plan(spark: SparkSession, num_features=(1 << 12, 1 << 16), reg_param=(0.0, 0.1),
             elastic_net=(0.0,)) -> DataFrame:
    """O85 plan over the parameters of our classifier: ordinal, run id and one row per run."""
    rows = [(i, f"f{n}_r{int(round(r * 1000))}_e{int(round(e * 100))}", n, float(r), float(e))
            for i, (n, r, e) in enumerate(itertools.product(num_features, reg_param, elastic_net))]
    return spark.createDataFrame(rows, "grid_idx int, run_id string, num_features int, reg_param double, elastic_net double")


def run_config(params: dict, sizes: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """The run document, one row: parameters, split sizes and the two
    metrics documents (see ``evaluate.metrics_document``)."""
    s = sizes.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("split") == x, F.col("n"))), F.lit(0)).alias(x)
                              for x in ("train", "val", "test")])
    parts = [s.select(F.struct("train", "val", "test").alias("sizes")), validation.select(F.col("metrics").alias("validation")),
             test.select(F.col("metrics").alias("test"))]
    # three one-row documents, folded into one row
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    one = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("sizes", "validation", "test")])
    values = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    return one.select(values.alias("params"), "sizes", "validation", "test")


def leaderboard(results: DataFrame, metric: str = "test_accuracy") -> DataFrame:
    """Runs by ``metric`` descending, missing metrics last."""
    return results.orderBy(F.desc_nulls_last(metric), "run_id")
