"""Run logs from ``events``: run = user, epoch = day, batch = event."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources.tables import table
from .catalog import register
from .q_balance import BAL_CTES, SPLIT_CTES
from .q_evaluate import SCORED_CTES

FROZEN, PATIENCE = 3, 2
GRID = ((128, 256, 384), (1, 2), (0.2, 0.3, 0.4))   # hidden, layers, dropout


def batch_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return ev.select(F.col("user_id").alias("run_id"),
                     (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1)
                     .alias("epoch"),
                     (F.col("value") / F.lit(100.0)).alias("loss"),
                     (F.col("event_type") != "error").alias("correct"))


LOG_CTES = """log AS (SELECT user_id AS run_id,
    CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
    value / 100.0 AS loss, event_type <> 'error' AS correct FROM events),
ep AS (SELECT run_id, epoch, count(*) AS n_batches, round(avg(loss), 12) AS loss,
    round(avg(CAST(correct AS DOUBLE)), 12) AS accuracy FROM log GROUP BY run_id, epoch)"""


@register("epoch_rollup", f"""WITH {LOG_CTES}
SELECT *, round(exp(loss), 9) AS perplexity FROM ep""")
def epoch_rollup(spark, sf_dir):
    return R.epoch_rollup(batch_log(spark, sf_dir))


BEST_CTES = f"""{LOG_CTES},
e1 AS (SELECT *, accuracy > coalesce(max(accuracy) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS gain,
  CASE WHEN epoch > {FROZEN} THEN epoch - {FROZEN} END AS i2 FROM ep),
e2 AS (SELECT *, i2 - coalesce(max(CASE WHEN gain AND i2 IS NOT NULL THEN i2 END) OVER
    (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
    AS cnt FROM e1),
e3 AS (SELECT *, min(CASE WHEN i2 IS NOT NULL AND cnt >= {PATIENCE} THEN epoch END)
    OVER (PARTITION BY run_id) AS stop FROM e2),
best AS (SELECT run_id, count(*) AS epochs_run,
  max(CASE WHEN gain THEN epoch END) AS best_epoch, max(accuracy) AS best_accuracy,
  max(stop) AS stop_epoch FROM e3 WHERE stop IS NULL OR epoch <= stop GROUP BY run_id)"""


@register("best_epoch", f"WITH {BEST_CTES}\nSELECT * FROM best")
def best_epoch(spark, sf_dir):
    return R.best_and_stop(R.epoch_rollup(batch_log(spark, sf_dir)),
                           frozen_epochs=FROZEN, patience=PATIENCE)


def _grid_sql():
    plan = [(i, R.run_id(h, l, d), h, l, d) for i, (h, l, d) in enumerate(
        itertools.product(*GRID))]
    vals = ", ".join(f"({i}, '{r}', {h}, {l}, {d})" for i, r, h, l, d in plan)
    return f"grid(grid_idx, run_id, hidden, layers, dropout) AS (VALUES {vals})", len(plan)


_GRID, _NGRID = _grid_sql()


@register("sweep_leaderboard", f"""WITH {BEST_CTES},
{_GRID},
lossbest AS (SELECT b.run_id AS log_run, b.best_accuracy, e.loss FROM best b
  JOIN ep e ON b.run_id = e.run_id AND b.best_epoch = e.epoch)
SELECT g.run_id || '_u' || CAST(l.log_run AS VARCHAR) AS run_id, g.hidden, g.layers,
  CAST(g.dropout AS DOUBLE) AS dropout,
  l.best_accuracy AS test_accuracy, l.loss AS test_loss
FROM lossbest l JOIN grid g ON l.log_run % {_NGRID} = g.grid_idx""")
def sweep_leaderboard(spark, sf_dir):
    """Each logged run is one sweep point (run % grid size); its best epoch
    gives the test metrics; the leaderboard sorts by accuracy."""
    ep = R.epoch_rollup(batch_log(spark, sf_dir))
    best = R.best_and_stop(ep, frozen_epochs=FROZEN, patience=PATIENCE)
    lb = best.join(ep.select("run_id", F.col("epoch").alias("best_epoch"), "loss"),
                   ["run_id", "best_epoch"])
    grid = F.broadcast(R.sweep_plan(spark, *GRID).withColumnRenamed("run_id", "grid_run"))
    res = lb.join(grid, (F.col("run_id") % _NGRID) == F.col("grid_idx")).select(
        F.concat("grid_run", F.lit("_u"), F.col("run_id").cast("string")).alias("run_id"),
        "hidden", "layers", "dropout",
        F.col("best_accuracy").alias("test_accuracy"), F.col("loss").alias("test_loss"))
    return R.leaderboard(res)


@register("fitted_sweep")
def fitted_sweep(spark, sf_dir):
    """The plan fitted on the train split, its test metrics ranked (rows only)."""
    from ..operators.score import run_sweep
    from .q_score import splits
    s = splits(spark, sf_dir)
    return run_sweep(s.where("split = 'train'"), s.where("split = 'test'"), R.fit_plan(spark))


RUN_PARAMS = {"max_len": 320, "stride": 64, "batch_size": 16, "seed": 42, "test_size": 0.2, "val_size": 0.1}


def _half(side, lo, hi):
    return f"""{side} AS (SELECT count(*) FILTER (WHERE (label = 1) = (score >= 0.5)) / CAST(count(*) AS DOUBLE) AS accuracy,
  count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM scored WHERE ord % 10 BETWEEN {lo} AND {hi})"""


@register("run_config", f"""WITH {SPLIT_CTES},
{SCORED_CTES[len(BAL_CTES) + 2:]},
sz AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM splitted),
{_half("hv", 0, 4)}, {_half("ht", 5, 9)}
SELECT 320 AS max_len, 42 AS seed, sz.*, hv.accuracy AS val_accuracy, hv.tn AS val_tn, ht.accuracy AS test_accuracy, ht.tn AS test_tn
FROM sz, hv, ht""")
def run_config(spark, sf_dir):
    """The run document, written as JSON and read back. Two halves of
    the scored rows stand for the validation and the test scores."""
    import uuid

    from ..operators import evaluate as EV
    from ..operators import split as SP
    from ..session import scratch_path
    from .q_evaluate import scored
    from .q_score import splits
    rows = scored(spark, sf_dir)
    val, test = rows.where("ord % 10 < 5"), rows.where("ord % 10 >= 5")
    doc = R.run_config(RUN_PARAMS, SP.split_counts(splits(spark, sf_dir)),
                       EV.metrics_document(EV.evaluate(val)), EV.metrics_document(EV.evaluate(test)))
    path = scratch_path(spark, f"run-config-{uuid.uuid4().hex[:8]}")
    doc.write.json(path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("params.max_len", "params.seed", F.col("sizes.train").alias("n_train"), F.col("sizes.val").alias("n_val"),
                       F.col("sizes.test").alias("n_test"), F.col("validation.accuracy").alias("val_accuracy"),
                       F.col("validation.confusion_matrix")[0][0].alias("val_tn"), F.col("test.accuracy").alias("test_accuracy"),
                       F.col("test.confusion_matrix")[0][0].alias("test_tn"))
