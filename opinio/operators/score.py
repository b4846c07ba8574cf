"""Scoring: a Spark ML text classifier (O84) and a pluggable batched
predictor (O80).

O84 re-aims the reference's neural fit as ``pyspark.ml``:
RegexTokenizer -> HashingTF -> IDF -> LogisticRegression, trained on the
train split, model choice by validation accuracy (strict ``>``: the first
best candidate wins). O80 runs any batch predictor over token-id arrays
with ``predict_batch_udf`` (Arrow batches of ``batch_size`` rows, the
predictor built once per Python worker).
"""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import hard_pred
from ..session import scratch_path, staged
from .evaluate import evaluate
from .runs import leaderboard
from .tokens import TOKEN_RE


def feature_pipeline(num_features: int = 1 << 18, text_col: str = "text") -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_RE,
                         gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=int(num_features))
    return Pipeline(stages=[tok, tf, IDF(inputCol="_tf", outputCol="_features")])


def regression(reg_param: float = 0.0, elastic_net: float = 0.0, max_iter: int = 50) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="_y", regParam=float(reg_param),
                              elasticNetParam=float(elastic_net), maxIter=int(max_iter))


def tree_depth(partitions: int) -> int:
    """The depth at which ``treeAggregate`` leaves the fewest partial sums to the driver.

    A partial sum of the fit is as wide as its features, and every step
    sends those left to the driver; at depth 2 their number grows with the
    partitions.
    """
    def left(depth):
        n, scale = partitions, max(math.ceil(partitions ** (1 / depth)), 2)
        while n > scale + math.ceil(n / scale):
            n //= scale
        return n
    return min(range(2, 9), key=left)


def fitted(data: DataFrame, **params) -> LogisticRegressionModel:
    """``regression`` fitted to (_features, _y), written and read back.

    A model fresh from its fit carries a training summary, and that holds
    the session, which does not serialise any more once a query was observed
    (O39): no task could score with it. The model read back has none.
    """
    r = regression(**params)
    if isinstance(r, LogisticRegression):
        r = r.setAggregationDepth(tree_depth(data.rdd.getNumPartitions()))
    path = scratch_path(data.sparkSession, f"model-{uuid.uuid4().hex[:12]}")
    r.fit(data).write().save(path)
    return LogisticRegressionModel.load(path)


def _with_y(df: DataFrame, label_col: str) -> DataFrame:
    return df.withColumn("_y", F.col(label_col).cast("double"))


def fit_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                   num_features: int = 1 << 18, **params) -> PipelineModel:
    features = feature_pipeline(num_features, text_col).fit(train)
    data = staged(features.transform(_with_y(train, label_col)).select("_features", "_y"), "fit-features")
    return PipelineModel([*features.stages, fitted(data, **params)])


def score_with(model: PipelineModel, df: DataFrame, score_col: str = "score") -> DataFrame:
    """Positive-class probability as ``score`` (input columns kept); a text
    without a word token has no score (null), like the reference refuses it."""
    out = model.transform(df)
    p = F.when(F.size("_tokens") > 0, vector_to_array("probability")[1])
    return out.select(*df.columns, p.alias(score_col))


def select_best(train: DataFrame, val: DataFrame, grid: Sequence[dict],
                text_col: str = "text", label_col: str = "label", threshold: float = 0.5):
    """Fit every candidate and keep the first with the best validation
    accuracy. Returns (best_model, best_params, DataFrame of all results).

    Features are fitted and written once per ``num_features``; each fit is a
    distributed job, the loop is over the (small) grid only.
    """
    best, best_acc, best_p, rows, made = None, -1.0, None, [], {}
    for i, p in enumerate(grid):
        own = dict(p)
        n = own.pop("num_features", 1 << 18)
        if n not in made:
            f = feature_pipeline(n, text_col).fit(train)
            made[n] = f, staged(f.transform(_with_y(train, label_col)).select("_features", "_y"), "fit-features")
        f, data = made[n]
        m = PipelineModel([*f.stages, fitted(data, **own)])
        s = score_with(m, val)
        acc = s.agg(F.avg((F.col(label_col) == hard_pred("score", threshold))
                          .cast("double")).alias("a")).first()["a"] or 0.0
        rows.append((i, str(p), float(acc)))
        if acc > best_acc:
            best, best_acc, best_p = m, acc, p
    res = train.sparkSession.createDataFrame(rows, "candidate int, params string, val_accuracy double")
    return best, best_p, res


SWEEP = ("run_id string, num_features int, reg_param double, elastic_net double, test_accuracy double, test_loss double, "
         "test_roc_auc double, test_f1_weighted double, test_f1_macro double, status string, reason string")


class SweepAborted(RuntimeError):
    """A run failed under ``on_error="abort"``; ``results`` has a row a run, as ``run_sweep`` gives them."""

    def __init__(self, reason: str, results: DataFrame):
        super().__init__(reason)
        self.results = results


def run_sweep(train: DataFrame, test: DataFrame, plan: DataFrame, on_error: str = "skip",
              dry_run: bool = False, at_once: int = 4) -> DataFrame:
    """Fit every run of ``plan`` (see ``runs.fit_plan``) and report its
    test metrics, a row a run with ``status`` ("ok", "failed", "cancelled",
    "planned") and, if it failed, the reason.

    Up to ``at_once`` runs are fitted side by side; all their jobs carry one
    tag. A failed run leaves its row and the others go on
    (``on_error="skip"``), or the jobs of the tag are cancelled, runs not
    begun stay so, and ``SweepAborted`` is raised ("abort"). ``dry_run`` fits
    nothing. Features are fitted and written once per ``num_features``. The
    grid is a few rows; every fit is a distributed job.
    """
    if on_error not in ("skip", "abort"):
        raise ValueError("on_error is 'skip' or 'abort'")
    spark = train.sparkSession
    sc = spark.sparkContext
    tag, stop, made, lock = f"sweep-{uuid.uuid4().hex[:12]}", threading.Event(), {}, threading.Lock()
    runs = plan.orderBy("grid_idx").select("run_id", "num_features", "reg_param", "elastic_net").collect()
    held = test.select("label", "text")

    def features(n):
        """The feature model and written training features of ``n`` features: one run makes them, the others wait."""
        with lock:
            mine = n not in made
            one = made.setdefault(n, Future())
        if mine:
            try:
                f = feature_pipeline(n).fit(train)
                one.set_result((f, staged(f.transform(_with_y(train, "label")).select("_features", "_y"), "fit-features")))
            except Exception as e:
                one.set_exception(e)
        return one.result()

    def fit(run):
        none = (None,) * 5
        if dry_run or stop.is_set():
            return (*run, *none, "planned" if dry_run else "cancelled", None)
        sc.addJobTag(tag)
        try:
            f, data = features(run["num_features"])
            m = PipelineModel([*f.stages, fitted(data, reg_param=run["reg_param"], elastic_net=run["elastic_net"])])
            e = evaluate(staged(score_with(m, held).select("label", "score"), "sweep-scores")).first()
        except Exception as e:
            reason = f"{type(e).__name__}: {e}".splitlines()[0][:500]
            if stop.is_set():
                return (*run, *none, "cancelled", reason)
            if on_error == "abort":
                stop.set()
                sc.cancelJobsWithTag(tag)
            return (*run, *none, "failed", reason)
        finally:
            sc.removeJobTag(tag)
        auc = None if e["roc_auc"] != e["roc_auc"] else e["roc_auc"]
        return (*run, e["accuracy"], e["loss"], auc, e["f1_weighted"], e["f1_macro"], "ok", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        # each thread is a Spark thread of its own, so that tags do not mix
        rows = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit), r) for r in runs]]
    results = leaderboard(spark.createDataFrame(rows, SWEEP))
    failed = next((r for r in rows if r[-2] == "failed"), None)
    if failed and on_error == "abort":
        raise SweepAborted(f"run {failed[0]}: {failed[-1]}", results)
    return results


def batch_scorer(make_predict_fn: Callable, batch_size: int = 16,
                 input_len: int | None = None) -> Callable[[Column], Column]:
    """Wrap a predictor factory as a batched column function.

    ``make_predict_fn()`` runs once per Python worker and returns
    ``fn(ids: np.ndarray[batch, len]) -> np.ndarray[batch]`` of
    probabilities. Rows are fed in Arrow batches of ``batch_size``.
    """
    shape = [input_len] if input_len else None
    return predict_batch_udf(make_predict_fn, return_type=T.DoubleType(),
                             batch_size=int(batch_size),
                             input_tensor_shapes=[shape] if shape else None)


def token_weight_model(train_ids: DataFrame, ids_col: str = "input_ids",
                       label_col: str = "label", smoothing: float = 1.0) -> DataFrame:
    """A per-token-id weight table (log-count ratio between classes),
    learned with one distributed aggregation over exploded ids. Bounded by
    the vocabulary size, so it can be shipped to the predictor."""
    ex = train_ids.select(F.explode(ids_col).alias("tid"), label_col)
    c = ex.groupBy("tid").agg(F.count_if(F.col(label_col) == 1).alias("p"),
                              F.count_if(F.col(label_col) == 0).alias("n"))
    s = F.lit(float(smoothing))
    return c.withColumn("w", F.log((F.col("p") + s) / (F.col("n") + s)))


def linear_bag_predictor(weights: np.ndarray, special=(0, 2, 3)):
    """Predictor factory for ``batch_scorer``: mean token weight of the
    non-special ids through a sigmoid. ``weights`` is indexed by token id."""
    w = np.asarray(weights, dtype="float64")
    sp = np.asarray(special)

    def make():
        def predict(ids: np.ndarray) -> np.ndarray:
            ids = np.asarray(ids, dtype="int64")
            if ids.ndim == 1:
                ids = ids.reshape(1, -1)
            mask = ~np.isin(ids, sp)
            val = np.where(mask, w[np.clip(ids, 0, len(w) - 1)], 0.0)
            n = np.maximum(mask.sum(axis=1), 1)
            return 1.0 / (1.0 + np.exp(-(val.sum(axis=1) / n)))
        return predict
    return make
