"""Classifier fit/score and batched window scoring (rows-only checks)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.scores import hard_pred
from ..operators import evaluate as EV
from ..operators import score as SC
from ..operators import tokens as TK
from ..operators.split import stratified_split
from .catalog import register, stage
from .q_balance import SPLIT_CTES, balanced
from .q_tokens import MAX_LEN, STRIDE, VOCAB, VOCAB_CTES, vocab

GRID = ({"reg_param": 0.0}, {"reg_param": 0.1})


def splits(spark, sf_dir):
    return stage(spark, sf_dir, "splits",
                 lambda: stratified_split(balanced(spark, sf_dir), seed=42))


def test_scores(spark, sf_dir):
    def build():
        s = splits(spark, sf_dir)
        train, val, test = (s.filter(F.col("split") == x) for x in ("train", "val", "test"))
        model, _, _ = SC.select_best(train, val, GRID)
        return SC.score_with(model, test.select("seq", "text", "label"))
    return stage(spark, sf_dir, "clf_test_scores", build)


@register("classifier_test_scores")
def classifier_test_scores(spark, sf_dir):
    t = test_scores(spark, sf_dir)
    return t.select("seq", "label", "score", hard_pred("score").alias("pred"))


@register("classifier_test_metrics")
def classifier_test_metrics(spark, sf_dir):
    return EV.evaluate(test_scores(spark, sf_dir))


def _toks(src):
    return f"""SELECT seq, label, split, unnest(regexp_extract_all(lower(text), '{TK.TOKEN_RE}')) AS token,
  unnest(generate_series(1, len(regexp_extract_all(lower(text), '{TK.TOKEN_RE}')))) AS pos FROM {src}"""


@register("window_model_scores", f"""WITH {SPLIT_CTES},
{VOCAB_CTES},
stoks AS ({_toks("splitted")}),
sids AS (SELECT t.seq, t.label, t.split, t.pos, coalesce(v.id, 1) AS tid FROM stoks t LEFT JOIN vocab v ON t.token = v.token),
w AS (SELECT tid, ln((count(*) FILTER (WHERE label = 1) + 1.0) / (count(*) FILTER (WHERE label = 0) + 1.0)) AS w
  FROM sids WHERE split = 'train' GROUP BY tid),
tids AS (SELECT s.seq, coalesce(list(i.tid ORDER BY i.pos) FILTER (WHERE i.tid IS NOT NULL), []) AS ids
  FROM splitted s LEFT JOIN sids i ON i.seq = s.seq WHERE s.split = 'test' GROUP BY s.seq),
ts AS (SELECT seq, ids, CASE WHEN len(ids) <= {MAX_LEN - 2} THEN [0] ELSE generate_series(0,
  CAST(ceil((len(ids) - {MAX_LEN - 2}) / {MAX_LEN - 2 - STRIDE}) AS BIGINT) * {MAX_LEN - 2 - STRIDE}, {MAX_LEN - 2 - STRIDE}) END AS starts FROM tids),
tw AS (SELECT seq, s, list_slice(ids, s + 1, s + {MAX_LEN - 2}) AS win FROM (SELECT seq, ids, unnest(starts) AS s FROM ts)),
tv AS (SELECT seq, s, unnest(win) AS tid FROM tw),
tc AS (SELECT tv.seq, tv.s, 1.0 / (1.0 + exp(-(sum(coalesce(w.w, 0.0)) / count(*)))) AS score
  FROM tv LEFT JOIN w ON w.tid = tv.tid GROUP BY tv.seq, tv.s)
SELECT seq, round(least(1.0, greatest(0.0, avg(score))), 9) AS score, count(*) AS n_chunks FROM tc GROUP BY seq""")
def window_model_scores(spark, sf_dir):
    """Train split -> token weights; test reviews -> sliding windows ->
    batched predictor -> mean per review (O72-O74 with O80). A review
    without a word token is not scored."""
    s = splits(spark, sf_dir)
    v = vocab(spark, sf_dir)
    ids = stage(spark, sf_dir, "split_ids", lambda: TK.token_ids(s, v, id_col="seq").join(
        s.select("seq", "label", "split"), "seq")).where(F.size("ids") > 0)
    w = SC.token_weight_model(ids.filter(F.col("split") == "train"), ids_col="ids")
    # bounded by the vocabulary size (VOCAB + specials): safe to ship
    rows = w.toPandas()
    table = np.zeros(VOCAB + 5)
    table[rows["tid"].to_numpy()] = rows["w"].to_numpy()
    scorer = SC.batch_scorer(SC.linear_bag_predictor(table), batch_size=16,
                             input_len=MAX_LEN)
    win = TK.sliding_windows(ids.filter(F.col("split") == "test"), MAX_LEN, STRIDE,
                             id_col="seq")
    chunk = win.select("seq", scorer(F.col("input_ids")).alias("score"))
    return TK.document_scores(chunk, id_col="seq").withColumn("score", F.round("score", 9))


TRAIN_FEATURES = 1 << 16
#: Training rows a mini-batch, about.
BATCH_ROWS = 50_000


def trained(spark, sf_dir):
    """The folder of a run trained by epochs on the train split."""
    from ..operators import train as TR
    from ..session import scratch_path
    key = (id(spark), sf_dir)
    if key not in _RUNS:
        s = splits(spark, sf_dir)
        train = s.where("split = 'train'")
        out = scratch_path(spark, f"train-{uuid.uuid4().hex[:8]}")
        TR.train_epochs(train, s.where("split = 'val'"), out, num_features=TRAIN_FEATURES,
                        buckets=max(4, train.count() // BATCH_ROWS), epochs=(2, 4))
        _RUNS[key] = out
    return _RUNS[key]


_RUNS: dict = {}


@register("training_epochs")
def training_epochs(spark, sf_dir):
    """O84 by epochs, its log rolled up (O86) beside validation accuracy and
    what the rule of the best epoch (O87) makes of it. SQL cannot express
    the fit; tests/test_train.py holds it against a numpy run."""
    from ..operators import runs as R
    from ..operators import train as TR
    out = trained(spark, sf_dir)
    states = TR.epoch_states(spark, out).select("epoch", "phase", F.col("accuracy").alias("val_accuracy"))
    epochs = R.epoch_rollup(TR.batch_log(spark, out)).join(states, "epoch")
    rule = R.best_and_stop(epochs.select("run_id", "epoch", F.col("val_accuracy").alias("accuracy")), frozen_epochs=2)
    return epochs.join(rule.select("run_id", "best_epoch", "stop_epoch"), "run_id")


@register("trained_test_metrics")
def trained_test_metrics(spark, sf_dir):
    """The best epoch's checkpoint scored on the test split."""
    from ..operators import train as TR
    out = trained(spark, sf_dir)
    test = splits(spark, sf_dir).where("split = 'test'").select("seq", "text", "label")
    return EV.evaluate(TR.scored(test, TR.best_model(spark, out, TRAIN_FEATURES)).select("label", "score"))
