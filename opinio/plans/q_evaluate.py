"""Scoring bands, evaluation metrics and error mining on the scored fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import band, clip01, hard_pred, sigmoid
from ..operators import evaluate as EV
from ..schema import METRICS
from ..sources.fixtures import deterministic_score
from . import sqlparts as S
from .catalog import register, stage
from .q_balance import BAL_CTES, balanced

BATCH = 16


def scored(spark, sf_dir):
    """Balanced reviews with a deterministic score and a batch id (FIXTURES §4)."""
    return stage(spark, sf_dir, "scored", lambda: balanced(spark, sf_dir).select(
        "seq", "entity_id", "text", "label", "ord",
        F.floor(F.col("ord") / BATCH).alias("batch_id"),
        deterministic_score("label", "seq").alias("score")))


SCORED_CTES = f"""{BAL_CTES},
scored AS (SELECT seq, entity_id, text, label, ord,
  CAST(floor(ord / {BATCH}) AS BIGINT) AS batch_id,
  round(least(1.0, greatest(0.0, 0.25 + 0.5 * label
    + (CAST(CAST('0x' || substring(md5(CAST(seq AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)
       / 4294967296.0 - 0.5) * 0.9)), 2) AS score
  FROM bal)"""


def _d(x):
    return f"CAST({x} AS DOUBLE)"


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE {_d(a)} / {_d(b)} END)"


METRICS_SQL = f"""WITH {SCORED_CTES},
c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
  count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
  count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp,
  count(*) AS n FROM scored),
m AS (SELECT *, {_div('tn + tp', 'n')} AS accuracy,
  {_div('tn', 'tn + fn')} AS precision_neg, {_div('tn', 'tn + fp')} AS recall_neg,
  {_div('2 * tn', '2 * tn + fp + fn')} AS f1_neg,
  {_div('tp', 'tp + fp')} AS precision_pos, {_div('tp', 'tp + fn')} AS recall_pos,
  {_div('2 * tp', '2 * tp + fp + fn')} AS f1_pos FROM c),
m2 AS (SELECT *,
  {' , '.join(f"{_div(f'{x}_neg * (tn + fp) + {x}_pos * (fn + tp)', 'n')} AS {x}_weighted, ({x}_neg + {x}_pos) / 2.0 AS {x}_macro" for x in ('precision', 'recall', 'f1'))}
  FROM m),
per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
acc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
auc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  sum({_d('pos')} * ({_d('below')} + {_d('neg')} / 2.0)) / ({_d('sum(pos)')} * {_d('sum(neg)')})
  ELSE 'nan'::DOUBLE END AS roc_auc FROM acc),
bl AS (SELECT batch_id, label,
  -(label * ln(least(1 - 1e-15, greatest(1e-15, score)))
    + (1 - label) * ln(1 - least(1 - 1e-15, greatest(1e-15, score)))) AS l FROM scored),
lo AS (SELECT round(avg(l), 12) AS log_loss FROM bl),
lb AS (SELECT round(avg(bm), 12) AS loss FROM (SELECT avg(l) AS bm FROM bl GROUP BY batch_id))
SELECT n, tn, fp, fn, tp, accuracy, precision_neg, recall_neg, f1_neg,
  precision_pos, recall_pos, f1_pos, precision_weighted, recall_weighted, f1_weighted,
  precision_macro, recall_macro, f1_macro, roc_auc, log_loss, loss, fp + fn AS n_errors, CAST(0 AS BIGINT) AS n_unscored
FROM m2, auc, lo, lb"""


@register("evaluation_metrics", METRICS_SQL)
def evaluation_metrics(spark, sf_dir):
    return EV.evaluate(scored(spark, sf_dir), batch_col="batch_id")


@register("score_bands", f"""WITH {SCORED_CTES}
SELECT seq, label, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred,
  CASE WHEN score >= 0.6 THEN 'positive' WHEN score <= 0.45 THEN 'negative'
       ELSE 'mixed' END AS band,
  CASE WHEN score >= 0.6 THEN least(1.0, greatest(0.0, score)) * 100.0
       WHEN score <= 0.45 THEN 100.0 - least(1.0, greatest(0.0, score)) * 100.0
  END AS confidence_pct,
  least(1.0, greatest(0.0, score)) * 100.0 AS positivity_pct
FROM scored""")
def score_bands(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("seq", "label", "score", hard_pred("score").alias("pred"),
                    band("score", 0.45, 0.60).alias("b")).select(
        "seq", "label", "score", "pred", "b.band", "b.confidence_pct",
        "b.positivity_pct")


@register("sigmoid_probabilities", f"""WITH {SCORED_CTES}
SELECT seq, (score - 0.5) * 8.0 AS logit,
  round(least(1.0, greatest(0.0, 1.0 / (1.0 + exp(-((score - 0.5) * 8.0))))), 12) AS prob
FROM scored""")
def sigmoid_probabilities(spark, sf_dir):
    s = scored(spark, sf_dir).select(
        "seq", ((F.col("score") - F.lit(0.5)) * F.lit(8.0)).alias("logit"))
    return s.withColumn("prob", F.round(clip01(sigmoid("logit")), 12))


ERR_SQL = f"""{SCORED_CTES},
err AS (SELECT seq, label AS label_real,
  CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS label_pred, score AS score_positive,
  CASE WHEN score >= 0.5 THEN score ELSE 1.0 - score END AS error_confidence,
  CAST(length(text) AS INTEGER) AS length_chars, text
  FROM scored WHERE label <> CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)"""


@register("error_rows", f"WITH {ERR_SQL}\nSELECT * FROM err")
def error_rows(spark, sf_dir):
    return EV.error_rows(scored(spark, sf_dir))


@register("top_errors", f"""WITH {ERR_SQL}
SELECT * FROM err ORDER BY error_confidence DESC, seq LIMIT 500""")
def top_errors(spark, sf_dir):
    return EV.top_errors(scored(spark, sf_dir))


@register("error_count", f"""WITH {ERR_SQL}
SELECT count(*) AS n_errors FROM err""")
def error_count(spark, sf_dir):
    return EV.error_count(scored(spark, sf_dir))


PRF = [f"{c}_{m}" for c in ("neg", "pos", "weighted", "macro") for m in ("precision", "recall", "f1")]


def _flat_doc(docs):
    """The fields of metrics documents side by side."""
    def prf(name, field):
        return [F.col(f"{field}.{m}").alias(f"{name}_{m}") for m in ("precision", "recall", "f1")]
    return docs.select(
        "loss", "accuracy", "roc_auc", *prf("neg", "per_class.negative"), *prf("pos", "per_class.positive"),
        *prf("weighted", "weighted"), *prf("macro", "macro"),
        *[F.col("confusion_matrix")[i][j].alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))],
        "n_errors", "n_test")


def _doc_sql(standalone):
    def named(c):
        side, m = c.split("_")
        return f"{m}_{side} AS {c}" if not (standalone and side == "macro") else f"CAST(NULL AS DOUBLE) AS {c}"
    only = "n_errors, n AS n_test" if standalone else "CAST(NULL AS BIGINT) AS n_errors, CAST(NULL AS BIGINT) AS n_test"
    return (f"SELECT {'CAST(NULL AS DOUBLE) AS loss' if standalone else 'loss'}, accuracy, roc_auc, "
            f"{', '.join(map(named, PRF))}, tn, fp, fn, tp, {only} FROM ({METRICS_SQL})")


@register("metrics_document", _doc_sql(False))
def metrics_document(spark, sf_dir):
    """The nested metrics document, parsed back from its JSON text, field by field."""
    doc = EV.metrics_document(EV.evaluate(scored(spark, sf_dir), batch_col="batch_id"))
    return _flat_doc(doc.select(F.from_json("json", METRICS).alias("m")).select("m.*"))


@register("metrics_json_roundtrip", _doc_sql(True))
def metrics_json_roundtrip(spark, sf_dir):
    """Standalone metrics document written as JSON and read back."""
    import uuid

    from ..session import scratch_path
    from ..sources.files import read_metrics_json, write_metrics_json

    def build():
        p = scratch_path(spark, f"metrics-{uuid.uuid4().hex[:8]}")
        write_metrics_json(EV.metrics_document(EV.evaluate(scored(spark, sf_dir)),
                                               standalone=True), p)
        return read_metrics_json(spark, p)
    return _flat_doc(stage(spark, sf_dir, "metrics_json", build))


@register("saturated_auc", f"""WITH {SCORED_CTES},
sat AS (SELECT label, 1.0 / (1.0 + exp(-(14.0 + score * 6.0 + (seq % 97) / 970.0))) AS score FROM scored),
per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label = 0) AS neg FROM sat GROUP BY score),
acc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
SELECT round(sum({_d('pos')} * ({_d('below')} + {_d('neg')} / 2.0)) / ({_d('sum(pos)')} * {_d('sum(neg)')}), 6) AS roc_auc FROM acc""")
def saturated_auc(spark, sf_dir):
    """Sigmoid scores that all lie close to 1."""
    s = scored(spark, sf_dir).select("label", (F.lit(1.0) / (F.lit(1.0) + F.exp(
        -(F.lit(14.0) + F.col("score") * 6.0 + (F.col("seq") % 97) / F.lit(970.0))))).alias("score"))
    return EV.roc_auc(s).select(F.round("roc_auc", 6).alias("roc_auc"))
