"""Evaluation (O90-O97) and error mining (O98-O100).

Two passes over the rows give everything: one aggregates the confusion
counts and the losses per batch, the other the table of distinct scores
that ROC-AUC needs. Rows without a score (null, NaN) are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hard_pred, is_score
from ..session import small, staged

EPS = 1e-15
#: Losses are rounded so that they do not depend on the order of partial sums.
LOSS_DIGITS = 12


def _div(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 when b == 0 (sklearn ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _cells(label: str, score: str, threshold: float) -> list[Column]:
    """The cells of the confusion matrix, rows = real, cols = predicted."""
    pred, y = hard_pred(score, threshold), F.col(label)
    return [F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
            F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp"),
            F.count_if(pred.isNotNull()).alias("n"), F.count_if(pred.isNull()).alias("n_unscored")]


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = 0.5) -> DataFrame:
    """O91 as one row (tn, fp, fn, tp, n, n_unscored); n counts the scored rows."""
    return df.agg(*_cells(label, score, threshold))


def derived_metrics(c: DataFrame) -> DataFrame:
    """O90, O92-O94 from (tn, fp, fn, tp, n)."""
    tn, fp, fn, tp, n = (F.col(x) for x in ("tn", "fp", "fn", "tp", "n"))
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    s0, s1 = tn + fp, fn + tp
    out = (c.withColumn("accuracy", _div(tn + tp, n))
            .withColumn("precision_neg", p0).withColumn("recall_neg", r0)
            .withColumn("precision_pos", p1).withColumn("recall_pos", r1))
    # count form 2TP/(2TP+FP+FN): bit-equal to the recorded values
    out = (out.withColumn("f1_neg", _div(F.lit(2) * tn, F.lit(2) * tn + fp + fn))
              .withColumn("f1_pos", _div(F.lit(2) * tp, F.lit(2) * tp + fp + fn)))
    for m in ("precision", "recall", "f1"):
        a, b = F.col(f"{m}_neg"), F.col(f"{m}_pos")
        out = out.withColumn(
            f"{m}_weighted",
            _div(a * s0.cast("double") + b * s1.cast("double"), s0 + s1))
        out = out.withColumn(f"{m}_macro", (a + b) / F.lit(2.0))
    return out


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC with ties (Mann-Whitney), NaN if a class is absent.

    Distinct scores are grouped (partial aggregation absorbs hot scores) and
    dealt out in ranges of about equally many scores, however they cluster.
    The negatives below a range come from the small table of ranges, those
    below a score within it from a window over that range.
    """
    s = F.col(score).cast("double")
    per = df.where(is_score(score)).groupBy(s.alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg"))
    # written with its range, so that both uses below see the same ranges
    per = staged(per.repartitionByRange("_s").withColumn("_bk", F.spark_partition_id()), "auc-scores")
    bt = per.groupBy("_bk").agg(F.sum("_neg").alias("_bneg"))
    # one row per range: one small ordered pass
    wb = Window.partitionBy().orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("_bk", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)).alias("_off"))
    wi = (Window.partitionBy("_bk").orderBy("_s")
          .rowsBetween(Window.unboundedPreceding, -1))
    per = (per.join(small(staged(bt, "auc-ranges")), "_bk")
              .withColumn("_below", F.col("_off")
                          + F.coalesce(F.sum("_neg").over(wi), F.lit(0))))
    term = F.col("_pos").cast("double") * (F.col("_below").cast("double")
                                           + F.col("_neg").cast("double") / F.lit(2.0))
    agg = per.agg(F.sum(term).alias("_u"), F.sum("_pos").alias("_p"),
                  F.sum("_neg").alias("_q"))
    return agg.select(
        F.when((F.col("_p") > 0) & (F.col("_q") > 0),
               F.col("_u") / (F.col("_p").cast("double") * F.col("_q").cast("double")))
         .otherwise(F.lit(float("nan"))).alias("roc_auc"))


def bce(label: str = "label", score: str = "score") -> Column:
    p = F.least(F.lit(1.0 - EPS), F.greatest(F.lit(EPS), F.col(score).cast("double")))
    y = F.col(label).cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def log_loss(df: DataFrame, label: str = "label", score: str = "score",
             batch_col: str | None = None, digits: int = LOSS_DIGITS) -> DataFrame:
    """Row-mean log-loss and, with ``batch_col``, the mean of batch
    means (a short last batch weighs as much as a full one).

    Rounded to ``digits`` places so the value does not depend on the order
    floating-point partial sums are combined in (partitioning).
    """
    d = df.where(is_score(score)).withColumn("_l", bce(label, score))
    row = d.agg(F.round(F.avg("_l"), digits).alias("log_loss"))
    if batch_col is None:
        return row.withColumn("loss", F.col("log_loss"))
    per = d.groupBy(batch_col).agg(F.avg("_l").alias("_bl"))
    bat = per.agg(F.round(F.avg("_bl"), digits).alias("loss"))
    return _stack([row, bat])


def _stack(parts) -> DataFrame:
    """Fold several one-row frames with disjoint columns into one row."""
    cols = [c for p in parts for c in p.columns]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def evaluate(df: DataFrame, label: str = "label", score: str = "score",
             threshold: float = 0.5, batch_col: str | None = None) -> DataFrame:
    """O90-O96 + O100 as one flat row."""
    cells = _cells(label, score, threshold)
    names = ["tn", "fp", "fn", "tp", "n", "n_unscored"]
    d = df.withColumn("_l", F.when(is_score(score), bce(label, score)))
    per = d.groupBy(*([batch_col] if batch_col else [])).agg(
        *cells, F.sum("_l").alias("_sum"), F.avg("_l").alias("_mean"))
    c = per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names],
                F.round(F.sum("_sum") / F.sum("n"), LOSS_DIGITS).alias("log_loss"),
                F.round(F.avg("_mean"), LOSS_DIGITS).alias("_batches"))
    c = derived_metrics(c).withColumn("loss", F.col("_batches") if batch_col else F.col("log_loss")) \
        .withColumn("n_errors", F.col("fp") + F.col("fn"))
    # max() of a NaN roc_auc stays NaN
    out = _stack([c, roc_auc(df, label, score)])
    return out.select(*METRIC_COLUMNS)


METRIC_COLUMNS = [
    "n", "tn", "fp", "fn", "tp", "accuracy",
    "precision_neg", "recall_neg", "f1_neg",
    "precision_pos", "recall_pos", "f1_pos",
    "precision_weighted", "recall_weighted", "f1_weighted",
    "precision_macro", "recall_macro", "f1_macro",
    "roc_auc", "log_loss", "loss", "n_errors", "n_unscored"]


def metrics_document(flat: DataFrame, standalone: bool = False) -> DataFrame:
    """Nested metrics struct plus its JSON text, one row.

    The training variant carries loss and macro; the standalone one carries
    n_errors and n_test instead.
    """
    def prf(sfx):
        return F.struct(*[F.col(f"{m}_{sfx}").alias(m)
                          for m in ("precision", "recall", "f1")])
    cm = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    fields = [
        (F.lit(None).cast("double") if standalone else F.col("loss")).alias("loss"),
        F.col("accuracy"), F.col("roc_auc"),
        F.struct(prf("neg").alias("negative"),
                 prf("pos").alias("positive")).alias("per_class"),
        prf("weighted").alias("weighted"),
        (F.lit(None).cast("struct<precision:double,recall:double,f1:double>")
         if standalone else prf("macro")).alias("macro"),
        cm.alias("confusion_matrix"),
        (F.col("n_errors") if standalone else F.lit(None).cast("long")).alias("n_errors"),
        (F.col("n") if standalone else F.lit(None).cast("long")).alias("n_test"),
    ]
    doc = F.struct(*fields)
    return flat.select(doc.alias("metrics"),
                       F.to_json(doc, {"ignoreNullFields": "true"}).alias("json"))


def error_rows(df: DataFrame, label: str = "label", score: str = "score",
               text: str = "text", threshold: float = 0.5,
               order: str = "seq") -> DataFrame:
    """Misclassified rows with the error's confidence and text length."""
    pred = hard_pred(score, threshold)
    s = F.col(score).cast("double")
    return (df.withColumn("_pred", pred)
              .filter(F.col(label) != F.col("_pred"))
              .select(F.col(order),
                      F.col(label).cast("int").alias("label_real"),
                      F.col("_pred").cast("int").alias("label_pred"),
                      s.alias("score_positive"),
                      F.when(F.col("_pred") == 1, s).otherwise(F.lit(1.0) - s)
                       .alias("error_confidence"),
                      F.length(text).alias("length_chars"),
                      F.col(text).alias("text")))


def top_errors(df: DataFrame, k: int = 500, order: str = "seq", **kw) -> DataFrame:
    """The k most confident errors, ties in input order.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: a per-partition
    top-k then a k-row merge, never a full sort.
    """
    e = error_rows(df, order=order, **kw)
    return e.orderBy(F.desc("error_confidence"), F.col(order)).limit(int(k))


def error_count(df: DataFrame, label: str = "label", score: str = "score",
                threshold: float = 0.5) -> DataFrame:
    """O100: total errors beside the capped export."""
    return df.agg(F.count_if(F.col(label) != hard_pred(score, threshold))
                  .alias("n_errors"))
