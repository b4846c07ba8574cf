"""Review cleaning (O30-O41) and the cleaning report.

Order matters and is kept: null drop, strip(+lower), empty drop, label
coercion, minimum length, then keep-first on (entity, normalised text).
Length and label filters run before the dedupe so the same row survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import coerce_label, ustrip
from .dedupe import first_rows, keep_first, numbered, with_review_key


def require_columns(df: DataFrame, required, name: str = "input") -> None:
    """Fail with the sorted list of missing columns (O03); no job runs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns in {name}: {missing}")


def filter_reviews(df: DataFrame, text_col: str = "text",
                   label_col: str = "label", entity_col: str | None = "entity_id",
                   min_chars: int = 0, lower: bool = True) -> DataFrame:
    """Null drop, strip/lower, empty drop, label coercion, length."""
    need = [c for c in (entity_col, text_col, label_col) if c]
    require_columns(df, need)
    t = ustrip(text_col)
    if lower:
        t = F.lower(t)
    out = (df.dropna(subset=need)
             .withColumn(text_col, t)
             .filter(F.col(text_col) != "")
             .withColumn(label_col, coerce_label(label_col))
             .filter(F.col(label_col).isNotNull()))
    if min_chars:
        out = out.filter(F.length(text_col) >= F.lit(int(min_chars)))
    return out


def normalise_marker(df: DataFrame, marker_col: str = "marker") -> DataFrame:
    """Strip + lower the optional marker column when present."""
    if marker_col in df.columns:
        return df.withColumn(marker_col, F.lower(ustrip(marker_col)))
    return df


def clean_reviews(df: DataFrame, min_chars: int = 25, text_col: str = "text",
                  label_col: str = "label", entity_col: str = "entity_id",
                  marker_col: str = "marker", order_col: str = "seq") -> DataFrame:
    """The full cleaning job (O30-O38) returning the surviving rows."""
    f = filter_reviews(df, text_col, label_col, entity_col, min_chars, True)
    f = with_review_key(f, text_col, "_key", normalise="collapse")
    out = keep_first(f, [entity_col, "_key"], order_col).drop("_key")
    return normalise_marker(out, marker_col)


def load_labelled(df: DataFrame, text_col: str = "text",
                  label_col: str = "label") -> DataFrame:
    """Loader variant for training/evaluation (no lower, no dedupe)."""
    return filter_reviews(df, text_col, label_col, None, 0, lower=False)


def _pct(part, total):
    return F.when(total == 0, F.lit(0.0)).otherwise(
        part.cast("double") / total.cast("double") * F.lit(100.0))


def _dropped(min_chars: int, text_col: str, label_col: str, entity_col: str) -> list[Column]:
    """Counters over the raw rows: how many come in, and how many each step drops."""
    t = F.lower(ustrip(text_col))
    lab = coerce_label(label_col)
    null_ = (F.col(entity_col).isNull() | F.col(text_col).isNull()
             | F.col(label_col).isNull())
    empty = ~null_ & (t == "")
    badlab = ~null_ & ~empty & lab.isNull()
    short = ~null_ & ~empty & ~badlab & (F.length(t) < F.lit(int(min_chars)))
    return [F.count(F.lit(1)).alias("rows_in"),
            F.count_if(null_).alias("dropped_null"),
            F.count_if(empty).alias("dropped_empty"),
            F.count_if(badlab).alias("dropped_label"),
            F.count_if(short).alias("dropped_short")]


COUNTERS = ["rows_in", "dropped_null", "dropped_empty", "dropped_label",
            "dropped_short", "rows_out", "positives", "negatives",
            "label_conflicts", "rows_in_dup_groups", "dropped_duplicate"]


def _report_row(r: DataFrame) -> DataFrame:
    """The report out of one row of ``COUNTERS``."""
    return r.select(
        "rows_in", "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("rows_removed"),
        "positives", "negatives",
        _pct(F.col("positives"), F.col("rows_out")).alias("pct_positive"),
        _pct(F.col("negatives"), F.col("rows_out")).alias("pct_negative"),
        "dropped_null", "dropped_empty", "dropped_label", "dropped_short",
        "dropped_duplicate", "rows_in_dup_groups", "label_conflicts")


def clean_and_report(df: DataFrame, path: str, min_chars: int = 25, text_col: str = "text",
                     label_col: str = "label", entity_col: str = "entity_id",
                     marker_col: str = "marker", order_col: str = "seq") -> DataFrame:
    """O39 in the same run as the cleaning: writes the cleaned rows (those of
    ``clean_reviews``) to ``path`` and returns the one-row report.

    ``df`` is evaluated once. The counters over raw rows are observed on the
    write of the filtered ones, those over survivors on the final write; the
    duplicate groups come from the narrow columns of what was written.
    """
    spark, raw, final = df.sparkSession, Observation(), Observation()
    seen = df.observe(raw, *_dropped(min_chars, text_col, label_col, entity_col))
    f = filter_reviews(seen, text_col, label_col, entity_col, min_chars, True)
    rows = numbered(with_review_key(f, text_col, "_key", normalise="collapse"))
    out = first_rows(rows, [entity_col, "_key"], order_col).select(*df.columns)
    normalise_marker(out, marker_col).observe(
        final, F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col(label_col) == 1).alias("positives"),
        F.count_if(F.col(label_col) == 0).alias("negatives")).write.mode("overwrite").parquet(path)
    groups = rows.groupBy(entity_col, "_key").agg(
        F.count(F.lit(1)).alias("_n"), (F.min(label_col) != F.max(label_col)).alias("_conflict"))
    dup = groups.where("_n > 1").agg(
        F.count_if("_conflict").alias("label_conflicts"), F.sum("_n").alias("rows_in_dup_groups"),
        F.sum(F.col("_n") - 1).alias("dropped_duplicate")).first().asDict()
    found = {**raw.get, **final.get, **dup}
    counts = [tuple(int(found.get(c) or 0) for c in COUNTERS)]
    return _report_row(spark.createDataFrame(counts, ", ".join(f"{c} long" for c in COUNTERS)))


def cleaning_report(df: DataFrame, min_chars: int = 25, text_col: str = "text",
                    label_col: str = "label", entity_col: str = "entity_id",
                    order_col: str = "seq") -> DataFrame:
    """One row with the reference's counters plus a per-step funnel.

    Two single-pass aggregations (raw-row flags; key groups of the filtered
    rows) are stacked with ``unionByName`` and folded by one global agg.
    Survivor labels come from ``min_by(label, seq)`` inside the group agg,
    so the report needs no join back to the rows.
    """
    raw = df.agg(*_dropped(min_chars, text_col, label_col, entity_col))

    f = with_review_key(
        filter_reviews(df, text_col, label_col, entity_col, min_chars, True),
        text_col, "_key", normalise="collapse")
    groups = f.groupBy(entity_col, "_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(label_col, order_col).alias("_first_label"),
        (F.min(label_col) != F.max(label_col)).alias("_conflict"))
    grp = groups.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(F.col("_first_label") == 1).alias("positives"),
        F.count_if(F.col("_first_label") == 0).alias("negatives"),
        F.count_if("_conflict").alias("label_conflicts"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))),
                   F.lit(0)).cast("long").alias("rows_in_dup_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
         .alias("dropped_duplicate"))
    r = raw.unionByName(grp, allowMissingColumns=True).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    return _report_row(r)
