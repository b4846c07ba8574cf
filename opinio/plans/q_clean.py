"""Cleaning slice: raw reviews -> clean reviews, report, loader variant."""

from __future__ import annotations

from ..operators import clean as C
from ..schema import NA_TOKENS
from ..sources.fixtures import reviews_negatives, reviews_raw
from . import sqlparts as S
from .catalog import register

_CLEAN_SQL = f"WITH {S.clean_ctes(25)}\nSELECT seq, entity_id, text, label, marker FROM clean"


@register("clean_reviews", _CLEAN_SQL)
def clean_reviews(spark, sf_dir):
    return C.clean_reviews(reviews_raw(spark, sf_dir), min_chars=25)


@register("clean_negatives", f"WITH {S.clean_neg_ctes(25)}\nSELECT seq, entity_id, text, label, marker FROM clean_neg")
def clean_negatives(spark, sf_dir):
    """The second input of the cleaning run."""
    return C.clean_reviews(reviews_negatives(spark, sf_dir), min_chars=25)


_REPORT_SQL = f"""WITH {S.REVIEWS_RAW},
flags AS (
  SELECT entity_id IS NULL OR text IS NULL OR label IS NULL AS is_null,
         lower({S.strip('text')}) AS t, {S.label('label')} AS lab
  FROM reviews_raw),
raw AS (
  SELECT count(*) AS rows_in,
    count(*) FILTER (WHERE is_null) AS dropped_null,
    count(*) FILTER (WHERE NOT is_null AND t = '') AS dropped_empty,
    count(*) FILTER (WHERE NOT is_null AND t <> '' AND lab IS NULL) AS dropped_label,
    count(*) FILTER (WHERE NOT is_null AND t <> '' AND lab IS NOT NULL
                     AND length(t) < 25) AS dropped_short
  FROM flags),
{S.filtered('reviews_raw', 25)},
groups AS (
  SELECT count(*) AS n, arg_min(label, seq) AS first_label,
         min(label) <> max(label) AS conflict
  FROM filtered GROUP BY entity_id, {S.norm('text')}),
grp AS (
  SELECT count(*) AS rows_out,
    count(*) FILTER (WHERE first_label = 1) AS positives,
    count(*) FILTER (WHERE first_label = 0) AS negatives,
    count(*) FILTER (WHERE conflict) AS label_conflicts,
    CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_dup_groups,
    CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dropped_duplicate
  FROM groups)
SELECT rows_in, rows_out, rows_in - rows_out AS rows_removed, positives, negatives,
  CASE WHEN rows_out = 0 THEN 0.0 ELSE positives * 100.0 / rows_out END AS pct_positive,
  CASE WHEN rows_out = 0 THEN 0.0 ELSE negatives * 100.0 / rows_out END AS pct_negative,
  dropped_null, dropped_empty, dropped_label, dropped_short, dropped_duplicate,
  rows_in_dup_groups, label_conflicts
FROM raw, grp"""


@register("cleaning_report", _REPORT_SQL)
def cleaning_report(spark, sf_dir):
    return C.cleaning_report(reviews_raw(spark, sf_dir), min_chars=25)


@register("cleaning_run_report", _REPORT_SQL)
def cleaning_run_report(spark, sf_dir):
    """The report of a cleaning run that writes its rows and scans its input once."""
    import uuid

    from ..session import scratch_path
    return C.clean_and_report(reviews_raw(spark, sf_dir), scratch_path(spark, f"clean-run-{uuid.uuid4().hex[:8]}"))


#: Rows of a CSV file, about: a multi-line file is read by one task.
CSV_ROWS = 10_000


def _csv_roundtrip(spark, sf_dir):
    import uuid

    from ..session import scratch_path
    from ..sources.files import read_reviews_csv, write_reviews_csv
    from .catalog import stage

    def build():
        p = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
        raw = reviews_raw(spark, sf_dir)
        # part files in the order of seq, so that the order of the files is known
        write_reviews_csv(raw.repartitionByRange(max(4, -(-raw.count() // CSV_ROWS)), "seq").sortWithinPartitions("seq"), p)
        return read_reviews_csv(spark, p, ["entity_id", "text", "label"], ordinal="file_order")
    return stage(spark, sf_dir, "csv_roundtrip", build)


_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


@register("csv_roundtrip", f"""WITH {S.REVIEWS_RAW}
SELECT CAST(seq AS VARCHAR) AS seq, row_number() OVER (ORDER BY reviews_raw.seq) - 1 AS file_order,
  CASE WHEN entity_id IN ({_NA}) THEN NULL ELSE entity_id END AS entity_id,
  CASE WHEN text IN ({_NA}) THEN NULL ELSE text END AS text,
  CASE WHEN label IN ({_NA}) THEN NULL ELSE label END AS label,
  CASE WHEN marker IN ({_NA}) THEN NULL ELSE marker END AS marker FROM reviews_raw""")
def csv_roundtrip(spark, sf_dir):
    """O01 + O04: quote-all CSV written and read back as text columns, in file order."""
    return _csv_roundtrip(spark, sf_dir).select("seq", "file_order", "entity_id", "text", "label", "marker")


@register("csv_mixed_headers", f"""WITH {S.REVIEWS_RAW}
SELECT CAST(seq AS VARCHAR) AS seq,
  CASE WHEN entity_id IN ({_NA}) THEN NULL ELSE entity_id END AS entity_id,
  CASE WHEN text IN ({_NA}) THEN NULL ELSE text END AS text,
  CASE WHEN label IN ({_NA}) THEN NULL ELSE label END AS label FROM reviews_raw""")
def csv_mixed_headers(spark, sf_dir):
    """One folder whose files name their columns in two orders."""
    import uuid

    from ..session import scratch_path
    from ..sources.files import CSV_WRITE, read_reviews_csv
    from .catalog import stage

    def build():
        p = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
        raw = reviews_raw(spark, sf_dir)
        raw.where("seq % 2 = 0").select("seq", "entity_id", "text", "label").write.options(**CSV_WRITE).csv(p)
        raw.where("seq % 2 = 1").select("label", "text", "entity_id", "seq").write.options(**CSV_WRITE).mode("append").csv(p)
        return read_reviews_csv(spark, p, ["entity_id", "text", "label"], ordinal="file_order")
    return stage(spark, sf_dir, "csv_mixed", build).select("seq", "entity_id", "text", "label")


@register("labelled_rows", f"""WITH {S.REVIEWS_RAW},
t AS (SELECT seq, entity_id, {S.strip('text')} AS text, {S.label('label')} AS label
      FROM reviews_raw WHERE text IS NOT NULL AND label IS NOT NULL)
SELECT seq, entity_id, text, label FROM t WHERE text <> '' AND label IS NOT NULL""")
def labelled_rows(spark, sf_dir):
    """The training/evaluation loader (strip without lower-casing, no
    length rule, no dedupe, entity not required)."""
    return C.load_labelled(reviews_raw(spark, sf_dir)).select("seq", "entity_id", "text", "label")
