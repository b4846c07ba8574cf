"""Balancing and splitting over the cleaned review fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import clean as C
from ..operators import split as SP
from ..operators.dedupe import with_review_key, duplicate_rows
from ..sources.fixtures import reviews_negatives, reviews_raw
from . import sqlparts as S
from .catalog import register, stage

SEED = 42


def cleaned(spark, sf_dir):
    return stage(spark, sf_dir, "cleaned", lambda: C.clean_reviews(
        reviews_raw(spark, sf_dir), min_chars=25))


def cleaned_negatives(spark, sf_dir):
    return stage(spark, sf_dir, "cleaned_negatives", lambda: C.clean_reviews(
        reviews_negatives(spark, sf_dir), min_chars=25))


def balanced(spark, sf_dir):
    # negatives of the general set must be ignored
    return stage(spark, sf_dir, "balanced", lambda: B.balance(
        cleaned(spark, sf_dir), cleaned_negatives(spark, sf_dir), seed=SEED).select(
        "seq", "entity_id", "text", "label", "ord"))


def split(spark, sf_dir):
    return SP.stratified_split(balanced(spark, sf_dir), seed=SEED)


BAL_CTES = f"""{S.clean_ctes(25)},
{S.clean_neg_ctes(25)},
v AS (SELECT seq, entity_id, lower({S.strip('text')}) AS text, {S.label('label')} AS label
      FROM clean WHERE entity_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
v2 AS (SELECT * FROM v WHERE text <> '' AND label IS NOT NULL),
vn AS (SELECT seq, entity_id, lower({S.strip('text')}) AS text, {S.label('label')} AS label
      FROM clean_neg WHERE entity_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
vn2 AS (SELECT * FROM vn WHERE text <> '' AND label IS NOT NULL),
{S.keep_first("(SELECT * FROM v2 WHERE label = 1)", f"entity_id, {S.norm('text')}", "pos",
              "seq, entity_id, text, label")},
{S.keep_first("(SELECT * FROM vn2 WHERE label = 0)", f"entity_id, {S.norm('text')}", "neg",
              "seq, entity_id, text, label")},
samp AS (SELECT seq, entity_id, text, label FROM (
  SELECT *, row_number() OVER (ORDER BY {S.seeded_hash(SEED, 'seq')}, seq) - 1 AS r
  FROM pos) WHERE r < (SELECT count(*) FROM neg)),
bal0 AS (SELECT * FROM neg UNION ALL SELECT * FROM samp),
bal AS (SELECT seq, entity_id, text, label,
  row_number() OVER (ORDER BY {S.seeded_hash(SEED, 'seq', 'shuffle|')}, seq) - 1 AS ord
  FROM bal0)"""

SPLIT_CTES = f"""{BAL_CTES},
cnt AS (SELECT label, count(*) AS n FROM bal GROUP BY label),
t0 AS (SELECT label, n, ceil(0.2 * sum(n) OVER ()) AS tt FROM cnt),
t1 AS (SELECT *, tt * n / sum(n) OVER () AS sh FROM t0),
t2 AS (SELECT label, n, CAST(floor(sh) + CASE WHEN row_number() OVER
         (ORDER BY sh - floor(sh) DESC, label) <= tt - sum(floor(sh)) OVER ()
         THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM t1),
v0 AS (SELECT *, n - n_test AS rest, ceil(0.1 * sum(n - n_test) OVER ()) AS vv FROM t2),
v1 AS (SELECT *, vv * rest / sum(rest) OVER () AS sh FROM v0),
sizes AS (SELECT label, n, n_test, CAST(floor(sh) + CASE WHEN row_number() OVER
         (ORDER BY sh - floor(sh) DESC, label) <= vv - sum(floor(sh)) OVER ()
         THEN 1 ELSE 0 END AS BIGINT) AS n_val FROM v1),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.label ORDER BY
           {S.seeded_hash(SEED, 'b.seq')}, b.seq) - 1 AS r FROM bal b),
splitted AS (SELECT r.seq, r.entity_id, r.text, r.label, r.ord,
  CASE WHEN r.r < s.n_test THEN 'test' WHEN r.r < s.n_test + s.n_val THEN 'val'
       ELSE 'train' END AS split
  FROM ranked r JOIN sizes s ON r.label = s.label)"""

register("balanced_reviews", f"WITH {BAL_CTES}\nSELECT * FROM bal")(balanced)


@register("balance_report", f"""WITH {BAL_CTES},
g AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 0) AS ng,
        count(*) FILTER (WHERE label = 1) AS ps FROM bal
      GROUP BY entity_id, {S.norm('text')})
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(ng) AS BIGINT) AS negatives,
  CAST(sum(ps) AS BIGINT) AS positives,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM g""")
def balance_report(spark, sf_dir):
    return B.balance_report(balanced(spark, sf_dir))


@register("duplicate_audit", f"""WITH {S.REVIEWS_RAW}, {S.filtered('reviews_raw', 25)},
g AS (SELECT count(*) AS n FROM filtered GROUP BY entity_id, {S.norm('text')})
SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM g""")
def duplicate_audit(spark, sf_dir):
    f = C.filter_reviews(reviews_raw(spark, sf_dir), min_chars=25)
    return duplicate_rows(with_review_key(f), ["entity_id", "_key"])


register("stratified_split",
         f"WITH {SPLIT_CTES}\nSELECT * FROM splitted")(
    lambda spark, sf_dir: split(spark, sf_dir).select(
        "seq", "entity_id", "text", "label", "ord", "split"))


@register("split_sizes", f"""WITH {SPLIT_CTES}
SELECT split, label, count(*) AS n FROM splitted GROUP BY split, label""")
def split_sizes(spark, sf_dir):
    return SP.split_counts(split(spark, sf_dir))


@register("split_plan", f"""WITH {SPLIT_CTES}
SELECT label, n, n_test, n_val, n - n_test - n_val AS n_train FROM sizes""")
def split_plan(spark, sf_dir):
    return SP.split_sizes(balanced(spark, sf_dir))


@register("sample_positives", f"WITH {BAL_CTES}\nSELECT * FROM samp")
def sample_positives(spark, sf_dir):
    pos, neg = B.class_inputs(cleaned(spark, sf_dir), cleaned_negatives(spark, sf_dir))
    from ..operators.rank import seeded_hash, take_n
    n = B.class_counts(pos, neg)[1]
    return take_n(pos, n, seeded_hash(SEED, "seq"), "seq").select(
        "seq", "entity_id", "text", "label")
