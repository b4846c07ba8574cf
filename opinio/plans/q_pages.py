"""Page extraction over review-page fixtures and the driver's ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..sources import fixtures as FX
from ..sources.tables import table
from . import sqlparts as S
from .catalog import register, stage


@register("page_entity_ids", r"""SELECT page_id,
  nullif(regexp_extract(url, '/(\d+)', 1), '') AS entity_id FROM pages""")
def page_entity_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", X.entity_from_url("url", r"/(\d+)").alias("entity_id"))


@register("page_outline", r"""SELECT page_id,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article.*?</article>', 0), '<p[ >]')) AS BIGINT) AS n_paragraphs,
  array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), chr(10)) AS links FROM pages""")
def page_outline(spark, sf_dir):
    """The box walk over the real pages: untidy HTML, unclosed paragraphs."""
    p = X.page_outline(table(spark, sf_dir, "pages"))
    return p.select("page_id", F.col("n_items").alias("n_paragraphs"), F.array_join("links", "\n").alias("links"))


def boxes(spark, sf_dir):
    return stage(spark, sf_dir, "boxes",
                 lambda: X.explode_boxes(FX.review_pages(spark, sf_dir), FX.SITE))


def records(spark, sf_dir, mode="all"):
    return X.extract_reviews(FX.crawl_entities(spark, sf_dir),
                             FX.review_pages(spark, sf_dir), FX.SITE,
                             FX.PAGES_PER_ENTITY, mode, boxes=boxes(spark, sf_dir))


def _tag_sql():
    return ("CASE doc_id % 4 " + " ".join(
        f"WHEN {k} THEN '{t}'" for k, t in enumerate(FX.TAG_CAPTIONS)) + " END")


_NT = S.norm("tag")
_HEAD = S.norm(f"substring({S.strip('tag')} || ' ' || {S.strip('body')}, 1, 260)")
PAGE_CTES = f"""d AS (SELECT doc_id, 1 + doc_id // 50 AS e,
    1 + (doc_id // 10) % 5 AS p, {_tag_sql()} AS tag,
    CASE WHEN doc_id % 11 = 0 THEN '*Spoiler Warning*' || text ELSE text END AS body
  FROM documents),
ents AS (SELECT DISTINCT e FROM d),
slots AS (SELECT e, r.p FROM ents, range(1, {FX.PAGES_PER_ENTITY + 1}) r(p)),
exist AS (SELECT DISTINCT e, p FROM d WHERE NOT (e % 7 = 0 AND p = 3)),
st AS (SELECT s.e, s.p, CASE WHEN x.e IS NULL THEN 'missing'
    WHEN s.e % 9 = 0 AND s.p = 2 THEN 'empty' WHEN s.e % 13 = 0 AND s.p = 1 THEN 'blocked'
    ELSE 'ok' END AS status
  FROM slots s LEFT JOIN exist x ON s.e = x.e AND s.p = x.p),
stp AS (SELECT e, min(p) FILTER (WHERE status <> 'ok') AS sp FROM st GROUP BY e),
kept AS (SELECT st.e, st.p FROM st JOIN stp ON st.e = stp.e
  WHERE status = 'ok' AND (sp IS NULL OR st.p < sp)),
bx AS (SELECT d.*, CAST(row_number() OVER (PARTITION BY d.e, d.p ORDER BY d.doc_id) - 1 AS INTEGER)
    AS box_pos FROM d JOIN kept k ON d.e = k.e AND d.p = k.p),
rec0 AS (SELECT CAST(e AS VARCHAR) AS entity_id, CAST(p AS INTEGER) AS page, box_pos,
  nullif({S.strip(f"regexp_replace(replace({S.strip('body')}, '*Spoiler Warning*', ''), '{S.RE2_WS}+', ' ', 'g')")}, '') AS text,
  CASE WHEN {_NT} LIKE '%not recommended%' THEN 'not_recommended'
       WHEN {_NT} LIKE '%recommended%' THEN 'recommended'
       WHEN regexp_matches({_HEAD}, '\\bnot recommended\\b') THEN 'not_recommended'
       WHEN regexp_matches({_HEAD}, '\\brecommended\\b') THEN 'recommended' END AS marker
  FROM bx),
rec1 AS (SELECT *, CASE WHEN marker = 'recommended' THEN 1 ELSE 0 END AS label FROM rec0
  WHERE text IS NOT NULL AND marker IS NOT NULL),
recs AS (SELECT entity_id, page, box_pos, text, marker, label FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, {S.norm('text')}
    ORDER BY page, box_pos) AS rn FROM rec1) WHERE rn = 1)"""


@register("extracted_reviews", f"WITH {PAGE_CTES}\nSELECT * FROM recs")
def extracted_reviews(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", "page", "box_pos", "text",
                                         "marker", "label")


@register("native_boxes", f"WITH {PAGE_CTES}\nSELECT * FROM recs")
def native_boxes(spark, sf_dir):
    """The records from boxes found by expressions: no page of this dump needs the Python walk."""
    pages = FX.review_pages(spark, sf_dir)
    bx = stage(spark, sf_dir, "native_boxes", lambda: X.explode_boxes_native(pages, FX.SITE))
    return X.extract_reviews(FX.crawl_entities(spark, sf_dir), pages, FX.SITE, FX.PAGES_PER_ENTITY, boxes=bx).select(
        "entity_id", "page", "box_pos", "text", "marker", "label")


@register("extracted_negatives", f"""WITH {PAGE_CTES}
SELECT entity_id, page, box_pos, text, marker, label FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, {S.norm('text')}
    ORDER BY page, box_pos) AS rn FROM rec1 WHERE marker = 'not_recommended') WHERE rn = 1""")
def extracted_negatives(spark, sf_dir):
    return records(spark, sf_dir, "negatives").select(
        "entity_id", "page", "box_pos", "text", "marker", "label")


@register("page_status", f"""WITH {PAGE_CTES}
SELECT CAST(st.e AS VARCHAR) AS entity_id, CAST(st.p AS INTEGER) AS page, status,
  (sp IS NULL OR st.p < sp) AS kept
FROM st JOIN stp ON st.e = stp.e""")
def page_status(spark, sf_dir):
    pages = FX.review_pages(spark, sf_dir)
    ent = X.entity_bases(FX.crawl_entities(spark, sf_dir), boxes(spark, sf_dir), FX.SITE)
    slots = X.first_fetched(X.candidate_plan(ent, FX.PAGES_PER_ENTITY, FX.SITE), pages)
    st = X.page_status(slots, boxes(spark, sf_dir))
    kept = X.stop_at_gap(st).select("entity_id", "page", F.lit(True).alias("kept"))
    return st.join(kept, ["entity_id", "page"], "left").select(
        "entity_id", "page", "status", F.coalesce("kept", F.lit(False)).alias("kept"))


@register("page_counters", f"""WITH {PAGE_CTES}
SELECT entity_id, page, count(*) AS valid_rows,
  count(*) FILTER (WHERE label = 1) AS positives,
  count(*) FILTER (WHERE label = 0) AS negatives FROM recs GROUP BY entity_id, page""")
def page_counters(spark, sf_dir):
    return X.page_counters(records(spark, sf_dir))


@register("entity_counters", f"""WITH {PAGE_CTES},
stored AS (SELECT DISTINCT entity_id, {S.norm('text')} AS k FROM recs WHERE box_pos % 3 = 0),
per AS (SELECT r.entity_id, count(*) FILTER (WHERE s.k IS NULL) AS new_rows,
    count(*) FILTER (WHERE s.k IS NOT NULL) AS discarded_rows
  FROM recs r LEFT JOIN stored s ON s.entity_id = r.entity_id AND s.k = {S.norm('r.text')} GROUP BY r.entity_id)
SELECT entity_id, new_rows, discarded_rows,
  CAST(sum(new_rows) OVER (ORDER BY CAST(entity_id AS BIGINT)) AS BIGINT) AS accumulated_rows FROM per""")
def entity_counters(spark, sf_dir):
    """A crawl whose boxes at every third place are already in the accumulated set."""
    r = records(spark, sf_dir)
    return X.entity_counters(r, r.where("box_pos % 3 = 0"))


@register("review_base_urls", f"""WITH d AS (SELECT DISTINCT 1 + doc_id // 50 AS e FROM documents)
SELECT CAST(e AS VARCHAR) AS entity_id, CASE WHEN e % 3 = 0
  THEN '{FX.SITE}/anime/' || e || '/slug-' || e || '/reviews'
  ELSE '{FX.SITE}/anime/' || e || '/reviews' END AS base FROM d""")
def review_base_urls(spark, sf_dir):
    pages = FX.review_pages(spark, sf_dir)
    main = pages.select(X.entity_from_url("url", r"/anime/(\d+)/?$").alias("entity_id"),
                        "html").filter(F.col("entity_id").isNotNull())
    ent = FX.crawl_entities(spark, sf_dir).join(main, "entity_id", "left")
    return ent.select("entity_id", X.canonical_base(F.col("html"), F.col("entity_id"),
                                                    FX.SITE).alias("base"))


@register("ranked_entities", """WITH l AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS n,
  doc_id, CAST(1 + CASE WHEN doc_id % 10 = 9 THEN doc_id // 30 ELSE doc_id // 3 END AS VARCHAR) AS entity_id,
  (doc_id % 3 <> 0 AND CAST(floor(doc_id / 50) AS BIGINT) % 4 <> 3) AS in_h3 FROM documents),
h AS (SELECT n, bool_or(in_h3) AS has FROM l GROUP BY n),
sel AS (SELECT l.* FROM l JOIN h ON l.n = h.n WHERE in_h3 OR NOT has),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n, doc_id)
  AS rn FROM sel) WHERE rn = 1),
r AS (SELECT CAST(row_number() OVER (ORDER BY n, doc_id) AS INTEGER) AS rank, entity_id FROM f)
SELECT * FROM r WHERE rank <= 500""")
def ranked_entities(spark, sf_dir):
    return X.ranked_entities(FX.listing_pages(spark, sf_dir), 500)


@register("candidate_plan", f"""WITH d AS (SELECT DISTINCT 1 + doc_id // 50 AS e FROM documents),
b AS (SELECT e, CASE WHEN e % 3 = 0 THEN '{FX.SITE}/anime/' || e || '/slug-' || e || '/reviews'
  ELSE '{FX.SITE}/anime/' || e || '/reviews' END AS base,
  '{FX.SITE}/anime/' || e || '/reviews' AS plain FROM d),
pg AS (SELECT b.*, r.p FROM b, range(1, {FX.PAGES_PER_ENTITY + 1}) r(p)),
c AS (SELECT CAST(e AS VARCHAR) AS entity_id, CAST(p AS INTEGER) AS page,
  CASE WHEN p = 1 THEN [base, base || '?p=1', base || '/?p=1', plain, plain || '?p=1']
  ELSE [base || '?p=' || p, base || '/?p=' || p, plain || '?p=' || p, plain || '/?p=' || p]
  END AS urls FROM pg)
SELECT entity_id, page, CAST(unnest(generate_series(0, len(urls) - 1)) AS INTEGER) AS cand_rank,
  unnest(urls) AS url FROM c""")
def candidate_plan_q(spark, sf_dir):
    return X.candidate_plan(review_base_urls(spark, sf_dir), FX.PAGES_PER_ENTITY, FX.SITE)
