"""Crawl dump -> review records.

HTTP fetching is not built: the input is a table of fetched pages
``(page_id, url, html)``. URL planning, first-hit selection, page status
and stop-at-gap are joins, aggregations and a window over the small
(entity, page) table; only the HTML box walk runs in Python
(``mapInArrow``, one page at a time), the marker cascade and text clean-up
are native expressions on its output.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_ws, norm_key, ustrip
from ..session import ship_package, staged
from . import boxscan
from .dedupe import keep_first, with_review_key
from .htmlboxes import anchors, outline, review_boxes

ENTITY_URL = r"/anime/(\d+)"
BLOCK_RE = r"(?i)captcha|access denied|cloudflare"
SPOILER = "*Spoiler Warning*"


def entity_from_url(url, pattern: str = ENTITY_URL) -> Column:
    """First captured number of ``pattern`` in the URL, else null."""
    u = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))


def canonical_slug(html: Column, entity: Column, site: str) -> Column:
    """Slug of the canonical link for this entity, else null.
    Case-insensitive; the slug ends at a quote, /, ? or #."""
    pat = F.concat(
        F.lit("(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']"
              + re.escape(site) + "/anime/"),
        entity, F.lit("/([^\"'/?#]+)"))
    # the pattern embeds the row's entity id, so it is a column, not a literal
    return F.nullif(F.call_function("regexp_extract", F.coalesce(html, F.lit("")),
                                    pat, F.lit(1)), F.lit(""))


def reviews_base(entity: Column, slug: Column, site: str) -> Column:
    """Reviews base URL: with the slug when known, else slug-less."""
    plain = F.concat(F.lit(site + "/anime/"), entity, F.lit("/reviews"))
    return F.when(slug.isNull(), plain).otherwise(
        F.concat(F.lit(site + "/anime/"), entity, F.lit("/"), slug, F.lit("/reviews")))


def canonical_base(html: Column, entity: Column, site: str) -> Column:
    """Reviews base URL from the canonical link's slug, else the
    slug-less URL."""
    return reviews_base(entity, canonical_slug(html, entity, site), site)


def candidate_plan(entities: DataFrame, pages_per_entity: int, site: str,
                   base_col: str = "base") -> DataFrame:
    """(entity_id, page, cand_rank, url) in fixed preference order:
    five candidates for page 1, four for later pages."""
    e = F.col("entity_id").cast("string")
    plain = F.concat(F.lit(site + "/anime/"), e, F.lit("/reviews"))
    base = F.col(base_col)
    p = F.col("page").cast("string")
    first = F.array(base, F.concat(base, F.lit("?p=1")), F.concat(base, F.lit("/?p=1")),
                    plain, F.concat(plain, F.lit("?p=1")))
    later = F.array(F.concat(base, F.lit("?p="), p), F.concat(base, F.lit("/?p="), p),
                    F.concat(plain, F.lit("?p="), p), F.concat(plain, F.lit("/?p="), p))
    pg = entities.select("entity_id", base_col, F.explode(
        F.sequence(F.lit(1), F.lit(int(pages_per_entity)))).alias("page"))
    return pg.select("entity_id", "page", F.posexplode(
        F.when(F.col("page") == 1, first).otherwise(later)).alias("cand_rank", "url"))


def first_fetched(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Per (entity, page) the page_id of the first candidate URL that
    was fetched, null when none was. A page without html was not fetched:
    the next candidate gets its turn. Only (url, page_id) is joined, never
    the HTML."""
    hit = plan.join(pages.where("html IS NOT NULL").select("url", "page_id"), "url", "left")
    # the minimum skips nulls: candidates that were not fetched never win
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("cand_rank", "page_id")))
    return hit.groupBy("entity_id", "page").agg(first.alias("_f")).select(
        "entity_id", "page", F.col("_f.page_id").alias("page_id"))


BOX_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("blocked", T.BooleanType()),
    T.StructField("main_entity", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("box_pos", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("head", T.StringType()),
    T.StructField("body", T.StringType()),
])


#: Pages that a Python worker has as Python objects at a time.
PAGES_AT_ONCE = 64


def _boxes_fn(batches):
    import pyarrow as pa
    names = ["page_id", "blocked", "main_entity", "slug", "html"]
    kinds = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            some = batch.slice(at, PAGES_AT_ONCE)
            rows = []
            for pid, blocked, me, slug, html in zip(*[some.column(n).to_pylist() for n in names]):
                bx = review_boxes(html or "")
                if not bx:
                    rows.append((pid, blocked, me, slug, None, None, None, None))
                for pos, tags, head, body in bx:
                    rows.append((pid, blocked, me, slug, pos, tags, head, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=BOX_SCHEMA.names)


MAIN_PAGE_URL = r"/anime/(\d+)/?$"


def explode_boxes(pages: DataFrame, site: str | None = None) -> DataFrame:
    """One row per review box (pages without boxes: one null box).

    Page-level facts are computed natively in the same scan, before the
    Python step, so the HTML column is read once: the blocked test, and
    for an entity's main page (URL ``…/anime/<id>``) the canonical slug
    (O12) when ``site`` is given.
    """
    ship_package(pages.sparkSession)
    return page_facts(pages, site).mapInArrow(_boxes_fn, BOX_SCHEMA)


def page_facts(pages: DataFrame, site: str | None = None) -> DataFrame:
    """(page_id, blocked, main_entity, slug, html): what is known of a page without its boxes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    me = entity_from_url("url", MAIN_PAGE_URL)
    slug = (F.when(me.isNotNull(), canonical_slug(html, me, site)) if site
            else F.lit(None).cast("string"))
    return pages.select("page_id", html.rlike(BLOCK_RE).alias("blocked"),
                        me.alias("main_entity"), slug.alias("slug"), "html")


def explode_boxes_mixed(pages: DataFrame, site: str | None = None) -> DataFrame:
    """Tidy pages by expressions alone, the others by the walk; the same rows as ``explode_boxes``.

    The test of a page is written beside it, so each page is tested once
    and only untidy pages ever reach a Python worker.
    """
    facts = staged(page_facts(pages, site).withColumn("tidy", boxscan.tidy(F.coalesce("html", F.lit("")))), "page-facts")
    ship_package(pages.sparkSession)
    walked = facts.where("NOT tidy").drop("tidy").mapInArrow(_boxes_fn, BOX_SCHEMA)
    return boxscan.scanned(facts.where("tidy").drop("tidy")).unionByName(walked)


def explode_boxes_native(pages: DataFrame, site: str | None = None) -> DataFrame:
    """O17 by expressions alone, for pages known to be tidy (``boxscan.tidy``)."""
    return boxscan.scanned(page_facts(pages, site))


def entity_bases(entities: DataFrame, boxes: DataFrame, site: str) -> DataFrame:
    """(entity_id, base): reviews base URL per entity from the main-page
    facts carried by ``explode_boxes`` (no second pass over the HTML)."""
    main = (boxes.filter(F.col("main_entity").isNotNull())
                 .groupBy(F.col("main_entity").alias("entity_id"))
                 .agg(F.max("slug").alias("slug")))
    ent = entities.select(F.col("entity_id").cast("string").alias("entity_id"))
    return ent.join(main, "entity_id", "left").select(
        "entity_id", reviews_base(F.col("entity_id"), F.col("slug"), site).alias("base"))


def marker(tags: Column, head: Column) -> Column:
    """First tag that mentions "recommended" decides (``not
    recommended`` -> negative); otherwise the first 260 characters of the
    box text are searched for the whole phrases; otherwise null."""
    hit = F.try_element_at(F.filter(F.transform(tags, lambda t: norm_key(t)),
                                lambda t: t.contains("recommended")), F.lit(1))
    h = norm_key(head)
    return (F.when(hit.contains("not recommended"), F.lit("not_recommended"))
             .when(hit.isNotNull(), F.lit("recommended"))
             .when(h.rlike(r"\bnot recommended\b"), F.lit("not_recommended"))
             .when(h.rlike(r"\brecommended\b"), F.lit("recommended")))


def review_text(body: Column) -> Column:
    """Drop the spoiler banner, collapse whitespace, strip; '' -> null."""
    t = ustrip(collapse_ws(F.replace(body, F.lit(SPOILER), F.lit(""))))
    return F.nullif(t, F.lit(""))


def page_status(slots: DataFrame, boxes: DataFrame) -> DataFrame:
    """Status per (entity, page): missing / blocked / empty / ok."""
    per = boxes.groupBy("page_id").agg(F.count("box_pos").alias("n_boxes"),
                                       F.max("blocked").alias("blocked"))
    s = slots.join(per, "page_id", "left")
    st = (F.when(F.col("page_id").isNull(), F.lit("missing"))
           .when(F.coalesce(F.col("n_boxes"), F.lit(0)) == 0,
                 F.when((F.col("page") == 1) & F.col("blocked"), F.lit("blocked"))
                  .otherwise(F.lit("empty")))
           .otherwise(F.lit("ok")))
    return s.withColumn("status", st)


def stop_at_gap(status: DataFrame) -> DataFrame:
    """Keep an entity's pages before its first non-ok page."""
    w = Window.partitionBy("entity_id")
    stop = F.min(F.when(F.col("status") != "ok", F.col("page"))).over(w)
    return status.withColumn("_stop", stop).filter(
        F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop")


def extract_reviews(entities: DataFrame, pages: DataFrame, site: str,
                    pages_per_entity: int = 30, mode: str = "all",
                    boxes: DataFrame | None = None) -> DataFrame:
    """O12-O21 end to end: (entity_id, page, box_pos, text, marker, label).

    ``entities`` has ``entity_id``; ``mode='negatives'`` keeps only
    not-recommended reviews (label 0). The boxes are written once, so every
    page is parsed once.
    """
    bx = boxes if boxes is not None else staged(explode_boxes(pages, site), "boxes")
    ent = entity_bases(entities, bx, site)
    plan = candidate_plan(ent, pages_per_entity, site)
    slots = first_fetched(plan, pages)
    kept = stop_at_gap(page_status(slots, bx)).filter(F.col("status") == "ok")
    b = bx.filter(F.col("box_pos").isNotNull()).join(
        kept.select("page_id", "entity_id", "page"), "page_id")
    rec = b.select("entity_id", "page", "page_id", "box_pos",
                   review_text(F.col("body")).alias("text"),
                   marker(F.col("tags"), F.col("head")).alias("marker"))
    rec = rec.filter(F.col("text").isNotNull() & F.col("marker").isNotNull())
    if mode == "negatives":
        rec = rec.filter(F.col("marker") == "not_recommended")
    rec = rec.withColumn("label", F.when(F.col("marker") == "recommended", 1)
                         .otherwise(0))
    rec = with_review_key(rec, "text", "_key")
    # (page_id, position) is unique, and an entity's page has one page_id
    return keep_first(rec, ["entity_id", "_key"], ["page", "page_id", "box_pos"]).drop("_key", "page_id")


def page_counters(records: DataFrame) -> DataFrame:
    """Valid rows per (entity, page) after the within-entity dedupe."""
    return records.groupBy("entity_id", "page").agg(
        F.count(F.lit(1)).alias("valid_rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"))


def entity_counters(records: DataFrame, stored: DataFrame, slice_size: int = 4096) -> DataFrame:
    """Per entity the rows that are new against the stored ones, those
    discarded, and the rows accumulated so far in the order of the ids.

    ``records`` is deduplicated within its entities (O21). The running total
    adds up slices of entity numbers first, so no task sees all entities.
    """
    seen = with_review_key(stored, "text", "_key").select("entity_id", "_key").distinct().withColumn("_seen", F.lit(True))
    r = with_review_key(records, "text", "_key").join(seen, ["entity_id", "_key"], "left")
    per = r.groupBy("entity_id").agg(F.count_if(F.col("_seen").isNull()).alias("new_rows"),
                                     F.count_if(F.col("_seen").isNotNull()).alias("discarded_rows"))
    per = per.withColumn("_n", F.col("entity_id").cast("long")).withColumn("_slice", F.floor(F.col("_n") / slice_size))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = per.groupBy("_slice").agg(F.sum("new_rows").alias("_s"))
    slices = slices.select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_slice").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.join(slices, "_slice").select(
        "entity_id", "new_rows", "discarded_rows",
        (F.col("_before") + F.sum("new_rows").over(upto)).alias("accumulated_rows"))


ANCHOR_SCHEMA = T.StructType([
    T.StructField("list_page", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("href", T.StringType()),
    T.StructField("in_ranking", T.BooleanType()),
])


def _anchors_fn(batches):
    for pdf in batches:
        rows = [(pg, pos, href, inr)
                for pg, html in zip(pdf["list_page"], pdf["html"])
                for pos, href, inr in anchors(html or "")]
        yield pd.DataFrame(rows, columns=[f.name for f in ANCHOR_SCHEMA.fields])


def ranked_entities(listing: DataFrame, max_n: int) -> DataFrame:
    """Entity ids from listing pages (``list_page``, ``html``) in
    page + document order; a page's ranking-heading links are used, or all
    its entity links when it has none; first occurrence wins; top
    ``max_n`` (the list size is the feature)."""
    a = listing.select("list_page", "html").mapInPandas(_anchors_fn, ANCHOR_SCHEMA)
    a = a.withColumn("entity_id", entity_from_url("href")).filter(
        F.col("entity_id").isNotNull())
    has = F.max(F.col("in_ranking").cast("int")).over(Window.partitionBy("list_page"))
    a = a.withColumn("_has", has).filter(F.col("in_ranking") | (F.col("_has") == 0))
    first = a.groupBy("entity_id").agg(F.min(F.struct("list_page", "pos")).alias("_o"))
    top = first.orderBy("_o").limit(int(max_n))     # TakeOrderedAndProject
    w = Window.orderBy("_o")                         # over <= max_n rows
    return top.select((F.row_number().over(w)).alias("rank"), "entity_id")


def page_outline(pages: DataFrame, container: str = "article", item: str = "p") -> DataFrame:
    """The same walk over pages of any layout: (page_id, n_items, links) with
    the ``item`` elements inside ``container`` and all link targets in
    document order. A page without html has none."""
    def walk(batches):
        for pdf in batches:
            rows = [(pid, *outline(html or "", container, item)) for pid, html in zip(pdf["page_id"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["page_id", "n_items", "links"])

    ship_package(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(walk, "page_id long, n_items long, links array<string>")
