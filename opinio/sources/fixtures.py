"""Review-shaped inputs derived by Spark from the driver's tables.

The reference ships no data; these views give it the shapes its code reads
(raw review CSV, crawl dump, scored test set, stored LLM replies, run logs)
while every row still comes from ``documents``/``labels``/``pages``/``events``,
so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# fixed values: tag captions of the review-page fixture, by doc_id % 4
TAG_CAPTIONS = ("Recommended", "Not Recommended", "Mixed Feelings",
                "recommended  Spoiler")


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw review table (built once per run, then read as a table)."""
    from ..plans.catalog import stage
    # dealt out anew: a driver table may be a single row group, which one task reads
    return stage(spark, sf_dir, "reviews_raw", lambda: build_reviews_raw(spark, sf_dir).repartition(F.col("seq")))


def build_reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty review records (seq, entity_id, text, label as text, marker).

    Null and blank texts, bad/null/"1.0"-style labels, whitespace-variant
    copies and label conflicts, as specified in FIXTURES §2.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    base_lab = F.coalesce(F.col("quality").cast("long"), i % 2).cast("string")
    txt = (F.when(i % 29 == 0, F.lit(None).cast("string"))
            .when(i % 31 == 0, F.lit("   ")).otherwise(F.col("text")))
    lab = (F.when(i % 17 == 0, F.lit("x")).when(i % 19 == 0, F.lit("2"))
            .when(i % 23 == 0, F.lit(None).cast("string"))
            .when(i % 7 == 0, F.concat(base_lab, F.lit(".0")))
            .otherwise(base_lab))
    mark = F.when(i % 6 != 5, F.concat(F.lit("  "), F.element_at(F.array(*[F.lit(t) for t in TAG_CAPTIONS]), (i % 4 + 1).cast("int")),
                                       F.lit(" ")))
    a = d.join(l, "doc_id", "left").select(
        (i * 2).alias("seq"), F.col("lang").alias("entity_id"),
        txt.alias("text"), lab.alias("label"), mark.alias("marker"))
    b = d.filter(i % 10 == 3).select(
        (i * 2 + 1).alias("seq"), F.col("lang").alias("entity_id"),
        F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   ")),
                 F.lit(" ")).alias("text"),
        (i % 2).cast("string").alias("label"), F.lit(None).cast("string").alias("marker"))
    return a.unionByName(b)


def reviews_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second, negatives-only input of cleaning and balancing: every
    third document as a review of its own, some labels bad."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(i % 3 == 1).select(
        (i * 2 + 1_000_000_000_000).alias("seq"), F.col("lang").alias("entity_id"),
        F.concat(F.lit("Negative: "), F.col("text")).alias("text"),
        F.when(i % 13 == 0, F.lit("x")).otherwise(F.lit("0")).alias("label"),
        F.lit(" Not Recommended").alias("marker"))


def score_hash(seq_col: str = "seq"):
    """First 8 hex digits of md5(seq) as an unsigned 32-bit integer."""
    return F.conv(F.substring(F.md5(F.col(seq_col).cast("string")), 1, 8),
                  16, 10).cast("long")


def deterministic_score(label_col: str = "label", seq_col: str = "seq"):
    """score = round(clip(0.25 + 0.5*label + (h/2^32 - 0.5)*0.9), 2).

    Rounding to two digits makes ties on purpose (exercises tie-aware AUC).
    """
    h = score_hash(seq_col).cast("double") / F.lit(4294967296.0)
    raw = (F.lit(0.25) + F.lit(0.5) * F.col(label_col).cast("double")
           + (h - F.lit(0.5)) * F.lit(0.9))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 2)


SITE = "https://h.example"
#: Layout of the crawl dump: so many boxes a page and pages an entity, so pages and entities grow with the table.
BOXES_PER_PAGE = 10
FILLED_PAGES = 5
PAGES_PER_ENTITY = 30


def entity_of(i):
    return F.lit(1) + F.floor(i / (BOXES_PER_PAGE * FILLED_PAGES)).cast("long")


def _doc_layout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        entity_of(i).alias("e"),
        (F.lit(1) + F.floor(i / BOXES_PER_PAGE).cast("long") % FILLED_PAGES).alias("p"),
        F.element_at(F.array(*[F.lit(t) for t in TAG_CAPTIONS]),
                     (i % 4 + 1).cast("int")).alias("tag"),
        F.when(i % 11 == 0, F.concat(F.lit("*Spoiler Warning*"), F.col("text")))
         .otherwise(F.col("text")).alias("body"))


def _join_ordered(order_col: str, piece: str):
    return F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                             F.col(piece).alias("v")))),
        lambda x: x["v"]), "")


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl dump table (built once per run, then read as a table)."""
    from ..plans.catalog import stage
    return stage(spark, sf_dir, "review_pages", lambda: build_review_pages(spark, sf_dir))


def build_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl dump with review boxes (page_id, url, html), FIXTURES §3.

    Ten documents a page, five pages an entity. Page 3 of entities divisible
    by 7 is missing, page 2 of entities divisible by 9 has no boxes, page 1
    of entities divisible by 13 reads "Access Denied". Entities divisible by
    3 also have a main page with a canonical slug link, and their review
    pages live under the slug URL. Of entities with remainder 2 by 5 the
    first candidate of page 2 came back without html, and a later candidate
    holds the page.
    """
    d = _doc_layout(spark, sf_dir)
    box = F.concat(
        F.lit('<div class="review-element js"><div class="tags"><span class="tag">'),
        F.col("tag"), F.lit('</span></div><div class="text">'), F.col("body"),
        F.lit("</div></div>"))
    g = (d.withColumn("box", box).groupBy("e", "p")
          .agg(_join_ordered("doc_id", "box").alias("boxes")))
    e, p = F.col("e"), F.col("p")
    html = (F.when((e % 9 == 0) & (p == 2),
                   F.lit("<html><body><p>No reviews yet.</p></body></html>"))
             .when((e % 13 == 0) & (p == 1), F.lit("<html><body>Access Denied</body></html>"))
             .otherwise(F.concat(F.lit("<html><body>"), F.col("boxes"),
                                 F.lit("</body></html>"))))
    slug = F.when(e % 3 == 0, F.concat(F.lit("/slug-"), e.cast("string"))).otherwise(F.lit(""))
    late = (e % 5 == 2) & (p == 2)
    rp = g.filter(~((e % 7 == 0) & (p == 3))).select(
        (e * 100 + p).cast("long").alias("page_id"),
        F.concat(F.lit(SITE + "/anime/"), e.cast("string"), slug, F.lit("/reviews"),
                 F.when(late, F.lit("/")).otherwise(F.lit("")), F.lit("?p="), p.cast("string")).alias("url"),
        html.alias("html"))
    failed = g.filter(late).select(
        (e * 100 + p + 50).cast("long").alias("page_id"),
        F.concat(F.lit(SITE + "/anime/"), e.cast("string"), slug, F.lit("/reviews?p="), p.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("html"))
    rp = rp.unionByName(failed)
    q = F.when(e % 2 == 0, F.lit("'")).otherwise(F.lit('"'))
    main = d.select("e").distinct().filter(e % 3 == 0).select(
        (e * 100).cast("long").alias("page_id"),
        F.concat(F.lit(SITE + "/anime/"), e.cast("string")).alias("url"),
        F.concat(F.lit('<html><head><LINK REL="Canonical" href='), q, F.lit(SITE + "/anime/"),
                 e.cast("string"), F.lit("/slug-"), e.cast("string"), q,
                 F.lit("></head><body>main</body></html>")).alias("html"))
    return rp.unionByName(main)


def crawl_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_layout(spark, sf_dir).select(
        F.col("e").cast("string").alias("entity_id")).distinct()


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing-page table (built once per run, then read as a table)."""
    from ..plans.catalog import stage
    return stage(spark, sf_dir, "listing_pages", lambda: build_listing_pages(spark, sf_dir))


def build_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking listing pages (list_page, html): 50 documents per page, each
    a link to entity ``1 + doc_id // 3`` (every tenth to ``1 + doc_id //
    30``), inside a ranking heading unless doc_id % 3 == 0; every 4th page
    has no ranking headings."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    n = F.floor(i / 50).cast("long")
    e = F.lit(1) + F.when(i % 10 == 9, F.floor(i / 30)).otherwise(F.floor(i / 3)).cast("long")
    a = F.concat(F.lit(f'<a href="{SITE}/anime/'), e.cast("string"),
                 F.lit('/t">x</a>'))
    inr = (i % 3 != 0) & (n % 4 != 3)
    el = F.when(inr, F.concat(F.lit('<h3 class="anime_ranking_h3">'), a, F.lit("</h3>"))) \
        .otherwise(F.concat(F.lit("<p>"), a, F.lit("</p>")))
    return (d.select(n.alias("list_page"), "doc_id", el.alias("el"))
             .groupBy("list_page").agg(_join_ordered("doc_id", "el").alias("html")))


def llm_replies_from(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """Stored LLM replies (id, raw), twelve reply shapes by ``id % 13``, and
    none for remainder 12: JSON positive; JSON negative with textual
    confidence; JSON inside prose; single-quoted pseudo-JSON; plain negative
    sentence; prose naming both sides; an empty object; JSON with null
    confidence and an unknown verdict; an array; a repeated key; a
    confidence that is no number; two objects.
    The confidence and reason vary with the row's text length."""
    i = F.col(id_col) % 13
    n = (F.length("text") % 101).cast("string")
    k = (F.length("text") % 7).cast("string")
    raw = (F.when(i == 0, F.concat(F.lit('{"sentimiento": "positiva", "confianza": '), n,
                                   F.lit(', "razon": "  Tono favorable ('), k, F.lit(').  "}')))
            .when(i == 1, F.concat(F.lit('{"sentimiento": "Negativa", "confianza": "'), n,
                                   F.lit('", "razon": "Critica el ritmo"}')))
            .when(i == 2, F.concat(F.lit('Claro, aqui va:\n{"sentimiento": "POSITIVA",\n'
                                         ' "confianza": '), n,
                                   F.lit(', "razon": "ok"}\nEspero que ayude.')))
            .when(i == 3, F.concat(F.lit("{'sentimiento': 'positiva', 'confianza': "), n,
                                   F.lit("}")))
            .when(i == 4, F.lit("La reseña es negativa."))
            .when(i == 5, F.lit("No es del todo positiva ni negativa."))
            .when(i == 6, F.lit("{}"))
            .when(i == 7, F.lit('{"sentimiento": "mixta", "confianza": null, "razon": null}'))
            .when(i == 8, F.concat(F.lit('[{"sentimiento": "positiva", "confianza": '), n, F.lit("}]")))
            .when(i == 9, F.concat(F.lit('{"sentimiento": "positiva", "sentimiento": "negativa", "confianza": '), n, F.lit("}")))
            .when(i == 10, F.concat(F.lit('{"sentimiento": "negativa", "confianza": "'), n, F.lit('f"}')))
            .otherwise(F.concat(F.lit('{"sentimiento": "positiva", "confianza": '), n,
                                F.lit('} y {"sentimiento": "negativa"}'))))
    return df.where(i != 12).select(F.col(id_col).alias("id"), raw.alias("raw"))
