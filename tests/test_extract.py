"""Page extraction on hand-made HTML."""

from pyspark.sql import functions as F

from opinio.operators import extract as X
from opinio.operators.htmlboxes import anchors, review_boxes

SITE = "https://h.example"


def _box(tag, text, cls="review-element"):
    t = f'<span class="tag">{tag}</span>' if tag is not None else ""
    return f'<div class="{cls}"><div class="tags">{t}</div><div class="text">{text}</div></div>'


def test_boxes_nested_and_variants():
    html = ('<div class="review-element"><div class="text">outer &amp; text</div>'
            '<div class="review-element-x"><div class="text">inner</div></div></div>'
            '<div class="xreview-element"><div class="text">not a box</div></div>'
            '<div class="review-element"><div class="text">one</div><div class="text">two</div>'
            '<p>unclosed <b>bold</div>')
    bx = review_boxes(html)
    assert [b[3] for b in bx] == ["outer & text", "inner", "one"]
    assert bx[0][2].startswith("outer & text inner")


def _cascade(spark, tags, head):
    df = spark.createDataFrame([(tags, head)], "tags array<string>, head string")
    return df.select(X.marker(F.col("tags"), F.col("head"))).first()[0]


def test_marker_cascade(spark):
    assert _cascade(spark, ["Recommended"], "") == "recommended"
    assert _cascade(spark, ["  Not   Recommended "], "") == "not_recommended"
    assert _cascade(spark, ["Mixed", "recommended then not recommended"], "") == "not_recommended"
    assert _cascade(spark, ["Preliminary"], "xx Not Recommended yy") == "not_recommended"
    assert _cascade(spark, [], "so Recommended!") == "recommended"
    assert _cascade(spark, [], "unrecommended") is None
    long_head = ("word " * 60)[:260]           # phrase beyond 260 chars is cut off
    assert _cascade(spark, [], long_head) is None


def test_review_text(spark):
    df = spark.createDataFrame([("*Spoiler Warning*  keep   Case\n here ",), ("*Spoiler Warning*",)],
                               "b string")
    got = [r[0] for r in df.select(X.review_text(F.col("b"))).collect()]
    assert got == ["keep Case here", None]


def test_canonical_base(spark):
    rows = [("5", '<link rel="canonical" href="https://h.example/anime/5/My_Show?x=1">'),
            ("6", "<LINK Rel='Canonical' HREF='https://h.example/anime/6/slug/more'>"),
            ("7", '<link rel="canonical" href="https://h.example/anime/8/wrong">'),
            ("9", None)]
    df = spark.createDataFrame(rows, "entity_id string, html string")
    got = [r[0] for r in df.select(X.canonical_base(F.col("html"), F.col("entity_id"),
                                                    SITE)).collect()]
    assert got == ["https://h.example/anime/5/My_Show/reviews",
                   "https://h.example/anime/6/slug/reviews",
                   "https://h.example/anime/7/reviews", "https://h.example/anime/9/reviews"]


def test_end_to_end_stop_and_first_candidate(spark):
    p1 = "<html>" + _box("Recommended", "good show indeed") + _box(None, "Not recommended at all. meh") + "</html>"
    p2 = "<html>" + _box("Not Recommended", "bad show") + _box("Recommended", "GOOD   show indeed") + "</html>"
    p3 = "<html><p>nothing</p></html>"
    p4 = "<html>" + _box("Recommended", "never reached") + "</html>"
    pages = spark.createDataFrame([
        (1, f"{SITE}/anime/1/reviews?p=1", p1),
        (2, f"{SITE}/anime/1/reviews/?p=2", p2),     # second candidate
        (3, f"{SITE}/anime/1/reviews?p=3", p3),      # empty -> stop
        (4, f"{SITE}/anime/1/reviews?p=4", p4),
        (5, f"{SITE}/anime/2/reviews?p=1", "<b>Access Denied</b>"),
    ], "page_id long, url string, html string")
    ents = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    rec = X.extract_reviews(ents, pages, SITE, pages_per_entity=5).orderBy("page", "box_pos").collect()
    assert [(r["page"], r["text"], r["label"]) for r in rec] == [
        (1, "good show indeed", 1), (1, "Not recommended at all. meh", 0), (2, "bad show", 0)]
    neg = X.extract_reviews(ents, pages, SITE, 5, mode="negatives").collect()
    assert {r["text"] for r in neg} == {"Not recommended at all. meh", "bad show"}


def test_anchors_and_ranked(spark):
    h1 = ('<h3 class="anime_ranking_h3"><a href="/anime/5/a">x</a></h3><a href="/anime/9">y</a>'
          '<h3 class="anime_ranking_h3"><a href="/anime/5/b">z</a></h3>')
    h2 = '<a href="/anime/9/q">q</a><a href="/manga/3">m</a><a href="/anime/11">r</a>'
    assert [a[1] for a in anchors(h1)] == ["/anime/5/a", "/anime/9", "/anime/5/b"]
    df = spark.createDataFrame([(1, h1), (2, h2)], "list_page long, html string")
    got = [(r["rank"], r["entity_id"]) for r in X.ranked_entities(df, 10).collect()]
    assert got == [(1, "5"), (2, "9"), (3, "11")]
    assert [r["entity_id"] for r in X.ranked_entities(df, 2).collect()] == ["5", "9"]


def test_deep_html_and_outline():
    from opinio.operators.htmlboxes import outline
    deep = '<div class="review-element"><div class="text">' + "<p>x" * 5000
    assert review_boxes(deep)[0][3] == " ".join(["x"] * 5000)
    n, links = outline("<p>a<article>" + "<p>x<a href='/1'>" * 3000 + "</article><p><a href='/2'>")
    assert n == 3000 and links == ["/1"] * 3000 + ["/2"]


def test_page_without_html_leaves_the_turn_to_the_next_candidate(spark):
    pages = spark.createDataFrame([(1, f"{SITE}/anime/1/reviews", None),
                                   (2, f"{SITE}/anime/1/reviews?p=1", _box("Recommended", "found at the second try"))],
                                  "page_id long, url string, html string")
    ents = spark.createDataFrame([("1",)], "entity_id string")
    assert [r["text"] for r in X.extract_reviews(ents, pages, SITE, 2).collect()] == ["found at the second try"]
