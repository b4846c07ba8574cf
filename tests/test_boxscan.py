"""Review boxes by expressions against the walk."""

import random

from pyspark.sql import functions as F

from opinio.operators import boxscan as B
from opinio.operators import extract as X
from opinio.operators.htmlboxes import review_boxes

PAGES = "page_id long, url string, html string"


def boxes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["page_id"], [])
        if r["box_pos"] is not None:
            out[r["page_id"]].append((r["box_pos"], r["tags"], r["head"], r["body"]))
    return {k: sorted(v) for k, v in out.items()}


def pages_of(spark, htmls):
    return spark.createDataFrame([(i, f"https://h.example/p/{i}", h) for i, h in enumerate(htmls)], PAGES)


def tidy_page(rng, depth=0):
    """Random boxes, nested up to three deep, in the shapes that the dump has and variants of them."""
    out = []
    for _ in range(rng.randrange(0, 4)):
        q = rng.choice("\"'")
        cls = rng.choice(["review-element", "review-element js", "x review-element-y", "xreview-element", "other", "js review-element"])
        caption = rng.choice(["Recommended", " Not\n Recommended ", "Mixed &amp; odd", "", "a&nbsp;b"])
        name = rng.choice(["span", "a", "SPAN"])
        text = rng.choice(["good &lt;b&gt; <b>bold <i>it</i></b> end", "line<br>two",
                           "<p>para</p><p>more</p>", "", "  é😀 ", "AT & T", "*Spoiler Warning* it&#39;s"])
        body = rng.choice([f"<div class={q}text{q}>{text}</div>", f"<div id=a class=text>{text}</div>", "<p>no text</p>",
                           f"<div class='context'>{text}</div>"])
        tag = rng.choice([f"<{name} class={q}tag{q}>{caption}</{name}>", f"<{name} class={q}big tag{q}>{caption}</{name}>",
                          f"<{name} class={q}tags{q}>{caption}</{name}>", ""])
        inner = tidy_page(rng, depth + 1) if depth < 2 and rng.random() < .4 else ""
        out.append(f"<div data-x=1 class={q}{cls}{q}><div class='tags'>{tag}</div>{body}{inner}"
                   + ("</div>" if rng.random() < .95 else "") + rng.choice(["", "loose text", "</div>" if rng.random() < .1 else ""]))
    return "".join(out)


def test_equals_the_walk_on_tidy_pages(spark):
    rng = random.Random(11)
    htmls = [f"<!DOCTYPE html><html><body class='c'>{tidy_page(rng)}</body></html>" for _ in range(400)] + ["", None, "no markup"]
    df = pages_of(spark, htmls)
    assert df.where(~B.tidy(F.coalesce("html", F.lit("")))).count() == 0
    native = X.explode_boxes_native(df)
    want = {i: review_boxes(h or "") for i, h in enumerate(htmls)}
    assert boxes(native) == want
    assert sum(len(v) for v in want.values()) > 400 and any(len(v) > 6 for v in want.values())
    assert "Python" not in (plan := native._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan


def test_other_pages_go_to_the_walk(spark):
    untidy = [
        '<div class="review-element"><span><div class="text">x</span>y</div></div>',  # a span ends across a div
        '<div class="review-element"><!-- <div class="review-element"> --><div class="text">x</div></div>',
        '<script>"<div class=review-element>"</script><div class="review-element">z</div>',
        '<div class="review-element"><div class="text">a<div>b</div>c</div></div>',
        '<div class="review-element"><span class="tag"><b>Recommended</b></span></div>',
        '<div class="review-element"><div class="tag">Recommended</div></div>',
        '<div class="review-element" title="a > <b>"><div class="text">&eacute;t&eacute;</div></div>',
        '<div class="review-element"><div class="text">1 < 2</div></div>', "<div class=review-element/>x</div>"]
    tidy = ['<div class="review-element"><div class="text">x</div></div>']
    df = pages_of(spark, untidy + tidy)
    assert [r[0] for r in df.where(B.tidy(F.col("html"))).select("page_id").collect()] == [len(untidy)]
    assert boxes(X.explode_boxes_mixed(df)) == {i: review_boxes(h) for i, h in enumerate(untidy + tidy)}
    whole, walk = X.explode_boxes_mixed(df, "https://h.example"), X.explode_boxes(df, "https://h.example")
    assert whole.columns == walk.columns and sorted(map(str, whole.collect())) == sorted(map(str, walk.collect()))
