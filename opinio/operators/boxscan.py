"""O17 as expressions: review boxes of tidy pages without a Python step.

The page is split before each ``div`` tag. A fold over the pieces counts the
depth and keeps the boxes that are open, so nested boxes come out as their
ranges of pieces; tags, head and text of a box are then expressions on its
own markup. This equals the walk of ``htmlboxes`` on pages that pass ``tidy``:
markup made of whole tags and the six common character references, no raw-text
elements, captions and texts without markup that the expressions would have to
nest. Other pages are for the walk (``explode_boxes_mixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip

#: The references decoded here, the box, caption and text classes as the walk knows them.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
BOX, CAPTION, TEXT = "review-element", "tag", "text"

_NAME = r"[a-zA-Z][a-zA-Z0-9]*"
_ATTRS = r"""(?:\s+(?:[^\s<>"'=/]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"'=/]+))?))*\s*"""
TAG = rf"<(?:/{_NAME}\s*|{_NAME}{_ATTRS}|![a-zA-Z][^<>]*)>"
_CLASS = r"""(?i)^<[a-z0-9]+(?:\s[^<>]*?)??\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s<>"']+)"""
VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
_PAIR = rf"<({_NAME})(?:\s[^<>]*)?>[^<>]*</\1\s*>"
_CAPTION = r"(?i)<(?:span|a)(?:\s[^<>]*)?>[^<>]*</(?:span|a)\s*>"


def class_of(tag: Column) -> Column:
    """The class attribute of the tag that a piece of markup begins with, '' without one."""
    return F.btrim(F.regexp_extract(tag, _CLASS, 1), F.lit("\"'"))


def _has_class(tag: Column, name: str) -> Column:
    return F.array_contains(F.split(class_of(tag), r"\s+"), name)


def _pieces(html: Column) -> Column:
    return F.split(html, r"(?i)(?=</?div[\s>])", -1)


def _is_close(piece: Column) -> Column:
    return piece.rlike(r"(?i)^</div")


def _is_open(piece: Column) -> Column:
    return piece.rlike(r"(?i)^<div")


def _is_box(piece: Column) -> Column:
    return _is_open(piece) & class_of(piece).rlike(rf"(?<![\p{{L}}\p{{N}}_]){BOX}(?![\p{{L}}\p{{N}}_])")


def text_of(markup: Column) -> Column:
    """All text below: text nodes decoded, stripped, those left joined with one blank."""
    def decoded(t):
        for ref, char in REFERENCES.items():
            t = F.replace(t, F.lit(ref), F.lit(char))
        return ustrip(t)
    return F.array_join(F.filter(F.transform(F.split(markup, TAG, -1), decoded), lambda t: t != ""), " ")


def box_ranges(pieces: Column) -> Column:
    """(first piece, piece after the last) of each box, in document order."""
    kinds = F.transform(pieces, lambda p, i: F.struct(
        i.alias("i"), F.when(_is_close(p), -1).when(_is_open(p), 1).otherwise(0).alias("step"), _is_box(p).alias("box")))
    kind = "array<struct<d:int,s:int,e:int>>"
    start = F.struct(F.lit(0).alias("depth"), F.array().cast(kind).alias("open"), F.array().cast(kind).alias("done"))

    def fold(a, x):
        last = F.try_element_at(a["open"], F.lit(-1))
        ends = (x["step"] == -1) & (a["depth"] > 0) & F.coalesce(last["d"] == a["depth"], F.lit(False))
        new = F.array(F.struct((a["depth"] + 1).alias("d"), x["i"].alias("s"), F.lit(0).alias("e")))
        over = F.array(F.struct(last["d"].alias("d"), last["s"].alias("s"), x["i"].alias("e")))
        return F.struct(
            F.greatest(F.lit(0), a["depth"] + x["step"]).alias("depth"),
            F.when(x["box"], F.concat(a["open"], new)).when(ends, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1))
             .otherwise(a["open"]).alias("open"),
            F.when(ends, F.concat(a["done"], over)).otherwise(a["done"]).alias("done"))

    def finish(a):
        left = F.transform(a["open"], lambda b: F.struct(b["d"].alias("d"), b["s"].alias("s"), F.size(pieces).alias("e")))
        return F.array_sort(F.transform(F.concat(a["done"], left), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))

    return F.aggregate(kinds, start, fold, finish)


def tidy(html: Column) -> Column:
    """Whether the expressions see the page as the walk does."""
    rest = F.regexp_replace(html, TAG, "")
    refs = F.regexp_replace(html, "|".join(REFERENCES), "")
    bare = F.regexp_replace(html, rf"(?i)<(?:{VOID})(?:\s[^<>]*)?>", "")
    pieces = F.transform(_pieces(bare), lambda p: F.regexp_replace(p, r"(?i)^</?div[^<>]*>", ""))
    inner = pieces
    for _ in range(4):  # elements in elements, as deep as captions and paragraphs go
        inner = F.transform(inner, lambda p: F.regexp_replace(p, _PAIR, ""))
    crossed = F.exists(F.slice(inner, F.lit(1), F.greatest(F.lit(0), F.size(inner) - 1)), lambda p: p.contains("</"))
    captions = F.regexp_replace(html, _CAPTION, "")  # what is left of captions is not plain
    odd = captions.rlike(rf"""(?i)<(?:span|a)\s[^<>]*class\s*=\s*["']?[^"'<>]*(?<![\w-]){CAPTION}(?![\w-])""") | html.rlike(
        rf"""(?i)<div\s[^<>]*class\s*=\s*["']?[^"'<>]*(?<![\w-]){CAPTION}(?![\w-])""")
    nested = html.rlike(rf"""(?i)<div\s[^<>]*class\s*=\s*["']?[^"'<>]*(?<![\w-]){TEXT}(?![\w-])[^<>]*>(?:(?!</?div[\s>])(?s:.))*<div[\s>]""")
    return ~(rest.contains("<") | refs.rlike("&[a-zA-Z#]") | html.rlike(r"(?i)<(?:script|style|template|title|textarea|xmp|iframe|noembed|noframes|plaintext|noscript)[\s>]|\x00")
             | crossed | odd | nested)


def scanned(facts: DataFrame, head_chars: int = 260) -> DataFrame:
    """The boxes of pages (page_id, blocked, main_entity, slug, html) as ``explode_boxes`` gives them."""
    names = ["page_id", "blocked", "main_entity", "slug"]
    d = facts.select(*names, _pieces(F.coalesce("html", F.lit(""))).alias("pieces"))
    d = d.select(*names, "pieces", F.posexplode_outer(box_ranges(F.col("pieces"))).alias("box_pos", "r"))
    first = F.regexp_replace(F.col("pieces")[F.col("r.s")], "^<[^<>]*>", "")
    rest = F.slice("pieces", F.col("r.s") + 2, F.greatest(F.lit(0), F.col("r.e") - F.col("r.s") - 1))
    d = d.select(*names, "box_pos", F.when(F.col("r").isNotNull(), F.concat(F.array(first), rest)).alias("own"))
    d = d.select(*names, "box_pos", F.array_join("own", "").alias("markup"),
                 F.filter("own", lambda p: _is_open(p) & _has_class(p, TEXT)).alias("texts"))
    tags = F.transform(F.filter(F.regexp_extract_all(F.col("markup"), F.lit(_CAPTION), F.lit(0)),
                                lambda t: _has_class(t, CAPTION)), text_of)
    return d.select(*names, F.col("box_pos").cast("int").alias("box_pos"), tags.alias("tags"),
                    F.left(text_of(F.col("markup")), F.lit(head_chars)).alias("head"),
                    text_of(F.try_element_at("texts", F.lit(1))).alias("body"))
