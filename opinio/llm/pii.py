r"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Only SQL functions. Per kind a pattern proposes spans, leftmost and not
overlapping; a validator (Luhn, mod-97, ranges, numbers of digits) confirms
or drops each, without a retry inside a dropped one; then words within
``CONTEXT`` characters raise or lower the kind's prior score. The kinds of
the base (email, ip, card, phone) stay whatever their score; those that the
method adds (iban, shortcard, ssn) are kept from ``MIN_SCORE`` on.

Offsets are code points, ends exclusive. They come from the lengths of the
pieces between the matches, added up in blocks, so that a text with very
many matches costs little more than its length. The patterns use possessive
loops and start only where a run starts: each pattern reads a text once,
however long a run of its characters is. An IBAN is proposed at its
country's length, so that groups behind it are left out.

Cases: null and empty texts have no spans; repeated rows are judged alike;
columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, read

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "shortcard", "ssn")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The length of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}


def iban_pattern() -> str:
    """Groups of four as far as the country's length; of a country not listed, as far as groups go."""
    listed = [f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
              + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, countries in IBAN_LENGTHS.items()]
    return "|".join([*listed, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"])


#: \G: a match may also start right where the last one ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A cheap test that a text can hold a match at all.
HINTS = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "shortcard": 0.4, "ssn": 0.4}
MIN_SCORE = 0.6
CONTEXT = 40
RAISE, LOWER = 0.3, 0.3
RAISED_BY = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|whatsapp",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "shortcard": r"card|visa|credit|debit|amex|payment|karte|carte|tarjeta",
    "ssn": r"ssn|social security|taxpayer",
}
LOWERED_BY = {
    "ip": r"version|release|section|chapter",
    "card": r"isbn|order no|serial|tracking",
    "shortcard": r"isbn|order no|serial|tracking",
}
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks of BLOCK elements."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    starts = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
    return let(starts, lambda s: F.transform(lengths, lambda _, i: (
        F.get(s, F.floor(i / BLOCK).cast("int"))
        + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))


def proposed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def placed(m: Column, p: Column) -> Column:
        before = let(F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("long")), sums_before)
        return let(before, lambda b: F.transform(m, lambda x, i: F.struct(
            (F.get(b, i) + F.length(F.get(p, i))).alias("start"),
            (F.get(b, i) + F.length(F.get(p, i)) + F.length(x)).alias("end"), x.alias("match"))))

    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(between, lambda p: placed(m, p))))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    def value(i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN's number (letters are 10 to 35, the first four characters go last)."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(a, c):
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def confirmed(kind: str, text: Column, s: Column) -> Column:
    """Whether the checks of the kind hold for a proposed span."""
    m = s["match"]
    n = F.length(digits(m))
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "shortcard":
        return F.when(n.between(13, 15), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    before = F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))).otherwise("")
    after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
    alone = ~F.concat(before, after).rlike("[A-Za-z0-9]")
    if kind == "iban":
        bare = F.regexp_replace(m, "\\x20", "")
        return alone & F.length(bare).between(15, 34) & (mod97(bare) == 1)
    if kind == "ssn":
        return alone & ~m.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def scored(kind: str, text: Column, s: Column) -> Column:
    """The prior of the kind, raised or lowered by words around the span."""
    near = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - CONTEXT + 1).cast("int"),
                               (s["end"] - s["start"] + 2 * CONTEXT).cast("int")))
    score = F.lit(PRIOR[kind]) + F.when(near.rlike(RAISED_BY[kind]), RAISE).otherwise(0.0)
    if kind in LOWERED_BY:
        score = score - F.when(near.rlike(LOWERED_BY[kind]), LOWER).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 3)))


def spans(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start."""
    pattern = "card" if kind == "shortcard" else kind
    can = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(pattern)
    can = can if can is not None else text.rlike(HINTS[pattern])
    none = F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>")
    right = F.filter(proposed(text, PATTERNS[pattern]), lambda s: confirmed(kind, text, s))
    named = F.transform(right, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                  scored(kind, text, s).alias("score")))
    if kind not in BASE_KINDS:
        named = F.filter(named, lambda s: s["score"] >= MIN_SCORE)
    return F.when(can, named).otherwise(none)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text and one array of spans per kind."""
    d = narrow(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", "text", *[spans(k, F.col("text")).alias(f"s_{k}") for k in KINDS])


def redacted(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id and the text with every span (earlier and longer ones first) replaced by ``[kind]``."""
    every = F.array_sort(F.concat(*[F.transform(f"s_{k}", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))) for k in KINDS if k not in keep]))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(a, s):
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["done"], gap, F.lit("["), s["kind"], F.lit("]")).alias("done"), (-s["to"]).alias("at")))

    return found(docs).select("doc_id", F.aggregate(every, start, step, lambda a: F.concat(
        a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    def listed(kinds) -> Column:
        return F.concat_ws(",", F.transform(F.concat(*[F.col(f"s_{k}") for k in kinds]), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found(docs).select(
        "doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(BASE_KINDS), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


#: The base's patterns as the contract states them.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PATTERNS["iban"],
    "shortcard": r"[0-9]([\x20-]?[0-9])+",
    "ssn": PATTERNS["ssn"],
}
_LUHN = """list_sum([CASE WHEN i % 2 = 0 THEN CAST(dg[len(dg) - i] AS INT) ELSE CAST(dg[len(dg) - i] AS INT) * 2
  - CASE WHEN CAST(dg[len(dg) - i] AS INT) > 4 THEN 9 ELSE 0 END END for i in range(0, len(dg))]) % 10 = 0"""
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
_SCORE = "CASE kind " + " ".join(
    f"WHEN '{k}' THEN {PRIOR[k]} + CASE WHEN regexp_matches(near, '{RAISED_BY[k]}') THEN {RAISE} ELSE 0 END"
    + (f" - CASE WHEN regexp_matches(near, '{LOWERED_BY[k]}') THEN {LOWER} ELSE 0 END" if k in LOWERED_BY else "")
    for k in KINDS) + " END"
ORACLE_SQL = f"""
WITH k(kind, pat) AS (VALUES {", ".join(f"('{k}', '{p}')" for k, p in _SQL_PATTERNS.items())}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, kind, regexp_extract_all(text, pat) AS f, string_split_regex(text, pat) AS p FROM d, k),
l AS (SELECT doc_id, text, kind, f, p, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, text, kind, f[i] AS hit, regexp_replace(f[i], '[^0-9]', '', 'g') AS dg,
        CAST(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in f[1:i - 1]]), 0) AS BIGINT) AS a
      FROM l),
c AS (SELECT *, a + length(hit) AS b, replace(hit, ' ', '') AS bare,
        lower(substring(text, greatest(1, a - {CONTEXT} + 1), length(hit) + 2 * {CONTEXT})) AS near,
        (CASE WHEN a > 0 THEN substring(text, a, 1) ELSE '' END) || substring(text, a + length(hit) + 1, 1) AS edge FROM s),
v AS (SELECT *, {_SCORE} AS score FROM c WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len([x for x in string_split(hit, '.') if length(ltrim(x, '0')) > 3
                        or coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255]) = 0
    WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND {_LUHN}
    WHEN 'shortcard' THEN length(dg) BETWEEN 13 AND 15 AND {_LUHN}
    WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15
    WHEN 'iban' THEN NOT regexp_matches(edge, '[A-Za-z0-9]') AND length(bare) BETWEEN 15 AND 34 AND
      list_reduce(list_prepend(0, [CASE WHEN x BETWEEN '0' AND '9' THEN CAST(x AS INT) ELSE ascii(x) - 55 END
        for x in string_split(bare[5:] || bare[1:4], '')]),
        lambda r, x: CASE WHEN x < 10 THEN (r * 10 + x) % 97 ELSE (r * 100 + x) % 97 END) = 1
    ELSE NOT regexp_matches(edge, '[A-Za-z0-9]') AND NOT regexp_matches(hit, '^(?:000|666|9)|-00-|0000$') END),
w AS (SELECT * FROM v WHERE kind IN ('email', 'ip', 'card', 'phone') OR round(score, 3) >= {MIN_SCORE}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
        count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {_KIND}, a) FILTER (kind IN ('email', 'ip', 'card', 'phone')) AS base,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {_KIND}, a) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
