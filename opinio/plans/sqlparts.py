"""DuckDB SQL fragments mirroring the Column helpers (for the oracle)."""

from __future__ import annotations

from ..schema import NUMERIC_TEXT, WS_CODEPOINTS

WS = "(" + "||".join(f"chr({c})" for c in WS_CODEPOINTS) + ")"
RE2_WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '{RE2_WS}+', ' ', 'g')"


def label(x: str) -> str:
    v = f"try_cast(CAST({x} AS VARCHAR) AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{NUMERIC_TEXT}') "
            f"AND {v} IN (0, 1) THEN CAST({v} AS INTEGER) END)")


def seeded_hash(seed, id_expr: str, salt: str = "") -> str:
    return f"md5(concat('{seed}|{salt}', CAST({id_expr} AS VARCHAR)))"


REVIEWS_RAW = """reviews_raw AS (
  SELECT d.doc_id*2 AS seq, d.lang AS entity_id,
    CASE WHEN d.doc_id%29=0 THEN CAST(NULL AS VARCHAR)
         WHEN d.doc_id%31=0 THEN '   ' ELSE d.text END AS text,
    CASE WHEN d.doc_id%17=0 THEN 'x' WHEN d.doc_id%19=0 THEN '2'
         WHEN d.doc_id%23=0 THEN CAST(NULL AS VARCHAR)
         WHEN d.doc_id%7=0 THEN concat(CAST(coalesce(l.quality, d.doc_id%2) AS VARCHAR), '.0')
         ELSE CAST(coalesce(l.quality, d.doc_id%2) AS VARCHAR) END AS label,
    CASE WHEN d.doc_id%6 <> 5 THEN '  ' || ['Recommended', 'Not Recommended', 'Mixed Feelings',
      'recommended  Spoiler'][d.doc_id%4 + 1] || ' ' END AS marker
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT d.doc_id*2+1, d.lang, concat('  ', replace(d.text,' ','   '), ' '),
         CAST(d.doc_id%2 AS VARCHAR), NULL
  FROM documents d WHERE d.doc_id%10 = 3)"""
REVIEWS_NEG = """reviews_neg AS (
  SELECT doc_id*2 + 1000000000000 AS seq, lang AS entity_id, 'Negative: ' || text AS text,
    CASE WHEN doc_id%13 = 0 THEN 'x' ELSE '0' END AS label, ' Not Recommended' AS marker
  FROM documents WHERE doc_id%3 = 1)"""


def filtered(src: str = "reviews_raw", min_chars: int = 25, lower: bool = True,
             name: str = "filtered") -> str:
    t = f"lower({strip('text')})" if lower else strip("text")
    return f"""{name}_0 AS (
  SELECT seq, entity_id, {t} AS text, {label('label')} AS label, lower({strip('marker')}) AS marker FROM {src}
  WHERE entity_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
{name} AS (
  SELECT * FROM {name}_0 WHERE text <> '' AND label IS NOT NULL
    AND length(text) >= {int(min_chars)})"""


def keep_first(src: str, keys: str, name: str, cols: str = "*") -> str:
    return f"""{name} AS (
  SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
    ORDER BY seq) AS _rn FROM {src}) WHERE _rn = 1)"""


def clean_ctes(min_chars: int = 25) -> str:
    return ",\n".join([
        REVIEWS_RAW, filtered("reviews_raw", min_chars),
        keep_first("filtered", f"entity_id, {norm('text')}", "clean",
                   "seq, entity_id, text, label, marker")])


def clean_neg_ctes(min_chars: int = 25) -> str:
    return ",\n".join([
        REVIEWS_NEG, filtered("reviews_neg", min_chars, name="filtered_neg"),
        keep_first("filtered_neg", f"entity_id, {norm('text')}", "clean_neg",
                   "seq, entity_id, text, label, marker")])
