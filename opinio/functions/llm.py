"""LLM opinion as columns: prompt text (O105) and reply normalisation (O106)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NUMERIC_TEXT
from .text import ustrip

# --- fixed values -----------------------------------------------------------
# Instruction sent before the review (the model is asked for JSON with the
# keys below), and the reply keys / verdict words the normaliser reads.
PROMPT_PREFIX = (
    "Eres un clasificador de sentimiento de reseñas de anime. "
    "Clasifica la reseña del usuario como 'positiva' (recomendada) o "
    "'negativa' (no recomendada). La reseña puede estar en inglés o español. "
    "Responde ÚNICAMENTE con JSON válido con estas claves exactas: "
    "sentimiento (valor 'positiva' o 'negativa'), "
    "confianza (número entero 0-100), "
    "razon (texto breve, máximo 20 palabras).\n\n"
    'Reseña:\n"""\n'
)
PROMPT_SUFFIX = '\n"""'
KEY_VERDICT, KEY_CONFIDENCE, KEY_REASON = "sentimiento", "confianza", "razon"
JSON_POS, JSON_NEG = "pos", "neg"          # substrings of the verdict field
TEXT_POS, TEXT_NEG = "positiv", "negativ"  # stems for plain-text replies

POSITIVE, NEGATIVE, UNCERTAIN = "positive", "negative", "uncertain"
REPLY_MAP = "map<string,string>"


def prompt(text, prefix: str = PROMPT_PREFIX, suffix: str = PROMPT_SUFFIX) -> Column:
    """O105: instruction + the review in triple quotes."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(prefix), t, F.lit(suffix))


STRICT = {"allowSingleQuotes": "false"}


def _values(text: Column, kind: str) -> Column:
    """The text as the only value of a JSON array: null unless it is one complete value and nothing else."""
    a = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", STRICT)
    return F.when(F.size(a) == 1, a[0])


def _last(m: Column, key: str) -> Column:
    """The value of a key; of a repeated one the last."""
    entries = F.filter(F.map_entries(m), lambda e: e["key"] == key)
    return F.try_element_at(entries, F.lit(-1))["value"]


def parse_reply(raw) -> Column:
    """O106: struct(verdict, confidence, reason, raw) from a raw reply.

    The whole reply is read as JSON; only if it is no valid JSON of any
    kind, the span from the first '{' to the last '}' is, and that must be
    one object with nothing after it. A non-empty object decides by
    "pos"/"neg" in its verdict field and supplies confidence (number or
    numeric text) and a stripped reason; of a repeated key the last value
    counts. If that leaves the verdict open, the plain text decides:
    "positiv" without "negativ" or the reverse, else uncertain. A null
    reason stays null (the reference prints "None").
    """
    r = F.col(raw) if isinstance(raw, str) else raw
    valid = _values(r, "string").isNotNull()
    m = F.when(valid, _values(r, REPLY_MAP)).otherwise(_values(F.regexp_extract(r, r"(?s)\{.*\}", 0), REPLY_MAP))
    ok = m.isNotNull() & (F.size(m) > 0)
    sent = F.lower(ustrip(F.coalesce(_last(m, KEY_VERDICT), F.lit(""))))
    from_json = (F.when(ok & sent.contains(JSON_POS), F.lit(POSITIVE))
                  .when(ok & sent.contains(JSON_NEG), F.lit(NEGATIVE)))
    low = F.lower(F.coalesce(r, F.lit("")))
    plain = (F.when(low.contains(TEXT_POS) & ~low.contains(TEXT_NEG), F.lit(POSITIVE))
              .when(low.contains(TEXT_NEG) & ~low.contains(TEXT_POS), F.lit(NEGATIVE))
              .otherwise(F.lit(UNCERTAIN)))
    number = _last(m, KEY_CONFIDENCE)
    conf = F.when(ok & number.rlike(NUMERIC_TEXT), number.try_cast("double"))
    reason = F.when(ok & F.map_contains_key(m, KEY_REASON), ustrip(_last(m, KEY_REASON))) \
        .when(ok, F.lit("")).otherwise(F.lit(""))
    return F.struct(F.coalesce(from_json, plain).alias("verdict"),
                    conf.alias("confidence"), reason.alias("reason"),
                    r.alias("raw"))


def display_confidence(conf) -> Column:
    """LLM confidence clipped to 0-100 for display (O107)."""
    c = F.col(conf) if isinstance(conf, str) else conf
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
