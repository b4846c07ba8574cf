"""Stored LLM replies: prompts, verdict normalisation, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import llm as L
from ..operators import compare as CMP
from ..sources.fixtures import llm_replies_from
from . import sqlparts as S
from .catalog import register
from .q_evaluate import SCORED_CTES, scored


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replies(spark, sf_dir):
    return llm_replies_from(scored(spark, sf_dir), "seq")


def verdicts(spark, sf_dir):
    return CMP.normalise_replies(replies(spark, sf_dir))


_N = "CAST(length(text) % 101 AS VARCHAR)"
_K = "CAST(length(text) % 7 AS VARCHAR)"
_SPAN = r"regexp_extract(raw, '(?s)\{.*\}', 0)"
_LJ = "json_extract_string"
# of a repeated key the last value
_LAST = """regexp_extract_all(j, '"sentimiento": "([^"]*)"', 1)[-1]"""
REPLY_CTES = f"""{SCORED_CTES},
rep AS (SELECT seq AS id, CASE
  WHEN seq % 13 = 0 THEN '{{"sentimiento": "positiva", "confianza": ' || {_N} || ', "razon": "  Tono favorable (' || {_K} || ').  "}}'
  WHEN seq % 13 = 1 THEN '{{"sentimiento": "Negativa", "confianza": "' || {_N} || '", "razon": "Critica el ritmo"}}'
  WHEN seq % 13 = 2 THEN 'Claro, aqui va:' || chr(10) || '{{"sentimiento": "POSITIVA",' || chr(10) || ' "confianza": ' || {_N} || ', "razon": "ok"}}' || chr(10) || 'Espero que ayude.'
  WHEN seq % 13 = 3 THEN '{{''sentimiento'': ''positiva'', ''confianza'': ' || {_N} || '}}'
  WHEN seq % 13 = 4 THEN 'La reseña es negativa.'
  WHEN seq % 13 = 5 THEN 'No es del todo positiva ni negativa.'
  WHEN seq % 13 = 6 THEN '{{}}'
  WHEN seq % 13 = 7 THEN '{{"sentimiento": "mixta", "confianza": null, "razon": null}}'
  WHEN seq % 13 = 8 THEN '[{{"sentimiento": "positiva", "confianza": ' || {_N} || '}}]'
  WHEN seq % 13 = 9 THEN '{{"sentimiento": "positiva", "sentimiento": "negativa", "confianza": ' || {_N} || '}}'
  WHEN seq % 13 = 10 THEN '{{"sentimiento": "negativa", "confianza": "' || {_N} || 'f"}}'
  ELSE '{{"sentimiento": "positiva", "confianza": ' || {_N} || '}} y {{"sentimiento": "negativa"}}' END AS raw
  FROM scored WHERE seq % 13 <> 12),
js AS (SELECT id, raw, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN raw END
  WHEN json_valid({_SPAN}) AND json_type({_SPAN}) = 'OBJECT' THEN {_SPAN} END AS j FROM rep),
js2 AS (SELECT *, j IS NOT NULL AND len(json_keys(j)) > 0 AS ok,
  lower({S.strip(f"coalesce({_LAST}, '')")}) AS sent FROM js),
ver AS (SELECT id, coalesce(
    CASE WHEN ok AND sent LIKE '%pos%' THEN 'positive' WHEN ok AND sent LIKE '%neg%' THEN 'negative' END,
    CASE WHEN lower(raw) LIKE '%positiv%' AND lower(raw) NOT LIKE '%negativ%' THEN 'positive'
         WHEN lower(raw) LIKE '%negativ%' AND lower(raw) NOT LIKE '%positiv%' THEN 'negative'
         ELSE 'uncertain' END) AS verdict,
  CASE WHEN ok THEN try_cast({_LJ}(j, '$.confianza') AS DOUBLE) END AS confidence,
  CASE WHEN ok AND json_extract(j, '$.razon') IS NOT NULL THEN {S.strip(f"{_LJ}(j, '$.razon')")}
       ELSE '' END AS reason, raw FROM js2),
sbs AS (SELECT s.seq AS id, s.score,
  CASE WHEN s.score >= 0.6 THEN 'positive' WHEN s.score <= 0.45 THEN 'negative' ELSE 'mixed' END AS band,
  CASE WHEN s.score >= 0.6 THEN least(1.0, greatest(0.0, s.score)) * 100.0
       WHEN s.score <= 0.45 THEN 100.0 - least(1.0, greatest(0.0, s.score)) * 100.0 END AS model_conf_pct,
  v.verdict, least(100.0, greatest(0.0, v.confidence)) AS llm_conf_pct
  FROM scored s LEFT JOIN ver v ON s.seq = v.id)"""


@register("llm_verdicts", f"WITH {REPLY_CTES}\nSELECT * FROM ver")
def llm_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


@register("llm_prompts", f"""WITH {SCORED_CTES}
SELECT seq AS id, {_lit(L.PROMPT_PREFIX)} || text || {_lit(L.PROMPT_SUFFIX)} AS prompt FROM scored""")
def llm_prompts(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("seq").alias("id"),
                                        L.prompt("text").alias("prompt"))


def _sbs(spark, sf_dir):
    return CMP.side_by_side(scored(spark, sf_dir).withColumnRenamed("seq", "id"),
                            verdicts(spark, sf_dir))


@register("model_vs_llm", f"""WITH {REPLY_CTES}
SELECT band, verdict, count(*) AS n FROM sbs GROUP BY band, verdict""")
def model_vs_llm(spark, sf_dir):
    return CMP.agreement_matrix(_sbs(spark, sf_dir))


@register("llm_disagreements", f"""WITH {REPLY_CTES}
SELECT id, score, band, model_conf_pct, verdict, llm_conf_pct FROM sbs
WHERE (band = 'positive' AND verdict = 'negative') OR (band = 'negative' AND verdict = 'positive')""")
def llm_disagreements(spark, sf_dir):
    return CMP.disagreements(_sbs(spark, sf_dir)).select(
        "id", "score", "band", "model_conf_pct", "verdict", "llm_conf_pct")
