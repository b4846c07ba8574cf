"""Model verdict vs LLM verdict, side by side (O107)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.llm import display_confidence, parse_reply
from ..functions.scores import band


def normalise_replies(replies: DataFrame, id_col: str = "id",
                      raw_col: str = "raw") -> DataFrame:
    """O106 over a table of stored replies."""
    return replies.select(id_col, parse_reply(raw_col).alias("v")).select(
        id_col, "v.verdict", "v.confidence", "v.reason", "v.raw")


def side_by_side(scored: DataFrame, verdicts: DataFrame, id_col: str = "id",
                 score_col: str = "score", neg_thr: float = 0.45,
                 pos_thr: float = 0.60) -> DataFrame:
    """Model bands beside the LLM verdicts of the same document; a document
    without a reply keeps its band, with a null verdict and no agreement."""
    m = scored.select(id_col, score_col, band(score_col, neg_thr, pos_thr)
                      .alias("b")).select(id_col, score_col, F.col("b.band").alias("band"),
                                          F.col("b.confidence_pct").alias("model_conf_pct"))
    v = verdicts.select(id_col, "verdict",
                        display_confidence("confidence").alias("llm_conf_pct"))
    j = m.join(v, id_col, "left")
    agree = ((F.col("band") == "positive") & (F.col("verdict") == "positive")) | \
            ((F.col("band") == "negative") & (F.col("verdict") == "negative"))
    return j.withColumn("agree", F.coalesce(agree, F.lit(False)))


def agreement_matrix(sbs: DataFrame) -> DataFrame:
    return sbs.groupBy("band", "verdict").agg(F.count(F.lit(1)).alias("n"))


def disagreements(sbs: DataFrame) -> DataFrame:
    """Rows where the model and the LLM take opposite sides."""
    opp = ((F.col("band") == "positive") & (F.col("verdict") == "negative")) | \
          ((F.col("band") == "negative") & (F.col("verdict") == "positive"))
    return sbs.filter(opp)
