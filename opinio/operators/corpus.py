"""Unlabelled corpus for masked-LM pre-training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_hash, ustrip
from ..sources.tables import concat_sources
from .dedupe import keep_first


def build_corpus(frames, text_col: str = "text", order_col: str = "seq",
                 min_len: int = 30, max_samples: int = 0) -> DataFrame:
    """Concatenate sources in order, keep stripped texts longer than
    ``min_len`` (strict), dedupe on ``lower(text)`` keeping the first across
    sources, then optionally keep the first ``max_samples`` (0 = all).

    Output (src_ord, seq, text). A null text reads as "nan" like the
    reference's ``astype(str)`` and so falls to the length test.
    """
    u = concat_sources(frames, text_col, order_col)
    t = ustrip(F.coalesce(F.col(text_col), F.lit("nan")))
    u = (u.withColumn(text_col, t)
          .filter(F.length(text_col) > F.lit(int(min_len)))
          .withColumn("_key", key_hash(F.lower(text_col))))
    # (source, ordinal) is unique across the union
    out = keep_first(u, ["_key"], ["src_ord", order_col]).drop("_key")
    if max_samples and max_samples > 0:
        out = out.orderBy("src_ord", order_col).limit(int(max_samples))
    return out
