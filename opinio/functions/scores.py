"""Score scalars: sigmoid, clip, hard prediction, three-band verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c) -> Column:
    """Logit to probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def clip01(c) -> Column:
    """Clip to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(c).cast("double")))


def hard_pred(c, threshold: float = 0.5) -> Column:
    """Hard prediction ``score >= threshold`` as 0/1 (O82); null for a null or NaN score."""
    x = _c(c)
    return F.when(is_score(x), F.when(x >= F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0)))


def is_score(c) -> Column:
    """Whether there is a score at all: neither null nor NaN."""
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def check_band_thresholds(neg_thr: float, pos_thr: float) -> None:
    """Parameter rules of the three-band verdict."""
    if not 0.20 <= neg_thr <= 0.50:
        raise ValueError(f"negative threshold {neg_thr} outside [0.20, 0.50]")
    if not 0.50 <= pos_thr <= 0.85:
        raise ValueError(f"positive threshold {pos_thr} outside [0.50, 0.85]")
    if not neg_thr < pos_thr:
        raise ValueError("negative threshold must be below the positive one")


def band(c, neg_thr: float = 0.45, pos_thr: float = 0.60) -> Column:
    """Three-band verdict struct (O83): band, confidence %, positivity %.

    Positive is tested first; ``mixed`` carries no confidence.
    """
    check_band_thresholds(neg_thr, pos_thr)
    p = _c(c)
    pct = clip01(p) * F.lit(100.0)
    b = (F.when(p >= F.lit(pos_thr), F.lit("positive"))
         .when(p <= F.lit(neg_thr), F.lit("negative"))
         .otherwise(F.lit("mixed")))
    conf = (F.when(p >= F.lit(pos_thr), pct)
            .when(p <= F.lit(neg_thr), F.lit(100.0) - pct))
    return F.struct(b.alias("band"), conf.alias("confidence_pct"),
                    pct.alias("positivity_pct"))
