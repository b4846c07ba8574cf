"""Text scalars: Unicode strip, normalised dedupe key, key hashing, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NA_TOKENS, NUMERIC_TEXT, WS_CHARS, WS_CLASS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip the 29 Unicode whitespace code points from both ends.

    ``trim`` only removes the plain blank, so the character set is explicit.
    """
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Every run of Unicode whitespace becomes one blank."""
    return F.regexp_replace(_c(c), WS_CLASS + "+", " ")


def norm_key(c) -> Column:
    """Normalised text key (O35): strip, lower-case, collapse whitespace."""
    return collapse_ws(F.lower(ustrip(c)))


def key_hash(c) -> Column:
    """128-bit digest of a key, used to group/shuffle instead of the text.

    16 bytes per row instead of the whole review; collision odds at 1e11
    rows are ~1e-17.
    """
    return F.unhex(F.md5(_c(c)))


def na_to_null(c) -> Column:
    """CSV literal NA tokens become null, as the reference's reader does."""
    c = _c(c)
    return F.when(c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)


def coerce_label(c) -> Column:
    """Label text/number to INT when it is numerically 0 or 1, else null.

    ``"1.0"`` is 1; ``"x"``, ``"2"``, ``"1d"`` are null.
    """
    s = _c(c).cast("string")
    v = F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))
    return F.when(v.isin(0.0, 1.0), v.cast("int"))
