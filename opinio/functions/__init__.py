"""Column-level helpers (all JVM-side Spark SQL expressions)."""

from .text import (coerce_label, collapse_ws, key_hash, na_to_null, norm_key,
                   ustrip)
from .scores import band, clip01, hard_pred, sigmoid

__all__ = ["coerce_label", "collapse_ws", "key_hash", "na_to_null", "norm_key",
           "ustrip", "band", "clip01", "hard_pred", "sigmoid"]
