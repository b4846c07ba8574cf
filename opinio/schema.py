"""Data model (StructTypes) and fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

PRF = T.StructType([T.StructField(n, T.DoubleType())
                    for n in ("precision", "recall", "f1")])

# Metrics document (training-eval variant; the standalone variant leaves
# ``loss``/``macro`` null and fills ``n_errors``/``n_test``).
METRICS = T.StructType([
    T.StructField("loss", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("per_class", T.StructType([
        T.StructField("negative", PRF), T.StructField("positive", PRF)])),
    T.StructField("weighted", PRF),
    T.StructField("macro", PRF),
    T.StructField("confusion_matrix",
                  T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("n_errors", T.LongType()),
    T.StructField("n_test", T.LongType()),
])

# --- fixed values -----------------------------------------------------------
# Literal cell values the reference's CSV reader turns into null (pandas 2.x
# default NA strings), in natural order.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The 29 code points Python's str.strip()/str.split() treat as whitespace.
WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
     0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)

# The same set as a Java regex class (Java's \s covers only the ASCII six).
WS_CLASS = (r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029"
            r"\u202f\u205f\u3000]")

# Numbers pandas.to_numeric accepts from text (Spark would also take '1d').
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Special token ids of the vocabulary.
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
N_SPECIAL = 5
