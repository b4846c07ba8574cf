"""Reading the parquet tables (column pruning/pushdown happen at the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def concat_sources(frames, text_col: str = "text",
                   order_col: str = "seq") -> DataFrame:
    """Bag union of several sources in the given order.

    Each source is tagged with its position ``src_ord``; the combined order
    is (src_ord, seq). Sources lacking the text column are skipped, like the
    reference's corpus reader does.
    """
    parts = []
    for i, f in enumerate(frames):
        if f is None or text_col not in f.columns:
            continue
        parts.append(f.select(F.lit(i).alias("src_ord"),
                              F.col(order_col).cast("long").alias(order_col),
                              F.col(text_col).alias(text_col)))
    if not parts:
        raise ValueError("no usable source")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
