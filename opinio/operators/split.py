"""Exact stratified train/val/test split.

Sizes: test = ceil(test_size * N); per label the floor of its share, the
left-over rows to the largest remainders (ties to the smaller label); val
is ``val_size`` of what remains, same rule. Rows are ranked per label by a
seeded digest and cut at those sizes (see ``rank.assign_bands``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import assign_bands, seeded_hash


def _apportion(counts: DataFrame, total_col: str, n_col: str,
               out_col: str) -> DataFrame:
    """Largest-remainder split of ``total_col`` over labels by ``n_col``.

    ``counts`` has one row per label, so the unpartitioned windows here run
    over a handful of rows."""
    w_all = Window.partitionBy()
    share = (F.col(total_col) * F.col(n_col)
             / F.sum(n_col).over(w_all).cast("double"))
    c = counts.withColumn("_sh", share).withColumn("_fl", F.floor("_sh"))
    c = c.withColumn("_rem", F.col("_sh") - F.col("_fl"))
    left = F.col(total_col) - F.sum("_fl").over(w_all)
    pos = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rem"), "label"))
    return (c.withColumn(out_col, (F.col("_fl") + F.when(pos <= left, 1)
                                   .otherwise(0)).cast("long"))
             .drop("_sh", "_fl", "_rem"))


def split_sizes(df: DataFrame, test_size: float = 0.2,
                val_size: float = 0.1) -> DataFrame:
    """(label, n, n_test, n_val, n_train): a row per label (tiny table)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy()
    c = counts.withColumn("_t", F.ceil(F.lit(float(test_size))
                                       * F.sum("n").over(w_all)))
    c = _apportion(c, "_t", "n", "n_test")
    c = c.withColumn("_rest", F.col("n") - F.col("n_test"))
    c = c.withColumn("_v", F.ceil(F.lit(float(val_size))
                                  * F.sum("_rest").over(w_all)))
    c = _apportion(c, "_v", "_rest", "n_val")
    return c.select("label", "n", "n_test", "n_val",
                    (F.col("n") - F.col("n_test") - F.col("n_val"))
                    .alias("n_train"))


def stratified_split(df: DataFrame, seed: int = 42, test_size: float = 0.2,
                     val_size: float = 0.1, id_col: str = "seq") -> DataFrame:
    """Add ``split`` in {train, val, test} (O55 + O56).

    The per-label sizes are a table of one row per label, however many
    labels there are; its bands are joined to the rows.
    """
    n, t, v = F.col("n"), F.col("n_test"), F.col("n_test") + F.col("n_val")

    def band(name, lo, hi):
        return F.struct(F.lit(name).alias("band"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    bands = split_sizes(df, test_size, val_size).select("label", F.explode(F.array(
        band("test", F.lit(0), t), band("val", t, v), band("train", v, n))).alias("b")).select("label", "b.*")
    return assign_bands(df, ["label"], seeded_hash(seed, id_col), id_col, bands, "split")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per (split, label)."""
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
