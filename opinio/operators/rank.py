"""Exact, seeded, partition-independent ranking at scale.

A global ``row_number()`` runs in a single task. Instead every row gets a
seeded digest ``h = md5(seed | id)``; its first hex digits name a bucket.
Per (stratum, bucket) counts form a small table (strata x 2^16 rows at most,
a proven bound) whose running sums give each bucket's rank offset. Rows are
ranked by (h, id) within their bucket only, so no task sees more than
~1/65536 of a stratum, and rank = offset + local row number equals the rank
of a global sort by (h, id).

For cuts (take the first n, split into bands) no row is ranked at all but
those of the few buckets that straddle a cut: they give the (h, id) at which
the cut falls, and every row is then compared with the cuts of its stratum.
Texts are never shuffled for it; the cuts are a handful of rows per stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, staged

BUCKET_HEX = 4  # 16 bits -> 65,536 buckets per stratum


def seeded_hash(seed, id_col: str, salt: str = "") -> Column:
    """md5 hex of ``'{seed}|{salt}{id}'`` (same digest in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|{salt}"),
                          F.col(id_col).cast("string")))


def _bucketed(df: DataFrame, h: Column) -> DataFrame:
    return (df.withColumn("_h", h)
              .withColumn("_b", F.substring("_h", 1, BUCKET_HEX)))


def bucket_offsets(df_b: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata…, _b, _n, _off): bucket sizes and their starting rank."""
    counts = df_b.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*strata).orderBy("_b")
         .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_off",
                             F.coalesce(F.sum("_n").over(w), F.lit(0)))


def with_rank(df: DataFrame, strata: Sequence[str], h: Column,
              id_col: str | Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Exact 0-based rank of every row within its stratum by (h, id); the id is a column or several expressions."""
    if not strata:
        return with_rank(df.withColumn("_s", F.lit(0)), ["_s"], h, id_col,
                         rank_col).drop("_s")
    d = _bucketed(df, h)
    offs = small(staged(bucket_offsets(d, strata).drop("_n"), "rank-offsets"))
    d = d.join(offs, on=[*strata, "_b"])
    w = Window.partitionBy(*strata, "_b").orderBy("_h", *([id_col] if isinstance(id_col, str) else id_col))
    return (d.withColumn(rank_col, F.row_number().over(w) - 1 + F.col("_off"))
             .drop("_h", "_b", "_off"))


def cut_points(df: DataFrame, strata: Sequence[str], h: Column, id_col: str,
               cuts: DataFrame) -> DataFrame:
    """(strata…, at, cut): the (h, id) of the row of rank ``at`` by (h, id).

    ``cuts`` holds (strata…, at); ranks beyond a stratum's rows have no row
    in the result. Reads only the strata and id columns of ``df``.
    """
    d = _bucketed(df.select(*strata, id_col), h)
    offs = staged(bucket_offsets(d, strata), "cut-offsets")
    hit = offs.join(small(cuts), on=list(strata)).where(
        (F.col("at") >= F.col("_off")) & (F.col("at") < F.col("_off") + F.col("_n")))
    hit = staged(hit.select(*strata, "_b", "_off", "at"), "cut-buckets")
    w = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    buckets = small(hit.select(*strata, "_b", "_off").distinct())
    rows = d.join(buckets, on=[*strata, "_b"]).withColumn("_r", F.row_number().over(w) - 1 + F.col("_off"))
    rows = rows.join(small(hit.select(*strata, "_b", "at")), on=[*strata, "_b"]).where("_r = at")
    return rows.select(*strata, "at", F.struct(F.col("_h").alias("h"), F.col(id_col).alias("id")).alias("cut"))


def assign_bands(df: DataFrame, strata: Sequence[str], h: Column,
                 id_col: str, bands: DataFrame,
                 band_col: str = "band") -> DataFrame:
    """Give each row the band whose [lo, hi) contains its rank.

    ``bands`` holds (strata…, band, lo, hi) per stratum (a handful of rows);
    rows whose rank lies in no band are dropped. Rank order is (h, id).
    """
    alone = not strata
    if alone:  # one implicit stratum
        df, bands, strata = df.withColumn("_s", F.lit(0)), bands.withColumn("_s", F.lit(0)), ["_s"]
    bands = staged(bands, "bands")
    cuts = staged(bands.select(*strata, F.col("lo").alias("at")).unionByName(
        bands.select(*strata, F.col("hi").alias("at"))).distinct(), "cuts")
    found = staged(cut_points(df, strata, h, id_col, cuts), "cut-points")
    low = found.select(*strata, F.col("at").alias("lo"), F.col("cut").alias("_from"))
    high = found.select(*strata, F.col("at").alias("hi"), F.col("cut").alias("_to"))
    # a lower rank beyond the rows makes a band empty; an upper one leaves it open
    limits = bands.join(low, on=[*strata, "lo"]).join(high, on=[*strata, "hi"], how="left")
    limits = staged(limits.select(*strata, F.col("band").alias(band_col), "_from", "_to"), "band-limits")
    place = F.struct(F.col("_h").alias("h"), F.col(id_col).alias("id"))
    d = df.withColumn("_h", h)
    if alone:
        band = F.lit(None).cast("string")
        for r in limits.collect():  # the bands of one stratum
            inside = place >= F.struct(F.lit(r["_from"]["h"]).alias("h"), F.lit(r["_from"]["id"]).alias("id"))
            if r["_to"] is not None:
                inside &= place < F.struct(F.lit(r["_to"]["h"]).alias("h"), F.lit(r["_to"]["id"]).alias("id"))
            band = F.when(inside, F.lit(r[band_col])).otherwise(band)
        return d.withColumn(band_col, band).where(F.col(band_col).isNotNull()).drop("_h", "_s")
    inside = (place >= F.col("_from")) & (F.col("_to").isNull() | (place < F.col("_to")))
    return d.join(small(limits), on=list(strata)).where(inside).drop("_h", "_from", "_to")


def take_n(df: DataFrame, n: int, h: Column, id_col: str,
           strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows (or all if fewer) per stratum, seeded."""
    base = (df.select(*strata).distinct() if strata
            else df.sparkSession.range(1).select())
    bands = base.select(*strata, F.lit("take").alias("band"),
                        F.lit(0).cast("long").alias("lo"),
                        F.lit(int(n)).cast("long").alias("hi"))
    return assign_bands(df, strata, h, id_col, bands, "_band").drop("_band")
