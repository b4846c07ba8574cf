"""Order-stable keep-first dedupe, cross-batch dedupe, duplicate audit.

Keep-first is an aggregation, not a window: ``min(order)`` per key has a
map-side partial step, so a key holding a third of all rows collapses to one
row per map task before the shuffle. Only the groups of more than one row go
on: their later rows are the losers, removed by an anti join on the (unique)
number of a row. The losers are counted first: the numbers of few are
broadcast and the texts stay where they are, those of many are hashed, so
that the texts are shuffled once but never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, key_hash, norm_key
from ..session import BROADCAST_ROWS, staged


def with_review_key(df: DataFrame, text_col: str = "text",
                    key_col: str = "_key", normalise: bool | str = True) -> DataFrame:
    """Add the 16-byte digest of the normalised text.

    ``normalise="collapse"`` is for text already stripped and lower-cased
    (only whitespace runs are collapsed); ``False`` hashes the text as is.
    """
    if normalise == "collapse":
        k = collapse_ws(text_col)
    else:
        k = norm_key(text_col) if normalise else F.col(text_col)
    return df.withColumn(key_col, key_hash(k))


def keep_first(df: DataFrame, keys: Sequence[str],
               order: str | Sequence[str] = "seq") -> DataFrame:
    """Keep the first row (smallest ``order``) of each ``keys`` group.

    ``order`` is one column or several (a file ordinal, an id, page and
    position). A null comes last in it: such a row loses to any row that has
    a place. Of rows tied for the first place one stays: that of the least
    hash of its columns, and of equal rows any one.

    The input is evaluated once: it is written with a number a row, and the
    branches below read narrow columns of what was written.
    """
    return first_rows(numbered(df), keys, order).select(*df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written with ``_tie``: a number a row, by the hash of its columns first."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    number = F.hash(*plain).cast("decimal(10,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.monotonically_increasing_id()
    return staged(df.withColumn("_tie", number.cast("decimal(38,0)")), "keep-first")


def first_rows(d: DataFrame, keys: Sequence[str], order: str | Sequence[str] = "seq", also: DataFrame | None = None) -> DataFrame:
    """``keep_first`` of a table that ``numbered`` wrote; the rows whose ``_tie`` is in ``also`` go too."""
    cols = [order] if isinstance(order, str) else list(order)
    # one column: its minimum skips nulls, as wanted
    place = F.col(cols[0]) if len(cols) == 1 else F.struct(
        *[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(c) for c in cols])
    ks = [f"_k{i}" for i in range(len(keys))]
    narrow = d.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], place.alias("_o"), "_tie")
    groups = narrow.groupBy(*[F.col(k).alias(f"_g{k}") for k in ks]).agg(
        F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = groups.agg(F.sum(F.col("_n") - 1)).first()[0] or 0
    again = narrow.join(groups, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in ks])).select(
        *ks, "_tie", F.col("_o").eqNullSafe(F.col("_first")).alias("_is_first"))
    stays = again.where("_is_first").groupBy(*[F.col(k).alias(f"_s{k}") for k in ks]).agg(F.min("_tie").alias("_keep"))
    losers = again.join(stays, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in ks])).where(
        "_tie <> _keep").select(F.col("_tie").alias("_gone"))
    if also is not None:
        also = staged(also.select(F.col("_tie").alias("_gone")), "keep-first-also")
        losers, gone = losers.unionByName(also), gone + also.count()
    losers = F.broadcast(losers) if gone <= BROADCAST_ROWS else losers.hint("shuffle_hash")
    return d.join(losers, F.col("_tie") == F.col("_gone"), "left_anti")


def keep_first_by_text(df: DataFrame, keys: Sequence[str] = ("entity_id",),
                       text_col: str = "text", order: str = "seq",
                       normalise: bool = True) -> DataFrame:
    """Keep-first on (keys…, digest of normalised text); helper column dropped."""
    d = with_review_key(df, text_col, "_key", normalise)
    return keep_first(d, [*keys, "_key"], order).drop("_key")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of rows that belong to a duplicate group.

    Counts every member (pandas ``keep=False``), not just the extra copies.
    """
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))),
                            F.lit(0)).cast("long").alias("duplicate_rows"))
