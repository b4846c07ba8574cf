"""Batches of the masking collator (O64): padded to the longest row of each batch, not to a fixed length.

Rows of about the same length share a batch, so little of it is padding.
Which rows meet in a batch, and the order of the batches, follow from seeded
digests and change with the epoch; neither depends on how rows are
partitioned. A batch never spans two tasks' worth of state: its rows meet in
a window of ``size`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, staged
from .rank import with_rank


def _digest(seed: int, epoch: int, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), *[F.col(c).cast("string") for c in cols]))


def _padded(ids: Column, value: int, width: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(int(value)), width - F.size(ids)))


def padded_batches(df: DataFrame, id_cols: Sequence[str], pads: Mapping[str, int], size: int = 16,
                   bucket: int = 32, seed: int = 42, epoch: int = 0) -> DataFrame:
    """One row per row of ``df``: ``step`` (its batch, in training order), ``slot`` (its place in it, from 0),
    the ids, the sequences of ``pads`` (column -> padding value) padded to the batch's ``width``, the
    ``attention_mask`` and the row's own ``length``.

    The first column of ``pads`` gives a row's length; the others are as long. Rows whose lengths fall into
    the same span of ``bucket`` tokens are ordered by (digest of the ids, ids, sequence) and cut into batches
    of ``size``; only a span's last batch may be smaller. A null sequence counts as empty; repeated rows are
    rows like any other; an empty table gives no batch. Further columns of ``df`` are not looked at.
    """
    first = next(iter(pads))
    seqs = [F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c) for c in pads]
    rows = df.select(F.struct(*id_cols, *seqs).alias("row"), _digest(seed, epoch, *id_cols).alias("digest"))
    n = F.size(f"row.{first}")
    rows = staged(rows.withColumn("span", F.expr(f"(greatest(size(row.`{first}`), 1) - 1) div {int(bucket)}"))
                      .withColumn("length", n), "batch-rows")
    # ordered by fields of the row: a column of their own would send every sequence twice
    keyed = with_rank(rows, ["span"], F.col("digest"), [F.col(f"row.{c}") for c in [*id_cols, *pads]], "place")
    keyed = keyed.select("span", "length", "row", F.expr(f"place div {int(size)}").alias("batch"),
                         (F.col("place") % int(size)).cast("int").alias("slot"))
    width = F.max("length").over(Window.partitionBy("span", "batch"))
    steps = small(staged(_steps(rows, size, seed, epoch), "batch-steps"))
    placed = keyed.join(steps, ["span", "batch"]).withColumn("width", width)
    return placed.select(
        "step", "slot", "width", "length", *[F.col(f"row.{c}").alias(c) for c in id_cols],
        *[_padded(F.col(f"row.{c}"), v, F.col("width")).alias(c) for c, v in pads.items()],
        F.concat(F.array_repeat(F.lit(1), F.col("length")),
                 F.array_repeat(F.lit(0), F.col("width") - F.col("length"))).alias("attention_mask"))


def _steps(rows: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """(span, batch, step): the batches of all spans in one shuffled order, from the spans' counts alone."""
    counts = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))
    batches = counts.select("span", F.explode(F.expr(f"sequence(0L, (n - 1) div {int(size)})")).alias("batch"))
    keyed = batches.withColumn("id", F.struct("span", "batch"))
    return with_rank(keyed, [], _digest(seed, epoch, "span", "batch"), "id", "step").select("span", "batch", "step")


def padding_report(batched: DataFrame, max_len: int) -> DataFrame:
    """One row: rows, batches, tokens, cells of the padded batches, and the share of padding in them and in
    the same rows padded to ``max_len`` (0 for an empty table)."""
    out = batched.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.coalesce(F.max("step") + 1, F.lit(0)).cast("long").alias("n_batches"),
                      F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"),
                      F.coalesce(F.sum("width"), F.lit(0)).alias("n_cells"))

    def share(cells):
        return F.when(cells > 0, 1 - F.col("n_tokens") / cells).otherwise(F.lit(0.0))

    return out.select("*", share(F.col("n_cells")).alias("padding_share"),
                      share(F.col("n_rows") * int(max_len)).alias("padding_share_fixed"))
