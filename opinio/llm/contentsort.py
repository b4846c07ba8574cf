"""Exact dedup by a content sort.

Texts are equal when they are identical after A-Z are lower-cased. Rows are
range-partitioned by splitters that Spark samples, and sorted within each
range (an external sort: it spills): first by the first ``PREFIX`` bytes of
the normalised text, then by the SHA-256 of all of it, then by identifier.
Equal texts are so adjacent, and a step over the sorted rows compares each
text with its neighbour in full; a digest that two texts share stops the
job. Sampled splitters hold a prefix and a digest, never a whole text, and
they cut inside a group of copies too (the identifier is part of the key),
so a group of any size is dealt over as many tasks as its bytes need. A run
that goes over a border leaves one piece in each range; only those pieces,
two a range at most, are put together afterwards, by their whole texts.

Cases: a null text is the empty one; null identifiers come last, so a row
with an identifier stays before one without; rows that tie in both are
repeated rows, of which one stays; an empty table gives an empty result;
other columns travel inside one struct and are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small
from .common import python_step, read, staged

#: Normalised bytes by which rows are sorted before their digest.
PREFIX = 64


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that where every character is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, ascii_uppercase, ascii_lowercase))


def content_sorted(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """row (all columns), id, text, digest: in ranges of content, sorted, the row that stays first among equals."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.col(f"row.`{text_col}`").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", F.col(f"row.`{id_col}`").alias("id"), lowered(text).alias("norm"))
    d = d.select("row", "id", F.substring(F.col("norm").cast("binary"), 1, PREFIX).alias("prefix"),
                 F.unhex(F.sha2("norm", 256)).alias("digest"))
    order = F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id")
    d = d.repartitionByRange("prefix", "digest", order).sortWithinPartitions("prefix", "digest", order)
    return d.select("row", "id", text.alias("text"), "digest")


def _runs(batches: Iterator, carry: str, every: bool) -> Iterator:
    """Runs of equal texts of one sorted range: column ``carry`` of every row, or of the first row of each run only.

    A run is held as columns without texts until it ends. ``piece`` is set on the first and last run of the range.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, n, first, digest, text = [], 0, True, None, None

    def out(rows, heads, sizes, piece=None, edge=None):
        """Rows of whole runs: ``heads`` their first places, ``sizes`` the rows of each run."""
        if not every:
            rows, heads, each = rows.take(heads), np.arange(len(heads)), np.ones(len(heads), np.int64)
        else:
            each = sizes
        is_first = np.zeros(rows.num_rows, bool)
        is_first[heads] = True
        texts = [None] * rows.num_rows
        if edge is not None:
            texts[0] = edge
        return pa.record_batch([
            rows.column(0), rows.column(1), rows.column(2),
            rows.column(1).take(pa.array(np.repeat(heads, each))),
            pa.array(np.repeat(sizes, each), pa.int64()), pa.array(is_first),
            pa.array([part] * rows.num_rows, pa.int32()), pa.array([piece] * rows.num_rows, pa.int32()),
            pa.array(texts, pa.binary())], names=["carried", "id", "digest", "keep", "n", "first", "part", "piece", "edge"])

    def closed(last):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edge = first or last
        return out(rows, np.zeros(1, np.int64), np.array([n]), 0 if first else 1 if last else None, text if edge else None)

    for b in batches:
        if not b.num_rows:
            continue
        column = {c: b.column(b.schema.get_field_index(c)) for c in (carry, "id", "text", "digest")}
        texts = pc.ascii_lower(pc.fill_null(column["text"], "")).cast(pa.binary()).to_pylist()
        digests = column["digest"].to_pylist()
        rows = pa.record_batch([column[carry], column["id"], column["digest"]], names=["carried", "id", "digest"])
        starts, before = [], (digest, text)
        for i, (d, t) in enumerate(zip(digests, texts)):
            if d != before[0]:
                starts.append(i)
            elif t != before[1]:
                raise ValueError("two texts with one SHA-256")
            before = d, t
        if not n:  # the first run of the range: nothing to close before it
            starts, text = starts[1:], texts[0]
        upto = starts[0] if starts else b.num_rows
        if upto and (every or not n):
            held.append(rows.slice(0, upto if every else 1))
        n += upto
        if starts:
            yield closed(False)
            first, at = False, np.array(starts)
            if len(at) > 1:
                yield out(rows.slice(at[0], int(at[-1] - at[0])), at[:-1] - at[0], np.diff(at))
            n = b.num_rows - int(at[-1])
            held = [rows.slice(int(at[-1]), n if every else 1)]
        digest, text = before
    if n:
        yield closed(True)


def _flags(docs: DataFrame, id_col: str, text_col: str, keep: str, every: bool) -> DataFrame:
    """The runs of all ranges with what lies across borders put together."""
    d = content_sorted(docs, id_col, text_col, keep)
    kind = d.schema["id"].dataType
    carry = "id" if every else "row"
    schema = T.StructType([
        T.StructField("carried", d.schema[carry].dataType), T.StructField("id", kind), T.StructField("digest", T.BinaryType()),
        T.StructField("keep", kind), T.StructField("n", T.LongType()), T.StructField("first", T.BooleanType()),
        T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("edge", T.BinaryType())])
    runs = staged(python_step(d.select(*dict.fromkeys([carry, "id", "text", "digest"])),
                              lambda batches: _runs(batches, carry, every), schema), "content-runs")
    whole = runs.where("edge is not null").groupBy("edge").agg(
        F.sum("n").alias("all_n"), F.min("part").alias("from_part"), F.min_by("keep", "part").alias("all_keep"),
        F.collect_list(F.struct("part", "piece")).alias("pieces"))
    whole = staged(whole.select("all_n", "from_part", "all_keep", F.explode("pieces").alias("p")).select(
        "all_n", "from_part", "all_keep", F.col("p.part").alias("e_part"), F.col("p.piece").alias("e_piece")), "content-edges")
    met = runs.drop("edge").join(small(whole), (F.col("part") == F.col("e_part")) & (F.col("piece") == F.col("e_piece")), "left")
    return met.select(
        "carried", "id", "digest", F.when(F.col("e_part").isNull(), F.col("keep")).otherwise(F.col("all_keep")).alias("keep"),
        F.coalesce("all_n", "n").alias("n"),
        (F.col("first") & (F.col("e_part").isNull() | (F.col("part") == F.col("from_part")))).alias("stays"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: its identifier, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return _flags(docs, id_col, text_col, keep, True).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns."""
    return _flags(docs, id_col, text_col, keep, False).where("stays").select("carried.*")


def op13_exactdedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; of equal texts the largest doc_id stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, keep="largest")


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
