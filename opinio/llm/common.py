"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Text bytes handled at once inside a Python step: keeps numpy temporaries small.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that a Python step handles at once.
PIECE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` under ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'llm')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input never clash."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def boxed(docs: DataFrame, *cols: str) -> DataFrame:
    """``row`` (all columns in one struct), the named columns and ``key`` (``row_key``): names of other columns never clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), *[F.col(f"`{c}`") for c in cols], row_key().alias("key"))


def unboxed(df: DataFrame, docs: DataFrame, **fresh: Column) -> DataFrame:
    """The columns of ``docs`` out of ``row``, those in ``fresh`` replaced."""
    return df.select(*[(fresh[c].cast(docs.schema[c].dataType) if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def row_key(text: str = "text") -> Column:
    """Identity of a row besides its doc_id, so that repeated or null ids never multiply in joins."""
    return F.xxhash64(F.col(text), F.isnull(text))


def python_step(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors; ``fn`` sees batches of PIECE_BYTES or so."""
    ship_package(df.sparkSession)

    def stepped(batches):
        return fn(piece for b in batches for piece in pieces(b))

    return df.mapInArrow(stepped, schema)


def pieces(batch):
    """Slices (no copies) of an Arrow batch, so that what a step turns into Python objects stays small."""
    n = max(1, min(batch.num_rows, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
    for i in range(0, max(1, batch.num_rows), n):
        yield batch.slice(i, n)


def chunked(texts: list, limit: int = CHUNK_BYTES):
    """Index ranges of ``texts`` (bytes or None) holding about ``limit`` bytes each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def byte_column(batch, name: str) -> list:
    """A string column of an Arrow batch as UTF-8 bytes (None for null)."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
