"""Cross-batch keep-first dedupe against stored keys with Bloom filters (O22, batch form).

Accepted keys are stored as (entity, digest of the normalised text), dealt
over ``parts`` hash partitions: ``keys/part=P/batch_id=B``. Beside each such
folder's keys lies one Bloom filter of them (``blooms/part=P/batch_id=B``, ten
bits a key). A new batch is deduplicated within itself, its keys are held
against the filters of the partitions they hash to, and only the folders whose
filter one of them passes are opened for the anti join. A batch of new keys so
opens next to nothing of the history; a key seen before opens the one folder
that holds it, and about one filter in a hundred passes by chance.

A batch reads ``batch_id`` below its own only and overwrites its own
partitions, so replaying it gives the same files.

Cases: a null entity is an entity of its own, a null text a text of its own; a null order comes last; rows
tied in order are one row; the first batch and an empty one are batches like
any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_first, with_review_key
from ..session import ship_package, staged
from .incremental import _exists

PARTS = 256
BITS_A_KEY, PROBES = 10, 7
#: Folders up to which their paths are listed; beyond it the whole store is read.
MOST_FOLDERS = 20_000


def probes(entities, digests, bits: int) -> np.ndarray:
    """PROBES bit numbers of each key, by double hashing over its digest and its entity."""
    import hashlib
    whole = b"".join(hashlib.blake2b(repr((e, d and bytes(d))).encode(), digest_size=16).digest() for e, d in zip(entities, digests))
    h = np.frombuffer(whole, np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (h[:, :1] + np.arange(PROBES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom_of(entities, digests) -> bytes:
    bits = -(-max(64, BITS_A_KEY * len(digests)) // 8) * 8
    field = np.zeros(bits, np.uint8)
    field[probes(entities, digests, bits).ravel()] = 1
    return np.packbits(field).tobytes()


def may_hold(bloom: bytes, entities, digests) -> np.ndarray:
    """Whether each key may be among those the filter was made of."""
    field = np.frombuffer(bloom, np.uint8)
    at = probes(entities, digests, 8 * len(field))
    return ((field[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


def _dealt(keys: DataFrame, entity_col: str, parts: int, *more: str) -> DataFrame:
    return keys.select(F.col(entity_col).alias("entity"), "key_hash", *more).withColumn(
        "part", F.pmod(F.xxhash64("entity", "key_hash"), F.lit(parts)).cast("int"))


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def folders_to_open(keys: DataFrame, store: str, batch_id: int) -> DataFrame:
    """part, batch_id of the folders whose filter one of ``keys`` (entity, key_hash, part) passes."""
    blooms = keys.sparkSession.read.schema("bloom binary, part int, batch_id long").parquet(f"{store}/blooms").where(
        F.col("batch_id") < batch_id)

    def passed(k, b):
        import pandas as pd
        hit = [(p, i) for p, i, f in zip(b["part"], b["batch_id"], b["bloom"])
               if len(k) and may_hold(f, k["entity"], k["key_hash"]).any()]
        return pd.DataFrame(hit, columns=["part", "batch_id"]).astype({"part": "int32", "batch_id": "int64"})

    return keys.groupBy("part").cogroup(blooms.groupBy("part")).applyInPandas(passed, "part int, batch_id long")


def stored_keys(spark: SparkSession, store: str, schema, folders: DataFrame, batch_id: int) -> DataFrame:
    """The stored keys of ``folders`` alone."""
    some = folders.limit(MOST_FOLDERS + 1).collect()
    read = spark.read.schema(schema)
    if not some:
        return spark.createDataFrame([], schema)
    if len(some) > MOST_FOLDERS:
        return read.parquet(f"{store}/keys").where(F.col("batch_id") < batch_id)
    return read.option("basePath", f"{store}/keys").parquet(
        *[f"{store}/keys/batch_id={r['batch_id']}/part={r['part']}" for r in some])


def index(rows: DataFrame, store: str, entity_col: str, parts: int) -> None:
    """Write the keys of stored rows and a filter beside each folder of them."""
    mine = _dealt(rows, entity_col, parts, "batch_id")

    def filters(k):
        import pandas as pd
        return pd.DataFrame({"bloom": [bloom_of(k["entity"], k["key_hash"])], "part": [k["part"].iloc[0]],
                             "batch_id": [k["batch_id"].iloc[0]]})

    _overwrite(mine.repartition("batch_id", "part"), f"{store}/keys", "batch_id", "part")
    _overwrite(mine.groupBy("batch_id", "part").applyInPandas(filters, "bloom binary, part int, batch_id long"),
               f"{store}/blooms", "batch_id", "part")


def accept(batch: DataFrame, batch_id: int, store: str, entity_col: str = "entity_id", text_col: str = "text",
           order_col: str = "seq", parts: int = PARTS) -> DataFrame:
    """Enter a batch into the store; returns its accepted rows (with key_hash and batch_id)."""
    spark = batch.sparkSession
    ship_package(spark)
    first = staged(keep_first(with_review_key(batch, text_col, "key_hash"), [entity_col, "key_hash"], order_col), "bloom-batch")
    keys = _dealt(first, entity_col, parts)
    new = first
    if _exists(spark, f"{store}/blooms"):
        folders = staged(folders_to_open(keys, store, batch_id), "bloom-folders")
        shape = spark.createDataFrame([], keys.schema).withColumn("batch_id", F.lit(0).cast("long")).schema
        old = stored_keys(spark, store, shape, folders, batch_id).select(F.col("entity").alias("_e"), F.col("key_hash").alias("_k"))
        new = first.join(old, F.col(entity_col).eqNullSafe(F.col("_e")) & F.col("key_hash").eqNullSafe(F.col("_k")), "left_anti")
    at = F.lit(batch_id).cast("long")
    _overwrite(new.withColumn("batch_id", at), f"{store}/rows", "batch_id")
    rows = spark.read.schema(new.withColumn("batch_id", at).schema).parquet(f"{store}/rows").where(F.col("batch_id") == batch_id)
    index(rows, store, entity_col, parts)
    return rows


def bloom_dedupe(spark: SparkSession, source_dir: str, schema, store: str, checkpoint_dir: str, entity_col: str = "entity_id",
                 text_col: str = "text", order_col: str = "seq", parts: int = PARTS, files_per_batch: int = 1):
    """The store fed by a file stream, one ``accept`` a micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        accept(batch, batch_id, store, entity_col, text_col, order_col, parts)

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
