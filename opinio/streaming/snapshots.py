"""Snapshots of an ingest stream with manifests, and restart from the last whole one.

``snapshotted_dedupe`` feeds the key store of ``keystore`` and notes for each
batch the files it came from. When ``every`` batches have passed since the
last snapshot, the accepted rows and file names of those batches are added to
the snapshot folder, and only then a manifest is put in place by a rename:
a snapshot without its manifest does not exist. A manifest holds the last
batch and, over all batches up to it, the number of rows and the combined
hash of their contents.

``restore`` takes the newest manifest whose rows are all there and unharmed,
puts them into a new store and rebuilds keys and Bloom filters from them. A
stream started there with a new checkpoint numbers its batches behind the
restored ones and passes over the files that the snapshot holds; everything
that arrived later is read again, so that no row is there twice or missing.

Replaying a batch gives the same files and the same snapshot. A store that
is only half restored, or whose checkpoint is gone, is refused.

Cases: a batch without new files or rows gets no partition; nulls, ties and
repeated rows are as in ``keystore``; ``_file``, ``batch_id`` and
``key_hash`` are names of its own and refused in the input.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import _exists
from .keystore import PARTS, _overwrite, accept, index

OWN = ("_file", "batch_id", "key_hash")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small document under another name, then rename it into place."""
    fs, at = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not fs.rename(draft, at) and not fs.exists(at):
        raise OSError(f"cannot put {path} in place")


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def manifests(spark: SparkSession, backup: str) -> list[int]:
    """The last batches of the snapshots that have a manifest, newest first."""
    fs, at = _fs(spark, f"{backup}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)


def _content(rows: DataFrame) -> tuple[int, int]:
    """The number of rows and the combined hash of their contents."""
    one = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(rows.columns)))).first()
    return one[0], one[1] or 0


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def take(spark: SparkSession, store: str, backup: str, upto: int) -> None:
    """Add the batches since the last snapshot, then commit the manifest of batch ``upto``."""
    done = manifests(spark, backup)
    if upto in done:  # a replay
        return
    before = _get(spark, f"{backup}/manifests/{done[0]}.json") if done else {"batch": -1, "rows": 0, "content": 0}
    since = (F.col("batch_id") > before["batch"]) & (F.col("batch_id") <= upto)
    schema = spark.read.parquet(f"{store}/rows").schema
    for table in ("rows", "files"):
        _overwrite(spark.read.parquet(f"{store}/{table}").where(since), f"{backup}/{table}", "batch_id")
    n, content = _content(_read(spark, f"{backup}/rows", schema).where(since))
    _put(spark, f"{backup}/manifests/{upto}.json", {
        "batch": upto, "rows": before["rows"] + n, "content": before["content"] ^ content, "schema": schema.json()})


def restore(spark: SparkSession, backup: str, store: str, entity_col: str = "entity_id", parts: int = PARTS) -> int:
    """Rebuild a store from the newest snapshot that is whole; returns its last batch."""
    from pyspark.sql.types import StructType
    if _exists(spark, store):
        raise ValueError(f"restore needs a new folder, {store} exists")
    for upto in manifests(spark, backup):
        m = _get(spark, f"{backup}/manifests/{upto}.json")
        schema = StructType.fromJson(json.loads(m["schema"]))
        rows = _read(spark, f"{backup}/rows", schema).where(F.col("batch_id") <= upto)
        if _whole(rows, m):
            break
    else:
        raise ValueError(f"{backup} has no whole snapshot")
    _put(spark, f"{store}/incomplete.json", {"from": backup})
    _overwrite(rows, f"{store}/rows", "batch_id")
    files = spark.read.schema(FILES).parquet(f"{backup}/files").where(F.col("batch_id") <= upto)
    _overwrite(files, f"{store}/files", "batch_id")
    index(_read(spark, f"{store}/rows", schema), store, entity_col, parts)
    _put(spark, f"{store}/origin.json", {"first": upto + 1})
    fs, mark = _fs(spark, f"{store}/incomplete.json")
    fs.delete(mark, False)
    return upto


FILES = "_file string, rows_in long, batch_id long"


def _whole(rows: DataFrame, manifest: dict) -> bool:
    """Whether the rows are those of the manifest; files that can't be read count as missing."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    try:
        return _content(rows) == (manifest["rows"], manifest["content"])
    except (PySparkException, Py4JJavaError) as e:
        if "FAILED_READ_FILE" not in str(e):  # not a matter of the files
            raise
        return False


def _first(spark: SparkSession, store: str, checkpoint: str) -> int:
    """The number of the stream's first batch."""
    if _exists(spark, f"{store}/incomplete.json"):
        raise ValueError(f"{store} is half restored: restore into a new folder")
    first = _get(spark, f"{store}/origin.json")["first"] if _exists(spark, f"{store}/origin.json") else 0
    if not _exists(spark, checkpoint) and _exists(spark, f"{store}/files") \
            and not spark.read.schema(FILES).parquet(f"{store}/files").where(F.col("batch_id") >= first).isEmpty():
        raise ValueError(f"the checkpoint of {store} is gone: restore its snapshot into a new folder")
    return first


def snapshotted_dedupe(spark: SparkSession, source_dir: str, schema, store: str, checkpoint_dir: str, backup: str, every: int = 50,
                       entity_col: str = "entity_id", text_col: str = "text", order_col: str = "seq", parts: int = PARTS,
                       files_per_batch: int = 1):
    """Keep-first ingest of a folder with a snapshot every ``every`` batches; returns the finished query."""
    first = _first(spark, store, checkpoint_dir)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(source_dir)
    if set(OWN) & {c.lower() for c in stream.columns}:
        raise ValueError(f"{OWN} are names of its own")
    names = stream.columns

    def per_batch(batch: DataFrame, stream_id: int) -> None:
        number = first + stream_id
        if first:  # files that the restored snapshot holds come once more
            held = spark.read.schema(FILES).parquet(f"{store}/files").where(F.col("batch_id") < first).select("_file")
            batch = batch.join(held, "_file", "left_anti")
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            accept(batch.select(*names), number, store, entity_col, text_col, order_col, parts)
            per_file = batch.groupBy("_file").agg(F.count(F.lit(1)).alias("rows_in"))
            _overwrite(per_file.withColumn("batch_id", F.lit(number).cast("long")), f"{store}/files", "batch_id")
            if number - max(manifests(spark, backup), default=-1) >= every:
                take(spark, store, backup, number)
        finally:
            batch.unpersist()

    q = stream.select(*names, F.col("_metadata.file_path").alias("_file")).writeStream.foreachBatch(per_batch) \
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def totals(spark: SparkSession, store: str) -> DataFrame:
    """rows_in, new_rows, discarded over everything the store has taken in."""
    n_in = spark.read.schema(FILES).parquet(f"{store}/files").agg(F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"))
    n_new = spark.read.parquet(f"{store}/rows").agg(F.count(F.lit(1)).alias("new_rows"))
    return n_in.join(F.broadcast(n_new)).select(  # one row each
        "rows_in", "new_rows", (F.col("rows_in") - F.col("new_rows")).alias("discarded"))
