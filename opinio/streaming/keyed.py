"""Cross-batch keep-first dedupe with keyed state (O22): ``transformWithState``.

The accepted keys live in the state store and nowhere else: no earlier output
is read. Keys are dealt over ``buckets`` by hash; the state of a bucket is a
map (entity, digest of the normalised text) -> order of the accepted row, and
its running totals. A micro-batch goes

1. through a stateless step on the side of the files, where of the rows of one
   key in a slice only the first by order goes on, with the number of rows it
   stands for, so that a key holding a third of a batch sends a few rows;
2. to its buckets, where the first by order of each key not yet in the map is
   accepted, emitted and entered; every bucket also emits what it was given,
   accepted and discarded, in this batch and in all;
3. to partition ``batch_id`` of the output, overwritten as a whole, so a
   replayed batch leaves the same files.

Entries can be given a time to live (processing time), after which a key
counts as new again and its state is freed. Without it the state grows with
the accepted keys, at some forty bytes each, in RocksDB on the executors and
in the checkpoint.

Cases: the first arrival is the row of the smallest order in the earliest
batch; a null order comes last; rows tied in a batch are one row, whichever
comes first; a null entity is an entity of its own; an empty batch gives no
counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedupe import with_review_key
from ..session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64
COUNTS = "rows_in long, new_rows long, discarded long, total_in long, total_new long"


def _combined(entity: str, order: str):
    """Of the rows of one key in a slice the first by order, with the number of rows it stands for."""
    def step(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            names = b.schema.names
            at = pa.table({"e": b.column(names.index(entity)), "k": b.column(names.index("key_hash")),
                           "o": b.column(names.index(order)), "i": pa.array(range(b.num_rows), pa.int64())})
            at = at.sort_by([("o", "ascending"), ("i", "ascending")])  # nulls last
            first = at.group_by(["e", "k"], use_threads=False).aggregate([("i", "first"), ("i", "count")])
            kept = pa.Table.from_batches([b]).take(first.column("i_first").combine_chunks())
            yield from kept.append_column("copies", first.column("i_count").combine_chunks()).combine_chunks().to_batches()
    return step


class FirstArrival(StatefulProcessor):
    """The state of a bucket and what a batch does to it."""

    def __init__(self, entity: str, order: str, fields: list, entity_type: str, order_type: str, ttl_ms: int | None):
        self.entity, self.order, self.fields, self.ttl = entity, order, fields, ttl_ms
        self.key_schema, self.value_schema = f"entity {entity_type}, key binary", f"place {order_type}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getMapState("accepted", self.key_schema, self.value_schema, self.ttl)
        self.totals = handle.getValueState("totals", "rows_in long, new_rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, n_in, n_new = {}, 0, 0
        for r in rows:
            n_in += r["copies"]
            k = (r[self.entity], bytes(r["key_hash"]))
            place = (r[self.order] is None, r[self.order])
            if k not in first or place < first[k][0]:
                first[k] = place, r
        for k, (place, r) in first.items():
            if not self.accepted.containsKey(k):
                self.accepted.updateValue(k, (place[1],))
                n_new += 1
                yield Row(kind="row", bucket=key[0], **{f: r[f] for f in self.fields}, **dict.fromkeys(
                    ("rows_in", "new_rows", "discarded", "total_in", "total_new")))
        t_in, t_new = self.totals.get() if self.totals.exists() else (0, 0)
        self.totals.update((t_in + n_in, t_new + n_new))
        yield Row(kind="count", bucket=key[0], **dict.fromkeys(self.fields), rows_in=n_in, new_rows=n_new,
                  discarded=n_in - n_new, total_in=t_in + n_in, total_new=t_new + n_new)

    def close(self) -> None:
        pass


def keyed_first_arrivals(stream: DataFrame, entity_col: str = "entity_id", text_col: str = "text", order_col: str = "seq",
                         buckets: int = BUCKETS, ttl_ms: int | None = None) -> DataFrame:
    """A stream of accepted rows (``kind`` "row") and of counts a bucket and batch ("count")."""
    ship_package(stream.sparkSession)
    keyed = with_review_key(stream, text_col, "key_hash")
    fields = keyed.columns
    slim = keyed.mapInArrow(_combined(entity_col, order_col), T.StructType([*keyed.schema.fields, T.StructField("copies", T.LongType())]))
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64(entity_col, "key_hash"), F.lit(buckets)).cast("int"))
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType()),
                        *[T.StructField(f.name, f.dataType) for f in keyed.schema.fields]])
    for c in COUNTS.split(", "):
        out = out.add(c.split()[0], T.LongType())
    processor = FirstArrival(entity_col, order_col, fields, keyed.schema[entity_col].dataType.simpleString(),
                             keyed.schema[order_col].dataType.simpleString(), ttl_ms)
    return slim.groupBy("bucket").transformWithState(
        statefulProcessor=processor, outputStructType=out, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime")


def keyed_dedupe(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint_dir: str,
                 entity_col: str = "entity_id", text_col: str = "text", order_col: str = "seq",
                 buckets: int = BUCKETS, partitions: int | None = None, ttl_ms: int | None = None,
                 files_per_batch: int = 1, available_now: bool = True, every: str = "10 seconds"):
    """Run the stream; ``accepted``, ``batch_counts`` and ``state_totals`` read what it wrote below ``out_dir``.

    ``partitions`` (else the session's shuffle partitions) is the number of
    tasks that hold state; it is fixed by the first batch, as are ``buckets``.
    A time to live needs a stream that goes on (``available_now=False``): its
    batches run without new rows too, so that state is freed.
    """
    if available_now and ttl_ms is not None:
        raise ValueError("a time to live needs available_now=False")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(source_dir)
    arrivals = keyed_first_arrivals(stream, entity_col, text_col, order_col, buckets, ttl_ms)

    def put(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "kind").parquet(out_dir))

    w = arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_dir).outputMode("append")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or shuffled))
    try:
        q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)  # the query keeps the settings it began with
    if available_now:
        q.awaitTermination()
    return q


def accepted(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """The accepted rows: the columns of the input, key_hash and batch_id."""
    names = [f.name for f in schema.fields]
    return spark.read.parquet(out_dir).where("kind = 'row'").select(*names, "key_hash", F.col("batch_id").cast("long").alias("batch_id"))


def batch_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per batch: rows in, new rows, discarded."""
    counts = spark.read.parquet(out_dir).where("kind = 'count'")
    return counts.groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(
        *[F.sum(c).alias(c) for c in ("rows_in", "new_rows", "discarded")])


def state_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row: rows seen and accepted so far, as the state of the buckets has them."""
    counts = spark.read.parquet(out_dir).where("kind = 'count'")
    per = counts.groupBy("bucket").agg(F.max("total_in").alias("total_in"), F.max("total_new").alias("total_new"))
    return per.agg(F.coalesce(F.sum("total_in"), F.lit(0)).alias("total_in"), F.coalesce(F.sum("total_new"), F.lit(0)).alias("total_new"))
