"""Incremental ingest: the filtered review fixture streamed in k files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..operators import clean as C
from ..session import scratch_path
from ..sources.fixtures import reviews_raw
from ..streaming import incremental_dedupe, write_batches
from . import sqlparts as S
from .catalog import register, stage

K = 4
BACKUP_EVERY = 2
#: A batch is spread over files of so many rows, about: a file is one task's work.
FILE_ROWS = 10_000

_BASES: dict = {}


def _source(spark, sf_dir):
    """The filtered reviews and the files per batch, which grow with them."""
    src = C.filter_reviews(reviews_raw(spark, sf_dir), min_chars=25)
    return src, max(1, -(-src.count() // (K * FILE_ROWS)))


def _run(spark, sf_dir):
    def build():
        base = scratch_path(spark, f"stream-{uuid.uuid4().hex[:8]}")
        _BASES[(id(spark), sf_dir)] = base
        src, files = _source(spark, sf_dir)
        write_batches(src, f"{base}/in", K, files_per_batch=files)
        schema = spark.read.parquet(f"{base}/in").schema
        incremental_dedupe(spark, f"{base}/in", schema, f"{base}/out",
                           f"{base}/ckpt", backup_dir=f"{base}/backup",
                           backup_every=BACKUP_EVERY, files_per_batch=files)
        return spark.read.parquet(f"{base}/out/rows")
    rows = stage(spark, sf_dir, "stream_rows", build)
    return rows


STREAM_CTES = f"""{S.REVIEWS_RAW}, {S.filtered('reviews_raw', 25)},
batched AS (SELECT *, dense_rank() OVER (ORDER BY seq % {K}) - 1 AS batch_id FROM filtered),
first AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY entity_id, {S.norm('text')} ORDER BY batch_id, seq) AS rn FROM batched) WHERE rn = 1)"""


@register("stream_dedupe_keys", f"""WITH {S.REVIEWS_RAW}, {S.filtered('reviews_raw', 25)}
SELECT DISTINCT entity_id, {S.norm('text')} AS key_text FROM filtered""")
def stream_dedupe_keys(spark, sf_dir):
    """Same (entity, key) set as the batch keep-first (FIXTURES §7)."""
    return _run(spark, sf_dir).select("entity_id", norm_key("text").alias("key_text"))


@register("stream_rows", f"WITH {STREAM_CTES}\nSELECT seq, entity_id, label, text, batch_id FROM first")
def stream_rows(spark, sf_dir):
    """The surviving rows: the first arrival of each key."""
    return _run(spark, sf_dir).select("seq", "entity_id", "label", "text", F.col("batch_id").cast("long").alias("batch_id"))


@register("stream_batch_stats", f"""WITH {STREAM_CTES},
n AS (SELECT batch_id, count(*) AS rows_in FROM batched GROUP BY batch_id),
m AS (SELECT batch_id, count(*) AS new_rows FROM first GROUP BY batch_id)
SELECT batch_id, rows_in, coalesce(new_rows, 0) AS new_rows, rows_in - coalesce(new_rows, 0) AS discarded
FROM n LEFT JOIN m USING (batch_id)""")
def stream_batch_stats(spark, sf_dir):
    """Per micro-batch: rows in, new rows, discarded."""
    _run(spark, sf_dir)
    base = _BASES[(id(spark), sf_dir)]
    return spark.read.parquet(f"{base}/out/stats").select(
        F.col("batch_id").cast("long").alias("batch_id"), "rows_in", "new_rows", "discarded")


@register("stream_snapshot", f"""WITH {STREAM_CTES}
SELECT batch_id, seq, label FROM first
WHERE batch_id < (SELECT (max(batch_id) + 1) // {BACKUP_EVERY} * {BACKUP_EVERY} FROM batched)""")
def stream_snapshot(spark, sf_dir):
    """What the last snapshot holds."""
    _run(spark, sf_dir)
    base = _BASES[(id(spark), sf_dir)]
    return spark.read.parquet(f"{base}/backup").select(F.col("batch_id").cast("long").alias("batch_id"), "seq", "label")


def _run_state(spark, sf_dir):
    from ..streaming import incremental_dedupe_state

    def build():
        base = scratch_path(spark, f"stream-state-{uuid.uuid4().hex[:8]}")
        src, files = _source(spark, sf_dir)
        write_batches(src, f"{base}/in", K, files_per_batch=files, dedupe_keys=["entity_id"])
        schema = spark.read.parquet(f"{base}/in").schema
        incremental_dedupe_state(spark, f"{base}/in", schema, f"{base}/out",
                                 f"{base}/ckpt", files_per_batch=files)
        return spark.read.parquet(f"{base}/out")
    return stage(spark, sf_dir, "stream_state_rows", build)


@register("stream_state_keys", f"""WITH {S.REVIEWS_RAW}, {S.filtered('reviews_raw', 25)}
SELECT DISTINCT entity_id, {S.norm('text')} AS key_text FROM filtered""")
def stream_state_keys(spark, sf_dir):
    """State-store variant (``dropDuplicates``): same key set as the batch."""
    return _run_state(spark, sf_dir).select("entity_id", norm_key("text").alias("key_text"))


@register("stream_state_rows", f"WITH {STREAM_CTES}\nSELECT seq, entity_id, label FROM first")
def stream_state_rows(spark, sf_dir):
    """State-store variant: the surviving rows."""
    return _run_state(spark, sf_dir).select("seq", "entity_id", "label")


#: Rows a bucket of state, about.
BUCKET_ROWS = 100_000


def _run_keyed(spark, sf_dir):
    """Where the stream with keyed state has written, and the schema of its input."""
    from ..streaming import keyed
    key = ("keyed", id(spark), sf_dir)
    if key not in _BASES:
        base = scratch_path(spark, f"stream-keyed-{uuid.uuid4().hex[:8]}")
        src, files = _source(spark, sf_dir)
        write_batches(src, f"{base}/in", K, files_per_batch=files)
        buckets = max(4, src.count() // BUCKET_ROWS)
        schema = spark.read.parquet(f"{base}/in").schema
        keyed.keyed_dedupe(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ckpt", buckets=buckets,
                           partitions=buckets, files_per_batch=files)
        _BASES[key] = base, schema
    return _BASES[key]


@register("stream_keyed_rows", f"WITH {STREAM_CTES}\nSELECT seq, entity_id, label, text, batch_id FROM first")
def stream_keyed_rows(spark, sf_dir):
    """O22 with keyed state (``transformWithState``): the first arrival of each key by order, inside and across batches."""
    from ..streaming import keyed
    base, schema = _run_keyed(spark, sf_dir)
    return keyed.accepted(spark, f"{base}/out", schema).select("seq", "entity_id", "label", "text", "batch_id")


@register("stream_keyed_counts", f"""WITH {STREAM_CTES},
n AS (SELECT batch_id, count(*) AS rows_in FROM batched GROUP BY batch_id),
m AS (SELECT batch_id, count(*) AS new_rows FROM first GROUP BY batch_id),
t AS (SELECT sum(rows_in)::BIGINT AS total_in, (SELECT count(*) FROM first) AS total_new FROM n)
SELECT batch_id, rows_in, coalesce(new_rows, 0) AS new_rows, rows_in - coalesce(new_rows, 0) AS discarded, total_in, total_new
FROM n LEFT JOIN m USING (batch_id) CROSS JOIN t""")
def stream_keyed_counts(spark, sf_dir):
    """Per batch rows in, new and discarded, beside the totals that the state has at the end."""
    from ..streaming import keyed
    base, _ = _run_keyed(spark, sf_dir)
    per, total = keyed.batch_counts(spark, f"{base}/out"), keyed.state_totals(spark, f"{base}/out")
    return per.join(F.broadcast(total))  # one row


@register("stream_bloom_rows", f"WITH {STREAM_CTES}\nSELECT seq, entity_id, label, batch_id FROM first")
def stream_bloom_rows(spark, sf_dir):
    """O22 against stored keys with Bloom filters: the surviving rows."""
    from ..streaming import keystore

    def build():
        base = scratch_path(spark, f"stream-bloom-{uuid.uuid4().hex[:8]}")
        src, files = _source(spark, sf_dir)
        write_batches(src, f"{base}/in", K, files_per_batch=files)
        schema = spark.read.parquet(f"{base}/in").schema
        keystore.bloom_dedupe(spark, f"{base}/in", schema, f"{base}/store", f"{base}/ckpt",
                              parts=max(4, src.count() // BUCKET_ROWS), files_per_batch=files)
        return spark.read.parquet(f"{base}/store/rows")
    return stage(spark, sf_dir, "stream_bloom_rows", build).select(
        "seq", "entity_id", "label", F.col("batch_id").cast("long").alias("batch_id"))


def _run_restored(spark, sf_dir):
    """The store of a stream that lost store and checkpoint after three of its batches and went on from its snapshot of two."""
    from ..streaming import snapshots
    key = ("restored", id(spark), sf_dir)
    if key not in _BASES:
        base = scratch_path(spark, f"stream-restored-{uuid.uuid4().hex[:8]}")
        src, files = _source(spark, sf_dir)
        how = {"every": BACKUP_EVERY, "parts": max(4, src.count() // BUCKET_ROWS), "files_per_batch": files}
        last = F.col("seq") % K == K - 1
        write_batches(src.where(~last), f"{base}/in", K, files_per_batch=files)
        schema = spark.read.parquet(f"{base}/in").schema
        snapshots.snapshotted_dedupe(spark, f"{base}/in", schema, f"{base}/lost", f"{base}/lost-ckpt", f"{base}/backup", **how)
        snapshots.restore(spark, f"{base}/backup", f"{base}/store", parts=how["parts"])
        write_batches(src.where(last), f"{base}/in", K, files_per_batch=files)
        snapshots.snapshotted_dedupe(spark, f"{base}/in", schema, f"{base}/store", f"{base}/ckpt", f"{base}/backup", **how)
        _BASES[key] = base
    return f"{_BASES[key]}/store"


@register("stream_restored_rows", f"WITH {STREAM_CTES}\nSELECT seq, entity_id, label, text FROM first")
def stream_restored_rows(spark, sf_dir):
    """The surviving rows of a stream restarted from its snapshot are those of one that never stopped."""
    return spark.read.parquet(f"{_run_restored(spark, sf_dir)}/rows").select("seq", "entity_id", "label", "text")


@register("stream_restored_totals", f"""WITH {STREAM_CTES}
SELECT (SELECT count(*) FROM filtered) AS rows_in, count(*) AS new_rows, (SELECT count(*) FROM filtered) - count(*) AS discarded
FROM first""")
def stream_restored_totals(spark, sf_dir):
    """Rows in, new and discarded over the restart; no file counts twice."""
    from ..streaming import snapshots
    return snapshots.totals(spark, _run_restored(spark, sf_dir))
