"""Streaming dedupe with keyed state against a loop over the batches."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from opinio.streaming import keyed as K

SCHEMA = "seq long, entity_id string, text string, label int"


def loop(batches):
    """batch -> (accepted orders, rows in), the first by (null last, order) of each key not seen before."""
    seen, out = set(), []
    for rows in batches:
        new = []
        for seq, entity, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            key = entity, " ".join((text or "").lower().split()) if text is not None else None
            if key not in seen:
                seen.add(key)
                new.append(seq)
        out.append((sorted(new, key=str), len(rows)))
    return out


def put(spark, folder, rows, slices=3):
    spark.createDataFrame(rows, SCHEMA).repartition(slices).write.mode("append").parquet(folder)


def run(spark, base, **how):
    K.keyed_dedupe(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema, f"{base}/out", f"{base}/ck",
                   buckets=3, partitions=3, files_per_batch=1000, **how)


def accepted(spark, base):
    per = {}
    for r in K.accepted(spark, f"{base}/out", spark.createDataFrame([], SCHEMA).schema).collect():
        per.setdefault(r["batch_id"], []).append(r["seq"])
    return per


def test_first_arrival_in_and_across_batches(spark):
    base = tempfile.mkdtemp(prefix="opinio-test-")
    batches = [
        [(9, "a", "One  text", 1), (3, "a", "one text ", 0), (7, "a", "ONE TEXT", 1), (4, None, "one text", 1), (5, "b", "", 1)]
        + [(100 + i, "hot", "Same", 1) for i in range(400)],
        [(1, "a", "one text", 1), (11, "a", "two", 1), (None, "a", "three", 1), (12, "a", "Three", 0), (13, None, "one text", 1)],
        [(14, "a", "three", 1), (None, "c", "x", 1), (None, "c", "x", None), (2, "hot", "same", 1)]]
    want = loop(batches)
    for i, rows in enumerate(batches):
        put(spark, f"{base}/in", rows)
        run(spark, base)  # each call goes on from the checkpoint
        got = accepted(spark, base)
        assert sorted(got.get(i, []), key=str) == want[i][0]
    counts = {r["batch_id"]: (r["rows_in"], r["new_rows"], r["discarded"]) for r in K.batch_counts(spark, f"{base}/out").collect()}
    assert counts == {i: (n, len(new), n - len(new)) for i, (new, n) in enumerate(want)}
    assert tuple(K.state_totals(spark, f"{base}/out").first()) == (sum(map(len, batches)), sum(len(w[0]) for w in want))
    before = accepted(spark, base)
    run(spark, base)  # nothing new
    assert accepted(spark, base) == before


def test_no_earlier_output_is_read(spark):
    """Accepted rows can be taken away between batches: the state alone knows the keys."""
    base = tempfile.mkdtemp(prefix="opinio-test-")
    put(spark, f"{base}/in", [(1, "a", "x", 1)])
    run(spark, base)
    put(spark, f"{base}/in", [(2, "a", "X ", 1), (3, "a", "y", 1)])
    K_out = f"{base}/other"
    K.keyed_dedupe(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema, K_out, f"{base}/ck", buckets=3, partitions=3)
    rows = K.accepted(spark, K_out, spark.createDataFrame([], SCHEMA).schema).collect()
    assert [r["seq"] for r in rows] == [3]


def test_time_to_live(spark):
    base = tempfile.mkdtemp(prefix="opinio-test-")
    schema = spark.createDataFrame([], SCHEMA).schema
    put(spark, f"{base}/in", [(1, "a", "x", 1)], 1)
    with pytest.raises(ValueError, match="available_now"):
        run(spark, base, ttl_ms=1000)
    q = K.keyed_dedupe(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck", buckets=1, partitions=1, ttl_ms=1000,
                       available_now=False, every="0 seconds")

    def wait(rows):
        for _ in range(120):
            try:
                if sorted(r["seq"] for r in K.accepted(spark, f"{base}/out", schema).collect()) == rows:
                    return True
            except Exception:  # nothing written yet, or files of a batch being replaced
                pass
            time.sleep(0.5)
        return False

    try:
        assert wait([1])
        time.sleep(2)
        put(spark, f"{base}/in", [(2, "a", "x", 1)], 1)
        assert wait([1, 2])
    finally:
        q.stop()


def test_a_key_is_combined_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "hot", "same", 1) for i in range(5000)], SCHEMA).coalesce(2).withColumn("key_hash", F.unhex(F.md5("text")))
    out = df.mapInArrow(K._combined("entity_id", "seq"), df.withColumn("copies", F.lit(1).cast("long")).schema)
    assert out.count() <= 4 and out.agg(F.sum("copies")).first()[0] == 5000
