"""CSV/JSON round trips, optional sources, and streaming = batch dedupe."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from opinio.operators.dedupe import keep_first, with_review_key
from opinio.operators import evaluate as EV
from opinio.sources import files as IO
from opinio.streaming import incremental_dedupe, write_batches


def _tmp():
    return tempfile.mkdtemp(prefix="opinio-test-")


def test_csv_roundtrip_and_na(spark):
    rows = [("1", 'he said "hi",\nthen left \\ ok', "recommended", "1"),
            ("2", "NA", "not_recommended", "0"),
            ("3", "  padded  ", None, "1.0")]
    df = spark.createDataFrame(rows, "entity_id string, text string, marker string, label string")
    p = os.path.join(_tmp(), "r.csv")
    IO.write_reviews_csv(df, p)
    back = IO.read_reviews_csv(spark, p, ["entity_id", "text", "label"]).orderBy("entity_id").collect()
    assert back[0]["text"] == rows[0][1]
    assert back[1]["text"] is None            # literal NA token
    assert back[2]["text"] == "  padded  " and back[2]["marker"] is None
    with pytest.raises(ValueError, match="missing required columns"):
        IO.read_reviews_csv(spark, p, ["entity_id", "sentiment"])
    assert IO.read_reviews_csv(spark, p + ".nope", mandatory=False) is None
    with pytest.raises(FileNotFoundError):
        IO.read_reviews_csv(spark, p + ".nope")


def test_csv_headers_order_and_bad_rows(spark):
    p = _tmp()
    with open(f"{p}/a.csv", "w") as f:
        f.write("entity_id,text,label\n1,first,0\n2,second,1\n")
    with open(f"{p}/b.csv", "w") as f:
        f.write("label,text,entity_id\n" + "".join(f"1,text {i},{i}\n" for i in range(500)))
    rows = IO.read_reviews_csv(spark, p, ["entity_id", "label"]).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(502))
    assert [(r["entity_id"], r["text"], r["label"]) for r in rows[:3]] == [("1", "first", "0"), ("2", "second", "1"), ("0", "text 0", "1")]
    assert rows[-1]["text"] == "text 499"
    with open(f"{p}/c.csv", "w") as f:
        f.write("entity_id,text,label\n7,short\n8,fine,1\n9,long,1,extra\n")
    with pytest.raises(ValueError, match="2 rows"):
        IO.read_reviews_csv(spark, p)
    assert IO.read_reviews_csv(spark, p, bad_rows="drop").count() == 503


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from opinio import session

    class Other:
        def __getattr__(self, name):
            return getattr(spark, name)

        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Other())


def test_csv_sink_dedupes_first(spark):
    df = spark.createDataFrame([(1, "a", "Same  text"), (2, "a", "same text"), (3, "b", "same text")],
                               "seq long, entity_id string, text string")
    p = os.path.join(_tmp(), "d.csv")
    IO.write_reviews_csv(df, p, dedupe_keys=["entity_id"])
    back = sorted(r["seq"] for r in IO.read_reviews_csv(spark, p, ordinal="row").collect())
    assert back == ["1", "3"]


def test_metrics_json_roundtrip(spark):
    rows = [(0, 0.2)] * 3 + [(1, 0.7)] * 2 + [(1, 0.3)]
    df = spark.createDataFrame(rows, "label int, score double")
    doc = EV.metrics_document(EV.evaluate(df))
    p = os.path.join(_tmp(), "m.json")
    IO.write_metrics_json(doc, p)
    back = IO.read_metrics_json(spark, p).first()
    assert back["confusion_matrix"] == [[3, 0], [1, 2]]
    assert back["per_class"]["positive"]["recall"] == pytest.approx(2 / 3)


def test_stream_equals_batch_and_replays(spark):
    n = 400
    df = spark.range(n).select(
        F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("entity_id"),
        F.concat(F.lit("Review  number "), (F.col("id") % 50).cast("string")).alias("text"))
    base = _tmp()
    write_batches(df, f"{base}/in", 4)
    schema = spark.read.parquet(f"{base}/in").schema
    incremental_dedupe(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck",
                       backup_dir=f"{base}/bk", backup_every=2)
    rows = spark.read.parquet(f"{base}/out/rows")
    batch = keep_first(with_review_key(df), ["entity_id", "_key"], "seq")
    assert rows.count() == batch.count()
    got = {(r["entity_id"], r["text"].lower().replace("  ", " ")) for r in rows.collect()}
    want = {(r["entity_id"], r["text"].lower().replace("  ", " ")) for r in batch.collect()}
    assert got == want
    stats = spark.read.parquet(f"{base}/out/stats").collect()
    assert sum(s["new_rows"] for s in stats) == rows.count()
    assert sum(s["rows_in"] for s in stats) == n
    assert spark.read.parquet(f"{base}/bk").count() > 0
    # a second run on the same checkpoint finds nothing new and changes nothing
    incremental_dedupe(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck")
    assert spark.read.parquet(f"{base}/out/rows").count() == rows.count()


def test_state_store_stream_matches_batch_keys(spark):
    from opinio.streaming import incremental_dedupe_state
    n = 300
    df = spark.range(n).select(
        F.col("id").alias("seq"), (F.col("id") % 2).cast("string").alias("entity_id"),
        F.concat(F.lit("Same "), (F.col("id") % 40).cast("string")).alias("text"))
    base = _tmp()
    write_batches(df, f"{base}/in", 3)
    schema = spark.read.parquet(f"{base}/in").schema
    incremental_dedupe_state(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck")
    got = spark.read.parquet(f"{base}/out")
    want = df.select("entity_id", F.lower("text")).distinct().count()
    assert want == 40
    assert got.count() == want
    assert got.select("entity_id", "key_hash").distinct().count() == want


def test_state_stream_within_watermark(spark):
    from opinio.streaming import incremental_dedupe_state
    n = 200
    df = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("e").alias("entity_id"),
        F.concat(F.lit("Copy "), (F.col("id") % 25).cast("string")).alias("text"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp")
         + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"))
    base = _tmp()
    write_batches(df, f"{base}/in", 2)
    schema = spark.read.parquet(f"{base}/in").schema
    incremental_dedupe_state(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck",
                             event_time_col="ts", watermark="1 day")
    got = spark.read.parquet(f"{base}/out")
    # every copy lies within one day of the first, so one row per text survives
    assert got.count() == 25
