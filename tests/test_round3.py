"""Findings of round 3: models after an observed query, partial sums, finer files, walks by slices, hashed losers."""

import os
import uuid

import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from opinio import session
from opinio.operators import batches as BA
from opinio.operators import dedupe as D
from opinio.operators import extract as X
from opinio.operators import score as S
from opinio.plans import q_clean, q_stream
from opinio.streaming import write_batches


def labelled(spark, n=40):
    return spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "poor film").otherwise("fine film").alias("text"),
                                 (F.col("id") % 2).cast("int").alias("label"))


def test_a_model_scores_after_an_observed_query(spark):
    o = Observation()
    spark.range(5).observe(o, F.count(F.lit(1)).alias("n")).collect()
    assert o.get == {"n": 5}
    m = S.fit_classifier(labelled(spark), num_features=16, reg_param=.1)
    assert all((r["score"] >= .5) == (r["label"] == 1) for r in S.score_with(m, labelled(spark, 10)).collect())


def test_few_partial_sums_reach_the_driver():
    def left(n, depth):
        scale = max(-(-n ** (1 / depth) // 1), 2)
        while n > scale + -(-n // scale):
            n //= int(scale)
        return n
    assert max(left(n, S.tree_depth(n)) for n in (6, 12, 24, 50, 200, 1000, 5000)) <= 3
    assert left(1000, 2) > 20


def test_a_batch_has_all_its_files(spark):
    """Three rows a batch over eight files: empty files stand where no row was dealt, so no batch moves up."""
    out = f"{session.scratch_path(spark, 'files')}-{uuid.uuid4().hex}/in"
    write_batches(labelled(spark, 6), out, 2, files_per_batch=8)
    names = sorted(n for n in os.listdir(out) if n.endswith(".parquet"))
    assert [n[:15] for n in names] == [f"batch-{i:04d}-{j:04d}" for i in range(2) for j in range(8)]
    assert spark.read.parquet(out).count() == 6


def reviews(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.lit("e").alias("entity_id"), F.format_string("some text of number %d here", "id").alias("text"),
                                 F.lit("1").alias("label"), F.lit("m").alias("marker"))


def test_files_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(q_stream, "reviews_raw", lambda s, d: reviews(s, 90_000))
    assert q_stream._source(spark, "many")[1] == 3
    monkeypatch.setattr(q_clean, "reviews_raw", lambda s, d: reviews(s, 600))
    monkeypatch.setattr(q_clean, "CSV_ROWS", 100)
    seen = []
    from opinio.sources import files
    real = files.write_reviews_csv
    monkeypatch.setattr(files, "write_reviews_csv", lambda df, p: (seen.append(p), real(df, p)))
    rows = q_clean._csv_roundtrip(spark, f"csv-{uuid.uuid4().hex}").collect()
    assert sorted((r["file_order"], int(r["seq"])) for r in rows) == [(i, i) for i in range(600)]
    assert sum(n.endswith(".csv") for n in os.listdir(seen[0])) == 6


def test_boxes_come_in_slices():
    box = '<div class="review-element"><span class="tag">Recommended</span><div class="text">t{}</div></div>'
    pages = [None, "<p>none</p>"] + [box.format(i) for i in range(198)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([False] * 200), pa.array([None] * 200, pa.string()),
                                        pa.array([None] * 200, pa.string()), pa.array(pages)], names=["page_id", "blocked", "main_entity", "slug", "html"])
    out = list(X._boxes_fn(iter([batch])))
    assert max(b.num_rows for b in out) <= X.PAGES_AT_ONCE
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["body"] for r in rows] == [None, None] + [f"t{i}" for i in range(198)]
    assert [r["box_pos"] for r in rows[:3]] == [None, None, 0] and rows[2]["tags"] == ["Recommended"]


def test_arrow_batches_are_cut_by_bytes_in_any_session(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    session.ship_package(spark)
    assert spark.conf.get(limit) == session.DEFAULT_CONF[limit]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_losers_never_sort_the_rows(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 90).alias("k"), F.lit("a text").alias("text"))
    few = D.keep_first(df, ["k"], "id")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 10)
    many = D.keep_first(df, ["k"], "id")
    last = [next(line for line in plan(p).splitlines() if "LeftAnti" in line) for p in (few, many)]
    assert "BroadcastHashJoin" in last[0] and "ShuffledHashJoin" in last[1]
    assert sorted(r["id"] for r in many.collect()) == sorted(r["id"] for r in few.collect()) == list(range(90))


def test_padding_sends_each_sequence_once(spark):
    df = spark.range(50).select("id", F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("ids"))
    out = BA.padded_batches(df, ["id"], {"ids": 0}, 4)
    # the rows are ordered by their own fields, not by a copy of them
    assert "row#" in plan(out) and "struct(" not in plan(out).split("Exchange hashpartitioning(span", 2)[2].split("FileScan")[0]
    assert out.count() == 50
