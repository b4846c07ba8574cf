"""Stored keys with Bloom filters: same rows as the anti join, and untouched folders stay closed."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from opinio.operators.dedupe import keep_first, with_review_key
from opinio.streaming import keystore as S

SCHEMA = "seq long, entity_id string, text string"


def batches():
    one = [(i, "ab"[i % 2], f"Text {i % 90}") for i in range(120)] + [(500, None, "text 1"), (501, "a", None)]
    two = [(1000 + i, "ab"[i % 2], f"text  {i}") for i in range(60, 140)] + [(600, None, "Text 1"), (601, "a", None)]
    return [one, two, [], one[:30] + [(2000, "c", "new")]]


def test_equals_the_anti_join_and_replays(spark):
    store = tempfile.mkdtemp(prefix="opinio-test-")
    seen = None
    for i, rows in enumerate(batches()):
        df = spark.createDataFrame(rows, SCHEMA)
        first = keep_first(with_review_key(df, "text", "key_hash"), ["entity_id", "key_hash"], "seq")
        if seen is not None:
            same = F.col("entity_id").eqNullSafe(F.col("e")) & F.col("key_hash").eqNullSafe(F.col("k"))
            first = first.join(seen.select(F.col("entity_id").alias("e"), F.col("key_hash").alias("k")), same, "left_anti")
        first = spark.createDataFrame(first.collect(), first.schema)
        for _ in range(2):  # a replayed batch gives the same
            got = S.accept(df, i, store, parts=5)
            assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in first.collect())
        seen = first if seen is None else seen.unionByName(first)


def test_untouched_folders_are_not_opened(spark):
    store = tempfile.mkdtemp(prefix="opinio-test-")
    S.accept(spark.createDataFrame([(i, "a", f"text {i}") for i in range(2000)], SCHEMA), 0, store, parts=16)
    again = spark.createDataFrame([(5000, "a", "TEXT  7"), (5001, "a", "unseen text")], SCHEMA)
    keys = S._dealt(with_review_key(again, "text", "key_hash"), "entity_id", 16)
    opened = {r["part"] for r in S.folders_to_open(keys, store, 1).collect()}
    held = keys.where(F.col("key_hash") == F.unhex(F.md5(F.lit("text 7")))).first()["part"]
    assert held in opened and len(opened) <= 2
    spoilt = 0
    for f in glob.glob(f"{store}/keys/batch_id=0/part=*/*.parquet"):
        if int(f.split("part=")[1].split("/")[0]) not in opened:
            for g in (f, os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")):
                with open(g, "wb") as out:
                    out.write(b"not parquet")
            spoilt += 1
    assert spoilt >= 14  # they could not be read
    assert [r["seq"] for r in S.accept(again, 1, store, parts=16).collect()] == [5001]


def test_filters():
    keys = [("e", bytes([i % 256, i // 256] * 8)) for i in range(3000)]
    bloom = S.bloom_of(*zip(*keys[:2000]))
    hits = S.may_hold(bloom, *zip(*keys))
    assert hits[:2000].all() and hits[2000:].mean() < 0.03
    assert S.may_hold(S.bloom_of([None], [keys[0][1]]), [None, ""], [keys[0][1]] * 2).tolist() == [True, False]


def test_beyond_the_listed_folders(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_FOLDERS", 0)
    store = tempfile.mkdtemp(prefix="opinio-test-")
    S.accept(spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], SCHEMA), 0, store, parts=3)
    got = S.accept(spark.createDataFrame([(3, "a", "X"), (4, "a", "z")], SCHEMA), 1, store, parts=3)
    assert [r["seq"] for r in got.collect()] == [4]
