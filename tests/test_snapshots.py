"""Restart of an ingest stream from its snapshots after store and checkpoint are lost."""

import glob
import os
import tempfile

import pytest

from opinio.streaming import snapshots as S

SCHEMA = "seq long, entity_id string, text string"
HOW = {"every": 2, "parts": 3}
BATCHES = [
    [(1, "a", "one"), (2, "a", " ONE"), (3, None, "x"), (4, "b", None)],
    [(11, "a", "two"), (12, "a", "one"), (13, None, "X")],
    [(21, "a", "three"), (22, "b", None), (23, "a", "Two")],
    [(31, "a", "four"), (32, "a", "three"), (33, "c", "new")],
    [(41, "c", "new"), (42, "d", "last")],
]
SURVIVORS = [1, 3, 4, 11, 21, 31, 33, 42]


def deliver(spark, base, some):
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(f"{base}/in", exist_ok=True)
    for i in some:
        path = f"{base}/in/{i}.parquet"
        pq.write_table(pa.table(dict(zip(("seq", "entity_id", "text"), map(list, zip(*BATCHES[i])))),
                                pa.schema([("seq", pa.int64()), ("entity_id", pa.string()), ("text", pa.string())])), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def run(spark, base, name):
    S.snapshotted_dedupe(spark, f"{base}/in", SCHEMA, f"{base}/{name}", f"{base}/{name}-ckpt", f"{base}/backup", **HOW)


def kept(spark, base, name):
    return sorted(r["seq"] for r in spark.read.parquet(f"{base}/{name}/rows").collect())


def test_restart_from_the_last_snapshot(spark):
    base = tempfile.mkdtemp(prefix="opinio-test-")
    deliver(spark, base, range(3))
    run(spark, base, "one")
    assert S.manifests(spark, f"{base}/backup") == [1]  # batch 2 is in no snapshot yet
    with pytest.raises(ValueError, match="checkpoint"):  # a store without its checkpoint is not gone on with
        S.snapshotted_dedupe(spark, f"{base}/in", SCHEMA, f"{base}/one", f"{base}/other", f"{base}/backup", **HOW)
    assert S.restore(spark, f"{base}/backup", f"{base}/two", parts=3) == 1
    with pytest.raises(ValueError, match="new folder"):
        S.restore(spark, f"{base}/backup", f"{base}/two", parts=3)
    assert kept(spark, base, "two") == [1, 3, 4, 11]
    deliver(spark, base, range(3, 5))
    run(spark, base, "two")
    assert kept(spark, base, "two") == SURVIVORS
    assert tuple(S.totals(spark, f"{base}/two").first()) == (15, 8, 7)
    run(spark, base, "two")  # nothing new: nothing changes
    assert kept(spark, base, "two") == SURVIVORS
    assert S.manifests(spark, f"{base}/backup") == [6, 4, 1]  # 2 and 3 held the restored files

    # a second loss, of a newer snapshot as well: the older one is whole and everything since is read again
    newest = max(glob.glob(f"{base}/backup/rows/batch_id=*"), key=lambda p: int(p.split("=")[1]))
    for f in glob.glob(f"{newest}/*.parquet"):
        for g in (f, os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")):
            with open(g, "wb") as out:
                out.write(b"not parquet")
    assert S.restore(spark, f"{base}/backup", f"{base}/three", parts=3) == 4
    assert kept(spark, base, "three") == [1, 3, 4, 11, 21]
    run(spark, base, "three")
    assert kept(spark, base, "three") == SURVIVORS
    assert tuple(S.totals(spark, f"{base}/three").first()) == (15, 8, 7)


def test_a_snapshot_without_manifest_does_not_exist(spark):
    base = tempfile.mkdtemp(prefix="opinio-test-")
    deliver(spark, base, range(2))
    run(spark, base, "one")
    S._overwrite(spark.read.parquet(f"{base}/one/rows").selectExpr("* except (batch_id)", "cast(9 as long) batch_id"),
                 f"{base}/backup/rows", "batch_id")  # a copy that was cut short before its manifest
    assert S.restore(spark, f"{base}/backup", f"{base}/two", parts=3) == 1
    assert kept(spark, base, "two") == [1, 3, 4, 11]
    with pytest.raises(ValueError, match="no whole snapshot"):
        S.restore(spark, f"{base}/nothing", f"{base}/three", parts=3)
