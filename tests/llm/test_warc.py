import hashlib
import io
import random
import re
import tempfile
import zlib

from opinio.llm import warc

SCHEMA = "page_id long, url string, html string, kind string"


def gz(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def rec(i, payload=b"hello"):
    return warc.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest())


def salvaged(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_salvage_recovers_and_logs_gaps():
    rng = random.Random(1)
    for pack in (gz, lambda x: x):
        parts = [pack(rec(i, bytes(rng.randrange(256) for _ in range(200)) * (1 + 3000 * (i == 3)))) for i in range(8)]
        whole = b"".join(parts)
        assert [r[4] for r in salvaged(whole)] == [None] * 8
        at = [sum(map(len, parts[:i])) for i in range(9)]
        broken = bytearray(whole)
        broken[at[2] + len(parts[2]) // 2] ^= 0xFF  # a flipped bit in record 2
        broken = bytes(broken[:at[5] + 30]) + b"WARC/1.1\r\nnoise\x1f\x8b\x08" + bytes(broken[at[6]:])  # 5 cut short
        got = salvaged(broken + parts[0][:40])  # and a tail that is not ended
        ids = [warc._page_of(r[2]["warc-record-id"]) for r in got if r[2]]
        assert ids == [0, 1, 3, 4, 6, 7]
        gaps = [r for r in got if r[4]]
        assert [g[0] for g in gaps][:2] == [at[2], at[5]] and gaps[0][1] == at[3]
        # records and gaps tile the file
        edges = [(r[0], r[1]) for r in got]
        assert edges[0][0] == 0 and edges[-1][1] == len(broken) + 40 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_damage_anywhere_never_loses_other_records():
    rng = random.Random(2)
    parts = [gz(rec(i, b"payload %d " % i * 30)) for i in range(5)]
    whole, at = b"".join(parts), [0]
    for p in parts:
        at.append(at[-1] + len(p))
    for _ in range(150):
        k = rng.randrange(len(whole))
        b = bytearray(whole)
        b[k] ^= 1 << rng.randrange(8)
        hurt = next(i for i in range(5) if at[i] <= k < at[i + 1])
        ids = {warc._page_of(r[2]["warc-record-id"]) for r in salvaged(bytes(b)) if r[2]}
        assert ids >= set(range(5)) - {hurt}


def pages(got):
    return [warc._page_of(r[2]["warc-record-id"]) for r in got if r[2]]


def noise(rng, n):
    return bytes(rng.randrange(256) for _ in range(n))


def test_member_of_several_records():
    rng = random.Random(3)
    parts = [rec(i, b"payload %d " % i * 30 + noise(rng, 3000)) for i in range(40)]
    at = [sum(map(len, parts[:i])) for i in range(41)]
    inside = bytearray(b"".join(parts))
    inside[at[7] + 600] ^= 1  # a wrong digest inside an undamaged member
    inside[at[20]] = 0  # no version line
    got = salvaged(gz(bytes(inside)) + gz(rec(99)))
    assert pages(got) == [i for i in range(40) if i not in (7, 20)] + [99]
    assert [r[4] for r in got if r[4]] == [f"wrong block digest (unpacked bytes {at[7]} to {at[8]})",
                                           f"no version line (unpacked bytes {at[20]} to {at[21]})"]
    whole = gz(b"".join(parts))
    cut = len(whole) * 3 // 5
    got = salvaged(whole[:cut])
    n = len(pages(got))
    assert 20 <= n < 26 and pages(got) == list(range(n)) and got[-1][:2] == (0, cut) and got[-1][4] == "member not ended"
    crc = bytearray(whole)
    crc[-6] ^= 1
    got = salvaged(bytes(crc) + gz(rec(99)))
    assert pages(got) == [*range(40), 99] and [r[:2] for r in got if r[4]] == [(0, len(whole))]
    single = bytearray(gz(rec(1)))
    single[-6] ^= 1
    assert pages(salvaged(bytes(single) + gz(rec(2)))) == [2]  # which byte is wrong is not known
    bare = re.sub(rb"WARC-[A-Za-z]+-Digest: [^\r]*\r\n", b"", rec(50))
    hurt = bytearray(gz(parts[0] + bare + parts[1]))
    hurt[-6] ^= 1
    assert pages(salvaged(bytes(hurt))) == [0, 1]
    assert pages(salvaged(gz(parts[0] + bare + parts[1]))) == [0, 50, 1]


def test_damage_in_a_member_of_several_records():
    rng = random.Random(4)
    text = [rec(i, b" ".join(b"%d" % rng.randrange(10 ** 6) for _ in range(300))) for i in range(30)]
    raw = [rec(i, noise(rng, 9000)) for i in range(30)]  # kept in stored blocks: its version lines stand in the file
    for parts in (text, raw):
        whole = gz(b"".join(parts))
        for _ in range(40):
            k = rng.randrange(20, len(whole))
            b = bytearray(whole)
            b[k] ^= 1 << rng.randrange(8)
            got = salvaged(bytes(b) + gz(rec(99)))
            ids = pages(got)
            assert len(set(ids)) == len(ids) and 99 in ids and any(r[4] for r in got)
            before = int(30 * k / len(whole)) - 10  # zlib codes some records together
            assert set(range(before)) <= set(ids)


def test_large_members(monkeypatch):
    rng = random.Random(5)
    parts = [rec(i, noise(rng, 20000) * 3) for i in range(30)]
    monkeypatch.setattr(warc, "MAX_RECORD", 100_000)  # holds for a record, not for their sum
    monkeypatch.setattr(warc, "READ_BYTES", 4096)
    for kept in (4 << 20, 50_000):
        monkeypatch.setattr(warc, "KEPT_BYTES", kept, raising=False)
        got = salvaged(gz(b"".join(parts)))
        assert pages(got) == list(range(30)) and not any(r[4] for r in got)
    parts[4] = rec(4, noise(rng, 120_000))
    got = salvaged(gz(b"".join(parts)))
    assert pages(got) == [i for i in range(30) if i != 4] and sum(bool(r[4]) for r in got) == 1


def test_any_damaged_header_byte_is_noticed():
    parts = [rec(i, b"payload %d" % i) for i in range(3)]
    parts[1] = warc.record(1, "http://h/é", b"", "0" * 64, refers_to=0, revisit=True)
    whole, at = b"".join(parts), len(parts[0])
    head = parts[1].index(b"\r\n\r\n") + 4
    for k in range(head):
        b = bytearray(whole)
        b[at + k] ^= 0xFF
        got = salvaged(bytes(b))
        assert pages(got) == [0, 2] and [r[:2] for r in got if r[4]] == [(at, at + len(parts[1]))], (k, parts[1][k:k + 20])


def test_header_forms():
    def swapped(a, b):
        return salvaged(rec(0) + re.sub(a, b, rec(1)) + rec(2))

    for a, b in ((rb"WARC-Type: response\r\n", b""), (rb"WARC-Type: response", b"WARC-Type: re sponse"),
                 (rb"WARC-Record-ID: [^\r]*\r\n", b""), (rb"<urn", b"urn"), (rb"WARC-Date: [^\r]*", b"WARC-Date: today"),
                 (rb"WARC-Date", b"WARC Date"), (rb"http://h/1", b"http://h/\xff"), (rb"http://h/1", b"http://h/\x01")):
        got = swapped(a, b)
        assert pages(got) == [0, 2] and sum(bool(r[4]) for r in got) == 1, a
    assert pages(swapped(rb"http://h/1", b"http://h/\r\n 1")) == [0, 1, 2]  # a folded line
    assert pages(swapped(rb"00:00:00Z", b"00:00:00.123Z")) == [0, 1, 2]


def test_long_headers(spark, monkeypatch):
    long = "http://h/" + "x" * 5_000_000
    df = spark.createDataFrame([(1, "u", "a", "k"), (2, long, "b", "k"), (3, long[:300_000], "c", "k"), (4, None, "d", "k")], SCHEMA)
    folder = tempfile.mkdtemp(prefix="warc-test-")
    for limit in (warc.MAX_URL, 1000):
        monkeypatch.setattr(warc, "MAX_URL", limit)
        data = warc.record(2, long, b"x", "0")
        assert (len(data) > 5_000_000) == (limit > 1000)
    monkeypatch.undo()
    for compressed in (True, False):
        back = warc.read_archives(warc.write(df, f"{folder}/{compressed}", compressed=compressed)).collect()
        assert sorted((r["page_id"], r["kind"], len(r["url"] or "")) for r in back) == [
            (1, "record", 1), (2, "record", len(long)), (3, "record", 300_000), (4, "record", 0)]


def test_round_trip(spark):
    big = "é" * 200
    rows = [(1, "u", big, "k"), (2, "a b\r\n", big, "k"), (3, None, None, "k"), (4, "u", "", "k"), (None, "u", big, "k"),
            (5, "u", "short", "k"), (6, "u", "short", "k"), (1, "u", big, "k"), (7, "u", "x" * 300000, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = tempfile.mkdtemp(prefix="warc-test-")
    for compressed in (True, False):
        manifest = warc.write(df, f"{folder}/{compressed}", file_bytes=1000, compressed=compressed)
        assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
        back = warc.read_archives(manifest, payloads=True).collect()
        assert {r["kind"] for r in back} == {"record"} and len(back) == len(rows)
        for r in back:
            html = next((x[2] or "") for x in rows if x[0] == r["page_id"])
            assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
            assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] in (2, None) else ("response", None))
            assert r["record_type"] == "revisit" or r["payload"] == html.encode()
    empty = warc.write(spark.createDataFrame([], SCHEMA), f"{folder}/none")
    assert warc.read_archives(empty).collect() == []
