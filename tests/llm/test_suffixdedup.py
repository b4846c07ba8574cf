import hashlib
import random

import duckdb

from opinio.llm import suffixdedup as S


def test_loser_tree_merges_and_carries_prefixes():
    rng = random.Random(5)
    for k in (1, 2, 3, 13):
        runs = []
        for _ in range(k):
            r = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30)))
            runs.append([(S.common_prefix(r[i - 1] if i else b"", x, 0), x) for i, x in enumerate(r)])
        got = [(runs[a][b][1], p) for a, b, p in S.merged(runs)]
        flat = sorted(x for r in runs for _, x in r)
        assert [x for x, _ in got] == flat
        assert all(p == S.common_prefix(flat[i - 1], x, 0) for i, (x, p) in enumerate(got) if i)


def brute(docs, n):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in docs}, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p:p + n] in seen:
                gone[p:p + n] = b"\1" * n
            seen.add(b[p:p + n])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def case():
    rng = random.Random(7)
    voc = ["aa", "b", "cé", "d d", "xyz", "the", "and"]
    passages = [" ".join(rng.choice(voc) for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(120):
        t = " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 30)))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            t += " " + p[a:a + rng.randrange(5, 200)] + " " + " ".join(rng.choice(voc) for _ in range(5))
        docs.append((i, t))
    return docs + [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (304, docs[7][1]), (305, docs[110][1]), (None, docs[3][1]),
                   (400, docs[9][1]), (400, docs[9][1]), (401, "long " * 20000)]


def test_equals_brute_force(spark):
    docs = case()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, block string").repartition(3)
    for n, gram, size in ((20, 8, 2000), (16, 8, 1 << 20)):
        want = brute(docs, n)
        rows = S.digest(df, n, gram, size).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert tuple(r)[1:] == want[r["doc_id"]], (n, r)
    kept = {r["doc_id"]: r["kept"] for r in S.deduplicated(df, 100).collect()}
    want = brute(docs, 100)
    assert all(hashlib.sha256(kept[i] or b"").hexdigest() == want[i][3] for i, _ in docs) and kept[300] is None


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = brute(docs, 100)
    rows = S.op8_suffixdedup(spark, sf).collect()
    assert len(rows) == len(docs) and all(tuple(r)[1:] == want[r["doc_id"]] for r in rows)


def test_empty(spark):
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
